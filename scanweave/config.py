"""Parameters of the point pipeline, with their defaults and checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

UP_AXES = {"x": (-9.80665, 0.0, 0.0), "y": (0.0, -9.80665, 0.0), "z": (0.0, 0.0, -9.80665)}


@dataclass(frozen=True)
class Config:
    # selection and logs
    clustering_algorithm: str = "grid"
    ground_remover_type: str = "patchworkpp"
    estimator_type: str = "rule_based"
    log_dir: str = "log_profiler/"
    profile_name: str = "default"
    log_clusters: bool = True
    log_all_clusters: bool = False
    # core
    sensor_z: float = -0.52
    max_range: float = 25.0
    min_cluster_size: int = 2
    max_cluster_size: int = 300
    debug_pub_freq: int = 10
    debug: bool = True
    # voxel filter
    use_voxel_filter: bool = False
    voxel_size: float = 0.02
    # ground removal by polar bins
    bin_local_threshold: float = 0.02
    bin_hard_cutoff: float = -0.47
    bin_segments: int = 500
    bin_bins: int = 500
    # ground removal by slope
    slope_max_slope: float = 0.08
    slope_max_z_diff: float = 0.05
    slope_initial_threshold: float = 0.05
    slope_segments: int = 360
    # ground removal by concentric zones
    pw_num_iter: int = 3
    pw_th_dist: float = 0.02
    pw_th_seeds: float = 0.02
    pw_th_dist_v: float = 0.1
    pw_th_seeds_v: float = 0.02
    pw_min_range: float = 0.5
    pw_uprightness_thr: float = 0.707
    pw_enable_RNR: bool = True
    pw_enable_TGR: bool = True
    # clustering
    euclidean_tolerance: float = 0.35
    dbscan_eps: float = 0.30
    dbscan_min_pts: int = 3
    hdbscan_min_pts: int = 5
    hdbscan_alpha: float = 0.02
    voxel_grid_size: float = 0.02
    depth_theta_thr: float = 10.0
    depth_num_rings: int = 32
    grid_resolution: float = 0.12
    # shape features
    pca_max_linearity: float = 0.88
    pca_max_planarity: float = 0.8
    pca_min_scatter: float = 0.02
    pca_min_verticality: float = 0.65
    # rules
    rule_min_height: float = 0.10
    rule_max_height: float = 0.80
    rule_base_min_width: float = 0.10
    rule_max_width: float = 0.50
    rule_dynamic_width_decay: float = 0.005
    rule_min_points_at_10m: int = 5
    rule_min_points_cap: int = 60
    rule_min_intensity: float = 5.0
    # greedy merging
    merge_dist: float = 0.25
    tracking_match_dist: float = 0.45
    # motion compensation
    use_deskewing: bool = True
    imu_topic: str = "/imu"
    imu_frame: str = "zed_imu_link"
    extrinsic_rotation: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    extrinsic_translation: tuple[float, ...] = (0.0, 0.0, 0.0)
    roll_deg: float = -0.4
    pitch_deg: float = 0.0
    yaw_deg: float = 0.0
    world_up_axis: str = "y"
    #: Sign of gravity in the motion equations; -1 subtracts it, as the equations are written.
    gravity_sign: int = -1

    def __post_init__(self) -> None:
        # a YAML-style bare y or n may come as a boolean
        if isinstance(self.world_up_axis, bool):
            object.__setattr__(self, "world_up_axis", "y" if self.world_up_axis else "n")
        if self.world_up_axis not in UP_AXES:
            raise ValueError(f"world_up_axis must be x, y or z, not {self.world_up_axis!r}")
        for name in ("max_range", "grid_resolution", "voxel_grid_size", "voxel_size", "euclidean_tolerance", "dbscan_eps"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")

    def override(self, **values) -> Config:
        """A copy with other values; unknown names are an error."""
        known = {f.name for f in fields(self)}
        if unknown := set(values) - known:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **values)

    @classmethod
    def from_session(cls, spark, prefix: str = "scanweave.") -> Config:
        """Defaults, overridden by session settings of the given prefix."""
        got = {}
        for f in fields(cls):
            v = spark.conf.get(prefix + f.name, None)
            if v is not None:
                kind = type(f.default)
                got[f.name] = v.lower() == "true" if kind is bool else tuple(map(float, v.split(","))) if kind is tuple else kind(v)
        return cls().override(**got)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


DEFAULT = Config()
#: Values that production launches set.
PRODUCTION = DEFAULT.override(log_clusters=False, debug=False, debug_pub_freq=50, roll_deg=0.0)

# Fixed values that are not parameters.
BLIND_SPOT = 0.25
INTENSITY_REF, INTENSITY_CAP = 10.0, 255.0
INNER_RADIUS = 0.5
MIN_ASPECT, MAX_ASPECT, MAX_SYMMETRY = 0.25, 2.0, 5.5
TIME_GATE = 0.15
RINGS, COLUMNS = 40, 2048
CONFIDENCE = 0.5
