"""Ground removal: points in, the same rows with `label` (ground or obstacle) out, and voxel thinning of obstacles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLIND_SPOT, DEFAULT, INNER_RADIUS, Config
from ..functions.scalars import cell, finite, planar_range, radial_bin, sector
from .frames import Frame, per_frame

C = F.col


def spatial_truncate(points: DataFrame, max_range: float = DEFAULT.max_range) -> DataFrame:
    """Finite points from the blind spot to the largest range, in the plane. The box on raw columns lets Parquet skip."""
    x, y, z = C("x"), C("y"), C("z")
    r2 = x * x + y * y
    box = (F.abs(x) <= max_range) & (F.abs(y) <= max_range)
    return points.filter(box & finite(x, y, z) & r2.between(BLIND_SPOT * BLIND_SPOT, max_range * max_range))


def with_cell_min(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Points in the ring that the polar grid covers, with seg, bin and the least height of their cell."""
    x, y = C("x"), C("y")
    r = planar_range(x, y)
    # by frame only: the window needs no shuffle of its own, nor does a kernel over frames behind it
    inside = points.filter((r >= INNER_RADIUS) & (r <= cfg.max_range)).repartition("frame_id").withColumns({"seg": sector(x, y, cfg.bin_segments), "bin": radial_bin(x, y, cfg.bin_bins, cfg.max_range)})
    return inside.withColumn("cell_min_z", F.min("z").over(Window.partitionBy("frame_id", "seg", "bin")))


def ground_bin(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Obstacle: not below the hard cutoff, and higher above its cell's least point than the threshold. Points outside
    the ring are in neither class."""
    obstacle = (C("z") >= cfg.bin_hard_cutoff) & (C("z") > C("cell_min_z") + cfg.bin_local_threshold)
    return with_cell_min(points, cfg).withColumn("label", F.when(obstacle, "obstacle").otherwise("ground")).drop("seg", "bin", "cell_min_z")


def radial_order(points: DataFrame, segments: int = DEFAULT.slope_segments) -> DataFrame:
    """Points with their sector, squared range and rank outward in it; ties by index."""
    x, y = C("x"), C("y")
    r2 = (x * x + y * y).alias("r2")
    by = Window.partitionBy("frame_id", "seg").orderBy("r2", "point_idx")
    return points.filter(finite(x, y, C("z"))).select("*", sector(x, y, segments).alias("seg"), r2).withColumn("rank", F.row_number().over(by))


def ground_slope(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Walks each sector outward and keeps the last ground point. A fold over the sector's sorted points, inside Spark;
    a sector of one frame is a few dozen points."""
    p = F.struct("point_idx", "x", "y", "z", F.sqrt(F.col("r2")).alias("r"))
    sectors = radial_order(points, cfg.slope_segments).groupBy("frame_id", "seg").agg(F.sort_array(F.collect_list(F.struct("r2", "point_idx", p.alias("p")))).alias("ps"))
    start = F.struct(F.lit(0.0).alias("r"), F.lit(float(cfg.sensor_z)).alias("z"), F.array().cast("array<struct<point_idx:bigint,ground:boolean>>").alias("out"))

    def walk(s: Column, e: Column) -> Column:
        q = e["p"]
        dr, dz = q["r"] - s["r"], F.abs(q["z"] - s["z"])
        near = F.when(dr > 0.05, (F.try_divide(dz, dr) < cfg.slope_max_slope) & (dz < cfg.slope_max_z_diff)).otherwise(dz < cfg.slope_max_z_diff)
        ground = near | ((q["z"] < cfg.sensor_z + cfg.slope_initial_threshold) & (q["r"] < 3.0))
        close = q["r"] < INNER_RADIUS
        moved = ground & ~close
        seen = F.array(F.struct(q["point_idx"].alias("point_idx"), (close | ground).alias("ground")))
        return F.struct(F.when(moved, q["r"]).otherwise(s["r"]).alias("r"), F.when(moved, q["z"]).otherwise(s["z"]).alias("z"), F.concat(s["out"], seen).alias("out"))

    marks = sectors.select("frame_id", F.inline(F.aggregate("ps", start, walk)["out"]))
    label = F.when(F.col("ground"), "ground").otherwise("obstacle")
    return points.join(marks, ["frame_id", "point_idx"]).withColumn("label", label).drop("ground")


#: Fixed values of the zone model: bounds of the four zones in metres, rings and sectors of each.
ZONES = ((0.0, 6.0, 2, 16), (6.0, 12.0, 4, 32), (12.0, 18.0, 4, 54), (18.0, 1e9, 4, 32))
RNR_ANGLE, RNR_INTENSITY = -15.0, 0.2
SEED_POINTS, LEAST_POINTS = 20, 10


def _plane(p: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(normal pointing up, offset, singular values) of the plane of least squares."""
    mean = p.mean(0)
    _, s, vt = np.linalg.svd(p - mean, full_matrices=False)
    n = vt[2] if vt[2, 2] >= 0 else -vt[2]
    return n, -float(n @ mean), s**2 / len(p)


def ground_zones(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Concentric-zone ground likelihood, from the published description of the method: reflected noise goes, each patch
    takes low points as seeds, vertical planes among them are set aside, a plane is fitted over a few rounds, and the
    patch is ground if the plane is upright and neither high nor rough for its zone. Every frame starts from the same
    thresholds; adapting them over frames is not built, nor is the temporal revert (Config.pw_enable_TGR has no effect)."""
    height = abs(cfg.sensor_z)

    def kernel(f: Frame) -> Frame:
        xyz = np.stack([f["x"], f["y"], f["z"]], 1)
        ok = np.isfinite(xyz).all(1)
        xyz, idx, intensity = xyz[ok], f["point_idx"][ok], f["intensity"][ok]
        ground = np.zeros(len(xyz), bool)
        r = np.hypot(xyz[:, 0], xyz[:, 1])
        noise = np.zeros(len(xyz), bool)
        if cfg.pw_enable_RNR:
            noise = (np.degrees(np.arctan2(xyz[:, 2], r)) < RNR_ANGLE) & (xyz[:, 2] < -height - 0.8) & (intensity < RNR_INTENSITY)
        angle = np.arctan2(xyz[:, 1], xyz[:, 0]) % (2 * math.pi)
        use = ~noise & (r > cfg.pw_min_range) & (r <= cfg.max_range)
        for zone, (lo, hi, rings, sectors) in enumerate(ZONES):
            hi = min(hi, cfg.max_range)
            if hi <= lo:
                continue
            here = np.flatnonzero(use & (r > max(lo, cfg.pw_min_range) - 1e-12) & (r > lo) & (r <= hi))
            if not len(here):
                continue
            ring = np.minimum(((r[here] - lo) / ((hi - lo) / rings)).astype(int), rings - 1)
            patch = ring * sectors + np.minimum((angle[here] / (2 * math.pi / sectors)).astype(int), sectors - 1)
            for k in np.unique(patch):
                members = here[patch == k]
                if len(members) >= LEAST_POINTS:
                    ground[members] = _patch(xyz[members], zone, cfg, height)
        return {"point_idx": idx, "label": np.where(ground, "ground", "obstacle").astype(object)}

    got = per_frame(points.select("frame_id", "point_idx", "x", "y", "z", "intensity"), kernel, "frame_id bigint, point_idx bigint, label string")
    return points.join(got, ["frame_id", "point_idx"])


def _patch(p: np.ndarray, zone: int, cfg: Config, height: float) -> np.ndarray:
    """Which points of a patch are ground."""
    left = np.arange(len(p))
    if zone == 0:  # near the sensor, planes that stand upright are taken out first
        for _ in range(cfg.pw_num_iter):
            low = p[left][np.argsort(p[left, 2], kind="stable")[:SEED_POINTS], 2].mean()
            seeds = left[p[left, 2] < low + cfg.pw_th_seeds_v]
            if len(seeds) < 3:
                break
            n, d, _ = _plane(p[seeds])
            if n[2] >= cfg.pw_uprightness_thr - 0.1:
                break
            left = left[np.abs(p[left] @ n + d) > cfg.pw_th_dist_v]
            if len(left) < 3:
                return np.zeros(len(p), bool)
    low = p[left][np.argsort(p[left, 2], kind="stable")[:SEED_POINTS], 2].mean()
    chosen = left[p[left, 2] < low + cfg.pw_th_seeds]
    for _ in range(cfg.pw_num_iter):
        if len(chosen) < 3:
            return np.zeros(len(p), bool)
        n, d, s = _plane(p[chosen])
        chosen = left[p[left] @ n + d < cfg.pw_th_dist]
    if len(chosen) < 3:
        return np.zeros(len(p), bool)
    n, _, s = _plane(p[chosen])
    upright = n[2] > cfg.pw_uprightness_thr
    high = p[chosen, 2].mean() > -height + (0.5 + 0.2 * zone)
    flat = s[2] < 1e-4 * (zone + 1)
    out = np.zeros(len(p), bool)
    out[chosen] = upright and (not high or flat)
    return out


GROUND_REMOVERS = {"bin_based": ground_bin, "slope_based": ground_slope, "patchworkpp": ground_zones}


def voxel_downsample(points: DataFrame, size: float = DEFAULT.voxel_size) -> DataFrame:
    """One point per voxel: the means of its fields; point_idx is the least of its points."""
    keys = {k: cell(F.col(c), size) for k, c in (("vx", "x"), ("vy", "y"), ("vz", "z"))}
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", "intensity")]
    return points.withColumns(keys).groupBy("frame_id", *keys).agg(F.min("point_idx").alias("point_idx"), F.count("*").alias("n"), *means)


def remove_ground(points: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """By the configured method; an unknown name is an error."""
    if cfg.ground_remover_type not in GROUND_REMOVERS:
        raise ValueError(f"unknown ground remover {cfg.ground_remover_type!r}; known: {sorted(GROUND_REMOVERS)}")
    return GROUND_REMOVERS[cfg.ground_remover_type](points, cfg)
