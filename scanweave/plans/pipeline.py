"""The whole point pipeline as one plan: sweeps in, cones out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import normalized_intensity
from ..operators.cluster import cluster
from ..operators.deskew import deskew_points, frame_motion
from ..operators.features import accepted, classify, features
from ..operators.greedy import aggregate_duplicates, merge_clusters
from ..operators.ground import remove_ground, spatial_truncate, voxel_downsample

#: What entry points run: the ground remover whose definition is complete.
BATCH = DEFAULT.override(ground_remover_type="bin_based")


def prepared(points: DataFrame, cfg: Config = BATCH) -> DataFrame:
    """Truncated points with normalised intensity."""
    i = normalized_intensity(F.col("x"), F.col("y"), F.col("z"), F.col("intensity"))
    return spatial_truncate(points, cfg.max_range).withColumn("intensity", i)


@dataclass(frozen=True)
class Motion:
    """What motion compensation needs: frames (frame_id, header_ts_ns), inertial samples, and transforms between frames."""

    frames: DataFrame
    samples: DataFrame
    edges: DataFrame
    body: str = "lidar"


def compensated(points: DataFrame, move: Motion | None, cfg: Config = BATCH) -> DataFrame:
    """Points at their frame's time, where that is asked for and something is known of the motion."""
    if move is None or not cfg.use_deskewing:
        return points
    return deskew_points(points, move.frames, frame_motion(move.frames, move.edges, move.body, cfg), move.samples, cfg).drop("moved")


def obstacles(points: DataFrame, cfg: Config = BATCH, move: Motion | None = None) -> DataFrame:
    left = remove_ground(compensated(prepared(points, cfg), move, cfg), cfg).filter("label = 'obstacle'").drop("label")
    return voxel_downsample(left, cfg.voxel_size) if cfg.use_voxel_filter else left


def clustered(points: DataFrame, cfg: Config = BATCH, move: Motion | None = None) -> DataFrame:
    """Members of merged clusters."""
    return merge_clusters(cluster(obstacles(points, cfg, move), cfg, keep=("x", "y", "z", "intensity")), cfg)


def cluster_table(points: DataFrame, cfg: Config = BATCH, move: Motion | None = None) -> DataFrame:
    """Features, reason and confidence of every merged cluster: the cluster log."""
    return classify(features(clustered(points, cfg, move)), cfg)


def cones(points: DataFrame, cfg: Config = BATCH, move: Motion | None = None) -> DataFrame:
    """Truncated points, compensated for motion, without ground, in clusters, judged, and one of each place."""
    return aggregate_duplicates(accepted(cluster_table(points, cfg, move)), cfg).withColumn("color", F.lit("UNKNOWN"))
