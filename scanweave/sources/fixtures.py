"""Sweeps, inertial samples, poses and latency logs projected from the driver's tables.

The texts run unchanged in Spark and in DuckDB, so queries and their SQL twins start from the same rows: coordinates are
multiples of 2^-20 m, so that the last bit of a sine changes none, sums are exact and zero has no sign, and ground points
lie 3 mm off the edges of the bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TF

_POINTS = """
select frame_id, point_idx, ring, o, cast(floor(x * 1048576e0 + 0.5e0) as bigint) / 1048576e0 as x, cast(floor(y * 1048576e0 + 0.5e0) as bigint) / 1048576e0 as y,
 cast(floor(z * 1048576e0 + 0.5e0) as bigint) / 1048576e0 as z, intensity
from (select frame_id, point_idx, cast(q as int) % 40 as ring, o,
 case when o >= 16 then gr * cos(ga) when kind = 2 then cr * cos(ca) + 0.03e0 * cos(az)
      when kind = 1 then cr * cos(ca) + 0.40e0 * (q / 50e0 - 0.5e0) else cr * cos(ca) + 0.114e0 * (1e0 - 0.8e0 * d) * cos(az) end as x,
 case when o >= 16 then gr * sin(ga) when kind = 2 then cr * sin(ca) + 0.03e0 * sin(az)
      when kind = 1 then cr * sin(ca) + 0.02e0 * t else cr * sin(ca) + 0.114e0 * (1e0 - 0.8e0 * d) * sin(az) end as y,
 case when o >= 16 then -0.52e0 + 0.1e0 * t when kind = 2 then -0.50e0 + 0.70e0 * d else -0.50e0 + 0.325e0 * d end as z,
 case when o = 12 then 2e0 else 20e0 + 500e0 * t end as intensity
from (
 select *, o % 4 as kind, 2e0 + o * 1.2e0 as cr, 6.283185307179586e0 * o / 16e0 as ca, 6.283185307179586e0 * q / 50e0 as az, {near} + 0.003e0 as gr,
  ((p * 7919e0) % 6283e0) / 1000e0 as ga
 from (
  select cast(floor(l_orderkey / 250) as bigint) as frame_id,
   row_number() over (partition by cast(floor(l_orderkey / 250) as bigint)
     order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as point_idx,
   cast(l_partkey % 25 as int) as o, l_quantity as q, l_extendedprice as p, l_discount * 10e0 as d, l_tax as t
  from lineitem) b) c) m
"""
POINTS = "select frame_id, cast(point_idx as bigint) as point_idx, ring, x, y, z, intensity, 1.7e9 + frame_id * 0.1e0 + (atan2(y, x) + pi()) / (2e0 * pi()) * 0.1e0 as timestamp from (" + _POINTS.format(near="1e0 + ((p * 100e0) % 2400e0) / 100e0") + ") f"
#: The same with ranges from 0 to 27 m, which reach the blind spot and pass the largest range.
WIDE_POINTS = POINTS.replace("1e0 + ((p * 100e0) % 2400e0) / 100e0", "((p * 100e0) % 2700e0) / 100e0")
IMU = """
select event_id as seq, 1700000000000000000 + event_id * 2500000 as ts_ns, cast(0 as double) as wx, cast(0 as double) as wy, ((event_id % 200) - 100) / 1e2 as wz,
 (value % 10e0 - 5e0) / 10e0 as ax, cast(-9.80665 as double) as ay, cast(0 as double) as az
from events
"""
POSES = """
select 1700000000000000000 + event_id * 2500000 as ts_ns, 10e0 * (event_id * 0.0025e0) as tx, sin(event_id * 0.0025e0) as ty, cast(0 as double) as tz,
 cast(0 as double) as qx, cast(0 as double) as qy, sin(0.1e0 * sin(event_id * 0.0025e0)) as qz, cos(0.1e0 * sin(event_id * 0.0025e0)) as qw
from events where event_id % 10 = 0
"""
#: Place of the inertial unit in the sensor's frame.
ARM = (0.3, 0.05, -0.1)
FRAMES = """
select distinct cast(floor(l_orderkey / 250) as bigint) as frame_id, 1700000000000000000 + cast(floor(l_orderkey / 250) as bigint) * 100000000 as header_ts_ns,
 1700000000000000000 + cast(floor(l_orderkey / 250) as bigint) * 100000000 - 20000000000 - (cast(floor(l_orderkey / 250) as bigint) % 7) * 1000000 as recv_ts_ns
from lineitem
"""
PROFILES = """
select event_type as algorithm, cast(event_id as int) as frame_id, value * 0.1e0 as conversion_ms, value * 0.2e0 as deskewing_ms, value * 0.15e0 as ground_removal_ms,
 value * 0.3e0 as clustering_ms, value * 0.05e0 as merging_ms, value * 0.15e0 as estimation_ms, value * 0.05e0 as duplicate_ms, value as total_ms,
 cast(user_id % 20 as int) as cones_detected, value / 1e3 as deskew_avg_translation_m, value / 5e2 as deskew_max_translation_m
from events
"""
#: A cluster log: shape features of parts, by brand as the clusterer.
CLUSTER_LOG = """
select case p_partkey % 3 when 0 then 'Grid' when 1 then 'Dbscan' else 'Euclidean' end as algorithm, cast(p_partkey as int) as cluster_id, cast(3 + p_size % 40 as int) as point_count,
 (p_retailprice * 7e0) % 27e0 as range, 0.05e0 + (p_retailprice % 70e0) / 1e2 as height, 0.05e0 + (p_retailprice % 45e0) / 1e2 as width_max, 5e0 + p_retailprice % 90e0 as avg_intensity,
 (p_retailprice % 88e0) / 1e2 as linearity, (p_retailprice % 71e0) / 1e2 as planarity, (p_retailprice % 33e0) / 1e2 as scattering, 0.6e0 + (p_retailprice % 40e0) / 1e2 as verticality,
 1e0 + (p_retailprice % 40e0) / 1e1 as symmetry, case when p_partkey % 5 < 3 then 1e0 else 0e0 end as confidence,
 case when p_partkey % 5 < 3 then 'NONE' when p_partkey % 2 = 0 then 'PCA_LINEARITY' when p_size % 2 = 0 then 'POINT_COUNT' else 'HEIGHT_LIMIT' end as rejection_reason
from part
"""


def _run(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"scanweave_{t}")
        text = text.replace(f"from {t}", f"from scanweave_{t}")
    return spark.sql(text)


def points(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """A filter on a computed column stays above `inline`: pushed into the text, it would work out sines anew in each of
    its comparisons, 66 cosines a row where truncation meets the text."""
    rows = _run(spark, sf_dir, WIDE_POINTS if wide else POINTS, "lineitem")
    own = [c for c in rows.columns if c != "frame_id"]
    return rows.select("frame_id", F.inline(F.array(F.struct(*own)))).select(*rows.columns)


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, IMU, "events")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, POSES, "events")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sensor moving in the world, and the inertial unit on it."""
    from ..config import DEFAULT
    from .tf import moving_transforms

    arm = spark.createDataFrame([("lidar", DEFAULT.imu_frame, 0, *ARM, 0.0, 0.0, 0.0, 1.0, True)], TF)
    return moving_transforms(poses(spark, sf_dir), "odom", "lidar").unionByName(arm)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FRAMES, "lineitem")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PROFILES, "events")


def cluster_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CLUSTER_LOG, "part")
