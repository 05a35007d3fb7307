"""Time and motion against plain versions: as-of joins, transforms over time, compensation, stream joins, neighbours."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanweave.config import DEFAULT
from scanweave.functions.rotation import matrix_of
from scanweave.operators import cluster, deskew, temporal
from scanweave.schema import TF
from scanweave.sources import tf
from scanweave.streaming import clock

SF = "/root/testdata/sf0.01"
EDGES = [
    ("odom", "base", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, False), ("odom", "base", 1000, 10.0, 0.0, 0.0, 0.0, 0.0, math.sin(0.4), math.cos(0.4), False),
    ("base", "lidar", 0, 1.0, 2.0, 0.0, 0.0, 0.0, math.sin(0.1), math.cos(0.1), True), ("lidar", "imu", 0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0, True),
]


def pose(r):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = matrix_of((r["qx"], r["qy"], r["qz"], r["qw"])), (r["tx"], r["ty"], r["tz"])
    return m


def about_z(angle, *t):
    m = np.eye(4)
    m[:2, :2] = [[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]
    m[:3, 3] = t
    return m


def test_as_of_against_plain(spark):
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 500, 60).tolist(), sorted(set(rng.integers(100, 400, 30).tolist()))
    l = spark.createDataFrame(list(enumerate(left)), "k bigint, t bigint")
    r = spark.createDataFrame([(t, t * 2) for t in right], "ts_ns bigint, v bigint")
    got = {x["k"]: (x["p_ts_ns"], x["p_v"], x["n_ts_ns"]) for x in temporal.as_of(l, r, "t", ["v"], bucket_ns=50).collect()}
    for k, t in enumerate(left):
        p, n = max((x for x in right if x <= t), default=None), min((x for x in right if x >= t), default=None)
        assert got[k] == (p, None if p is None else 2 * p, n)


def test_transforms_over_time(spark):
    edges = spark.createDataFrame(EDGES, TF)
    asked = spark.createDataFrame([(0, 0), (1, 250), (2, 1000), (3, 5000)], "frame_id bigint, t bigint")
    got = {r["frame_id"]: pose(r) for r in tf.lookup_at(asked, edges, "odom", "imu", "t").collect()}
    for k, a in ((0, 0.0), (1, 0.25), (2, 1.0), (3, 1.0)):  # past the last pose: the latest
        assert np.allclose(got[k], about_z(0.8 * a, 10 * a, 0, 0) @ about_z(0.2, 1, 2, 0) @ about_z(0.0, 0, 0, 0.5))
    back = {r["frame_id"]: pose(r) for r in tf.lookup_at(asked, edges, "imu", "odom", "t").collect()}
    assert all(np.allclose(back[k] @ got[k], np.eye(4)) for k in got)
    assert all(np.allclose(pose(r), np.eye(4)) for r in tf.lookup_at(asked, edges, "odom", "nowhere", "t").collect())
    static = tf.lookup([r for r in edges.filter("is_static").collect()], "base", "imu")
    assert np.allclose(pose(tf.lookup_at(asked, edges, "base", "imu", "t").first()), static)


def setting(spark, samples):
    points = spark.createDataFrame([(0, 0, 10.0, 0.0, 0.0, 0.05, 1), (0, 1, 10.0, 1.0, float("nan"), 0.05, 1), (0, 2, 1.0, 2.0, 3.0, 9.0, 1), (7, 0, 1.0, 1.0, 1.0, 0.0, 1)], "frame_id bigint, point_idx bigint, x double, y double, z double, timestamp double, ring int")
    frames = spark.createDataFrame([(0, 0)], "frame_id bigint, header_ts_ns bigint")
    moves = spark.createDataFrame([(0, 0, 0.0, 2.0, 0.0, 0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4), 0.5, 0.0, 0.0)], "frame_id bigint, header_ts_ns bigint, vx double, vy double, vz double, qx double, qy double, qz double, qw double, lx double, ly double, lz double")
    imu = spark.createDataFrame(samples, "ts_ns bigint, wx double, wy double, wz double, ax double, ay double, az double")
    return {(r["frame_id"], r["point_idx"]): r for r in deskew.deskew_points(points, frames, moves, imu).collect()}


def test_motion_without_samples_stays(spark):
    got = setting(spark, [])
    assert len(got) == 4 and all(r["moved"] is None for r in got.values()) and got[0, 0]["x"] == 10.0


def test_motion_with_too_few_samples_in_the_window(spark):
    # one sample before the window: its rate of turn holds; the world's y is the sensor's x here
    got = setting(spark, [(-10**9, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0)])
    r = got[0, 0]
    angle = 0.05  # about the sensor's z, for 50 ms
    want = np.array([9.5 * np.cos(angle) + 0.5 + 0.05 * 2.0, 9.5 * np.sin(angle), 0.0])
    assert np.allclose([r["x"], r["y"], r["z"]], want) and np.isclose(r["moved"], np.linalg.norm(want - [10, 0, 0]))
    assert got[0, 1]["moved"] is None and np.isnan(got[0, 1]["z"])  # not finite
    assert got[0, 2]["moved"] is None and got[0, 2]["x"] == 1.0  # too far in time
    assert got[7, 0]["moved"] is None  # no such frame


def test_motion_at_constant_speed(spark):
    # gravity lies along the world's -y, which is the sensor's -x; proper acceleration cancels it
    still = [(k * 2_500_000, 0.0, 0.0, 0.0, -9.80665, 0.0, 0.0) for k in range(-40, 41)]
    r = setting(spark, still)[0, 0]
    assert np.allclose([r["x"], r["y"], r["z"]], [10.0 + 0.05 * 2.0, 0.0, 0.0])


def test_nearest_against_plain():
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 1, (2500, 3)), rng.normal(30, 8, (100, 3))])
    idx, dist = cluster.nearest(xyz, 8)
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    np.fill_diagonal(d, -1.0)
    want = np.argsort(d, axis=1, kind="stable")[:, :8]
    assert (idx == want).all() and np.allclose(dist, np.sqrt(np.maximum(np.take_along_axis(d, want, 1), 0)))


def test_samples_around_sweeps_in_a_stream(spark, tmp_path):
    at = lambda ms: F.timestamp_millis(F.lit(1_700_000_000_000) + ms)
    spark.range(0, 4000, 100).select(F.col("id").alias("frame_id"), at(F.col("id")).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "f"))
    spark.range(0, 4000, 10).select(F.col("id").alias("seq"), at(F.col("id")).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "s"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    met = clock.windowed_imu(read("f"), read("s")).select("f.frame_id", "s.seq")
    met.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {(f, s) for f in range(0, 4000, 100) for s in range(0, 4000, 10) if abs(f - s) <= 150}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
@pytest.mark.parametrize("name", ["polar_bin_key", "bin_min_join", "cell_min_z", "radial_sort", "frame_motion", "deskew_integrate", "deskew_points", "deskew_metrics", "pipeline_cones", "trajectory_asof"])
def test_twin_on_more_rows(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    norm = lambda v: 0.0 if v == 0 else round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=str)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(map(norm, r)) for r in want), key=str)


def test_unset_motion_is_left_out(spark):
    from scanweave.plans import pipeline

    assert pipeline.compensated("points", None) == "points" and pipeline.compensated("points", object(), DEFAULT.override(use_deskewing=False)) == "points"
