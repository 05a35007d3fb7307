"""The engine against SQL twins and hand-made cases."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanweave import schema
from scanweave.config import DEFAULT, Config
from scanweave.functions import rotation as rot
from scanweave.operators import cluster as cl
from scanweave.operators import deskew, features, greedy, ground, joins, temporal
from scanweave.operators.analytics import distance_bin
from scanweave.operators.decode import decode
from scanweave.operators.frames import nearest_within
from scanweave.plans import pipeline
from scanweave.sources import fixtures, readers, sinks
from scanweave.streaming import clock, detect

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Twins that are run here; all of them are run by the driver.
TWINS = (
    "point_timestamp", "intensity_norm", "polar_bin_key", "dbscan_cell_key", "spatial_truncate", "ground_bin", "ground_slope", "cluster_grid", "cluster_voxel", "cluster_dbscan", "cluster_euclidean", "merge_clusters",
    "eig3_features", "mean_cov", "cone_rules", "pipeline_cones", "radius_join", "range_image_neighbour", "imu_window_join", "imu_interp", "velocity_ols", "imu_clamp", "clock_offset_ema", "latency_stats", "boxplot_stats", "feature_stats", "tuning_report",
    "rejection_pivot", "src_json_profiles", "snk_markers",
)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    norm = lambda v: 0.0 if v == 0 else round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(norm(r[k]) for k in at) for r in rel.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def points(spark, rows):
    return spark.createDataFrame([(0, k, *r) for k, r in enumerate(rows)], "frame_id bigint, point_idx bigint, x double, y double, z double, intensity double, ring int")


def labels(df):
    return {r["point_idx"]: r["cluster_id"] for r in df.collect()}


def test_truncation_drops_what_is_not_finite(spark):
    p = points(spark, [(1.0, 0.0, 0.0, 1.0, 0), (0.1, 0.0, 0.0, 1.0, 0), (26.0, 0.0, 0.0, 1.0, 0), (1.0, 0.0, math.nan, 1.0, 0), (math.inf, 0.0, 0.0, 1.0, 0), (1.0, 1.0, math.inf, 1.0, 0), (0.25, 0.0, 99.0, 1.0, 0)])
    assert [r["point_idx"] for r in ground.spatial_truncate(p).collect()] == [0, 6]


def test_bin_ground_has_no_class_inside_the_ring(spark):
    p = points(spark, [(0.4, 0.0, 0.0, 1.0, 0), (2.0, 0.0, -0.48, 1.0, 0), (2.0, 0.001, -0.30, 1.0, 0), (2.0, 0.002, -0.47, 1.0, 0)])
    assert {r["point_idx"]: r["label"] for r in ground.ground_bin(p).collect()} == {1: "ground", 2: "obstacle", 3: "ground"}


def test_greedy_is_not_transitive_and_ordered(spark):
    c = spark.createDataFrame([(0, k, x, 0.0) for k, x in enumerate((0.0, 0.2, 0.4, 0.65, 5.0))], "frame_id bigint, cluster_id int, cx double, cy double")
    assert {r["cluster_id"]: r["seed_id"] for r in greedy.seeds_of(c, 0.25).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_dbscan_border_goes_to_the_first_cluster(spark):
    p = points(spark, [(x, 0.0, 0.0, 1.0, 0) for x in (0.0, 0.1, 0.2, 0.78, 0.88, 0.98, 0.49)])
    got = labels(cl.cluster_dbscan(p, DEFAULT.override(dbscan_min_pts=4)))
    assert got == {0: 0, 1: 0, 2: 0, 6: 0, 3: 1, 4: 1, 5: 1}
    out = points(spark, [(0.0, 0.0, 5.0, 1.0, 0), (0.0, 0.0, 5.1, 1.0, 0), (0.0, 0.0, 0.0, 1.0, 0), (0.1, 0.0, 0.0, 1.0, 0), (0.2, 0.0, 0.0, 1.0, 0)])
    assert labels(cl.cluster_dbscan(out)) == {2: 0, 3: 0, 4: 0}


def test_depth_ignores_rings_outside_the_image(spark):
    p = points(spark, [(5.0, 0.0, 0.0, 1.0, 10), (5.0, 0.03, 0.0, 1.0, 10), (5.0, 0.0, 0.1, 1.0, 40), (5.0, 0.0, 0.1, 1.0, -1)])
    assert labels(cl.cluster_depth(p, DEFAULT.override(min_cluster_size=1))) == {0: 0, 1: 0}


def test_hdbscan_respects_the_cap(spark):
    rng = np.random.default_rng(1)
    p = points(spark, [(*map(float, rng.normal(0, 0.2, 3)), 1.0, 0) for _ in range(60)])
    sizes = np.bincount(list(labels(cl.cluster_hdbscan(p, most=20)).values()))
    assert sizes.max() <= 20


def test_euclidean_thins_large_frames(spark):
    rng = np.random.default_rng(2)
    p = points(spark, [(*map(float, rng.uniform(0, 0.3, 3)), 1.0, 0) for _ in range(5100)])
    assert cl.cluster_euclidean(p, DEFAULT.override(max_cluster_size=10_000)).count() < 1000


def test_physical_order_does_not_matter(spark):
    p = entry.queries()["voxel_downsample"](spark, SF).select("frame_id", "point_idx", "x", "y", "z")
    a, b = (sorted(map(tuple, cl.cluster_grid(d).collect())) for d in (p, p.orderBy(F.rand(3)).repartition(7)))
    assert a == b


CASES = {
    "EARLY_AABB": dict(height=0.05), "POINT_COUNT": dict(point_count=2, verticality=0.7), "LOW_INTENSITY": dict(avg_intensity=1.0), "PCA_LINEARITY": dict(linearity=0.9), "PCA_PLANARITY": dict(planarity=0.95), "PCA_SCATTER": dict(scattering=0.001),
    "VERTICALITY": dict(verticality=0.5), "HEIGHT_LIMIT": dict(height=0.09), "WIDTH_LIMIT": dict(width_max=0.6), "ASPECT_RATIO": dict(aspect_ratio=3.0), "SYMMETRY": dict(symmetry=6.0), "NONE": {},
}


def test_every_rule(spark):
    base = dict(point_count=50, range=5.0, height=0.3, width_max=0.2, avg_intensity=20.0, linearity=0.5, planarity=0.3, scattering=0.1, verticality=0.9, aspect_ratio=0.7, symmetry=1.2)
    rows = [(k, *(base | c).values()) for k, c in CASES.items()]
    df = spark.createDataFrame(rows, "name string, point_count bigint, range double, height double, width_max double, avg_intensity double, linearity double, planarity double, scattering double, verticality double, aspect_ratio double, symmetry double")
    for r in features.classify(df).collect():
        assert r["rejection_reason"] == r["name"] and r["confidence"] == float(r["name"] == "NONE")
    one = features.classify(df.filter("name = 'NONE'").withColumn("point_count", F.lit(1).cast("bigint"))).first()
    assert (one["point_count"], one["rejection_reason"], one["confidence"]) == (0, "NONE", 0.0)
    zero = features.classify(df.filter("name = 'NONE'").withColumn("range", F.lit(0.0))).first()
    assert zero["rejection_reason"] == "NONE"


def test_distance_bins_are_right_closed(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (5.0,), (5.1,), (25.0,), (25.1,)], "r double").select(distance_bin(F.col("r"))).collect()]
    assert got == ["0-5m", "0-5m", "5-10m", "20-25m", None]


def test_deskew_at_rest_and_at_constant_speed():
    ts = np.arange(0, 100_000_000, 2_500_000)
    zero, g = np.zeros((len(ts), 3)), np.array([0.0, -9.80665, 0.0])
    still = np.tile(deskew.AXES.T @ g, (len(ts), 1))
    q, x = deskew.integrate(ts, zero, still, 50_000_000, np.zeros(3), np.zeros(3), g)
    assert np.allclose(q, [0, 0, 0, 1]) and np.allclose(x, 0)
    q, x = deskew.integrate(ts, zero, still, 50_000_000, np.array([10.0, 0, 0]), np.zeros(3), g)
    assert np.allclose(x[:, 0], (ts - 50_000_000) / 1e8)


def test_rotations_agree():
    m = rot.euler_matrix(10, 20, 30)
    assert np.allclose(rot.matrix_of(rot.quaternion_of(m)), m) and np.allclose(m @ m.T, np.eye(3))


def test_clock_never_moves_from_a_small_start(spark):
    rows = [(1, 0, 5, 0), (1, 1, 10**11, 0), (2, 0, 2 * 10**10, 0), (2, 1, 3 * 10**10, 0)]
    got = {(r["sensor"], r["seq"]): r["offset"] for r in temporal.clock_offsets(spark.createDataFrame(rows, "sensor bigint, seq bigint, raw_ns bigint, ref_ns bigint")).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (2, 0): 2 * 10**10, (2, 1): int(0.995 * 2e10 + 0.005 * 3e10)}


def test_decode(spark):
    raw = np.array([[1, 2, 3, 4], [5, 6, 7, 8]], "<f4").tobytes()
    d = spark.createDataFrame([(0, bytearray(raw)), (1, None)], "frame_id bigint, data binary")
    assert [tuple(r) for r in decode(d).collect()] == [(0, 0, 1.0, 2.0, 3.0, 4.0), (0, 1, 5.0, 6.0, 7.0, 8.0)]


def test_config():
    assert Config(world_up_axis=True).world_up_axis == "y"
    for bad in (dict(world_up_axis=False), dict(grid_resolution=0.0)):
        with pytest.raises(ValueError):
            Config(**bad)
    with pytest.raises(ValueError):
        DEFAULT.override(no_such=1)
    for f, cfg in ((cl.cluster, DEFAULT.override(clustering_algorithm="x")), (ground.remove_ground, DEFAULT.override(ground_remover_type="x"))):
        with pytest.raises(ValueError):
            f(None, cfg)


def test_streaming(spark, tmp_path):
    from scanweave.sources import fixtures, readers, sinks

    p = fixtures.points(spark, SF).drop("o")
    p.repartition(1).write.parquet(str(tmp_path / "in"))
    detect.start_detection(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == entry.queries()["pipeline_cones_still"](spark, SF).count()


def test_clock_stream(spark, tmp_path):
    rows = [(s, k, 3 * 10**10 * s + k * 7919 % 5000, 0) for s in (0, 1) for k in range(40)]
    d = spark.createDataFrame(rows, "sensor bigint, seq bigint, raw_ns bigint, ref_ns bigint")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = clock.offsets_stream(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, temporal.clock_offsets(d).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("sensor", "seq", "offset").collect())) == want


def test_nearest_moves_points_once(spark):
    """Copies, ties, clusters and far points against all pairs; the plan deals points once and joins nothing."""
    rng = np.random.default_rng(0)
    rows = np.concatenate([np.repeat(rng.normal(0, 5, (3, 3)), 12, 0), np.round(rng.normal(0, 1, (40, 3)), 1), [[25.0, 25, 1], [-25, 3, 1]]])
    df = joins.nearest_neighbours(points(spark, [(*map(float, r), 1.0, 0) for r in rows]), 8, 0.15)
    d2 = lambda a, b: -1.0 if a == b else sum((rows[a][c] - rows[b][c]) ** 2 for c in range(3))
    want = {(a, r): b for a in range(len(rows)) for r, b in enumerate(sorted(range(len(rows)), key=lambda b: (d2(a, b), b))[:8])}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert {(r["point_idx"], r["rank"]): r["nbr"] for r in df.collect()} == want
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange ") == 1


@pytest.mark.parametrize("most", [1, 60, 1 << 20])
@pytest.mark.parametrize("spread", [0.0, 0.01, 1.0, 30.0])
def test_nearest_within(spread, most):
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.normal(0, spread, (50, 3)), [[1e9, 0, 0]]])
    d2 = ((xyz[:, None] - xyz) ** 2).sum(2)
    np.fill_diagonal(d2, -1.0)
    i, j, rank, _ = nearest_within(xyz, 5, 0.15, most)
    assert sorted(zip(i, rank, j, strict=True)) == [(a, r, b) for a in range(51) for r, b in enumerate(np.lexsort((np.arange(51), d2[a]))[:5])]


def test_filters_do_not_repeat_the_text_of_points(spark):
    plan = pipeline.obstacles(fixtures.points(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "COS(" in x]


def profile_log(spark, rows):
    cols = [f"0.5D as {p}" for p in schema.PHASES]
    return spark.createDataFrame(rows, "algorithm string, frame_id int, deskew_avg_translation_m double").selectExpr("*", *cols, "1.25D as total_ms", "frame_id % 3 as cones_detected", "1D as deskew_max_translation_m")


def test_profile_files_are_bounded_and_whole(spark, tmp_path):
    """Each document has so many frames at most, names need no care, and readers get every row of runs with displacements."""
    rows = [(name, k, None if name == "still" else k / 8) for name in ("grid", 'a "b" \\ }\n', "still") for k in range(25)]
    sinks.write_profile_files(profile_log(spark, rows).repartition(3), str(tmp_path / "p"), 4)
    got = readers.json_profiles(spark, str(tmp_path / "p"))
    assert sorted((r["algorithm"], r["frame_id"]) for r in got.collect()) == sorted(r[:2] for r in rows)
    docs = [json.loads(gzip.decompress(f.read_bytes())) for f in (tmp_path / "p").glob("profiler_*.json.gz")]
    assert {len(d["raw_frames"]) - d["metadata"]["total_frames"] for d in docs} == {0} and max(len(d["raw_frames"]) for d in docs) == 4
    assert sorted(tuple(r) for r in readers.json_deskew(spark, str(tmp_path / "p")).select("algorithm", "frame_id", "deskew_avg_translation_m").collect()) == sorted(r for r in rows if r[2] is not None)


@pytest.mark.parametrize("name", ["src_json_deskew", "src_json_profiles"])
def test_documents_stay_off_the_driver(spark, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame

    def no(*_, **__):
        raise AssertionError("documents go to the driver")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", no)
        m.setattr(DataFrame, "collect", no)
        df = entry.queries()[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_profiles_without_an_algorithm_are_read_and_bad_files_are_not(spark, tmp_path):
    rows = [(None, 0, 0.5), ("null", 1, 0.5), (None, 2, None), ("", 3, 0.5)]
    sinks.write_profile_files(profile_log(spark, rows), str(tmp_path / "p"))
    for k, text in enumerate(("", "{", "[]", '{"raw_frames": [{"frame_id": 9}]}', '{"metadata": 3, "raw_frames": [{"frame_id": 9}]}')):
        (tmp_path / "p" / f"profiler_bad{k}.json").write_text(text)
    got = readers.json_profiles(spark, str(tmp_path / "p")).select("algorithm", "frame_id", "deskew_avg_translation_m")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("name", ["src_json_deskew", "src_json_profiles"])
def test_twin_with_events_of_no_type(spark, tmp_path, name):
    import duckdb

    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_type", F.expr("if(event_id % 7 = 0, null, event_type)")).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=str)
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(c.sql(entry.oracle_sql()[name]).fetchall(), key=str)
