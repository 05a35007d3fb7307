"""Log analytics, sources and sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import analytics as an
from ..plans import pipeline as pl
from ..schema import PHASES
from ..sources import fixtures as fx
from ..sources import readers, sinks
from .q_points import rounded
from .twin import twin

C = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir. Where none is set it is a local one if all tasks run
    on this machine; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{next(tempfile._get_candidate_names())}" if base else tempfile.mkdtemp(prefix="scanweave-")


def simple(name: str, f, sql: str, source=fx.profiles, table: str = "profiles", digits: int = 6) -> None:
    query(name, twin(sql, table))(lambda spark, sf: rounded(f(source(spark, sf)), digits))


Q = "quantile_cont({0}, {1})"
simple("latency_stats", an.latency_stats, "select algorithm, round(avg(total_ms), 6) as mean_ms, round(quantile_cont(total_ms, 0.5), 6) as median_ms, round(quantile_cont(total_ms, 0.95), 6) as p95_ms, round(quantile_cont(total_ms, 0.99), 6) as p99_ms, round(max(total_ms), 6) as max_ms, round(count(*) filter (total_ms > 50) * 1e2 / count(*), 6) as over_50ms_pct, round(count(*) filter (total_ms > 20) * 1e2 / count(*), 6) as over_20ms_pct from profiles group by algorithm")
simple("phase_avg", an.phase_avg, "select algorithm, " + ", ".join(f"round(avg({p}), 6) as {p}" for p in PHASES) + " from profiles group by algorithm")
simple("phase_p99", an.phase_p99, "select algorithm, " + ", ".join(f"round(quantile_cont({p}, 0.99), 6) as {p}" for p in PHASES) + " from profiles group by algorithm")
simple(
    "boxplot_stats",
    an.boxplot_stats,
    """, b as (select algorithm, quantile_cont(total_ms, 0.25) as q1, quantile_cont(total_ms, 0.5) as median, quantile_cont(total_ms, 0.75) as q3 from profiles group by algorithm),
    n as (select p.algorithm, q1, median, q3, total_ms as v, total_ms between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1) as near from profiles p join b using (algorithm))
    select algorithm, round(max(q1), 6) as q1, round(max(median), 6) as median, round(max(q3), 6) as q3, round(min(v) filter (near), 6) as low_whisker, round(max(v) filter (near), 6) as high_whisker, count(*) filter (not near) as outliers from n group by algorithm""",
)
simple("histogram", an.histogram, "select algorithm, floor(total_ms / 10e0) * 10e0 as bin_from, count(*) as n from profiles group by all")
simple("density", an.density, ", g as (select unnest(range(0, 21)) * 200e0 / 20 as at_) select algorithm, at_ as \"at\", round(sum(exp(-0.5e0 * ((at_ - total_ms) / 10e0) * ((at_ - total_ms) / 10e0))) / (count(*) * 10e0 * 2.5066282746310002e0), 9) as density from profiles, g group by all", digits=9)
simple("deskew_summary", an.deskew_summary, "select algorithm, round(avg(deskew_avg_translation_m) * 1e2, 6) as avg_cm, round(avg(deskew_max_translation_m) * 1e2, 6) as mean_max_cm, round(max(deskew_max_translation_m) * 1e2, 6) as worst_cm from profiles group by algorithm")
simple("melt", an.deskew_frequency, "select algorithm, frame_id, '10Hz (Measured)' as frequency, round(deskew_max_translation_m * 1e2, 6) as displacement_cm from profiles union all select algorithm, frame_id, '20Hz (Simulated/Estimated)', round(deskew_max_translation_m * 0.5e0 * 1e2, 6) from profiles")
simple("deskew_series", an.deskew_series, "select algorithm, frame_id, round(deskew_max_translation_m * 1e2, 6) as max_cm, round(deskew_avg_translation_m * 1e2, 6) as avg_cm from profiles")
simple("stability_series", an.stability_series, "select algorithm, frame_id, cones_detected from profiles")


def _named(df: DataFrame) -> DataFrame:
    name = F.when(C("algorithm") == "click", "grid_patchworkpp").when(C("algorithm") == "view", "grid_bin_based").otherwise(F.concat(C("algorithm"), F.lit("_patchworkpp")))
    return df.select(name.alias("algorithm"), "frame_id", "total_ms")


simple(
    "phase_split",
    lambda df: an.phase_split(_named(df)),
    """, n as (select case algorithm when 'click' then 'grid_patchworkpp' when 'view' then 'grid_bin_based' else algorithm || '_patchworkpp' end as a, frame_id, total_ms from profiles)
    select upper(replace(a, '_patchworkpp', '')) as algorithm, frame_id, round(total_ms, 6) as total_ms, 'clustering' as comparison from n where contains(a, '_patchworkpp')
    union all select upper(replace(a, 'grid_', '')), frame_id, round(total_ms, 6), 'ground' from n where starts_with(a, 'grid_')""",
)
simple("log_union", lambda df: df.filter("frame_id % 2 = 0").select("algorithm", "frame_id").unionByName(df.filter("frame_id % 2 = 1").select("algorithm", "frame_id", "total_ms"), allowMissingColumns=True), "select algorithm, frame_id, case when frame_id % 2 = 1 then round(total_ms, 6) end as total_ms from profiles")

LOG = {"source": fx.cluster_log, "table": "log"}
_BIN = "case when range >= 0 and range <= 5 then '0-5m' when range > 5 and range <= 10 then '5-10m' when range > 10 and range <= 15 then '10-15m' when range > 15 and range <= 20 then '15-20m' when range > 20 and range <= 25 then '20-25m' end"
simple("status_flag", lambda df: an.tagged(df).select("cluster_id", "status"), "select cluster_id, case when confidence > 0.5 then 'Detected' else 'Rejected' end as status from log", **LOG)
simple("distance_bins", lambda df: an.tagged(df).select("cluster_id", "distance_bin"), f"select cluster_id, {_BIN} as distance_bin from log", **LOG)
simple(
    "feature_stats",
    an.feature_stats,
    " union all ".join(f"select '{f}' as feature, round(min({f}::double), 6) as min, round(quantile_cont({f}::double, 0.05), 6) as q05, round(avg({f}), 6) as mean, round(quantile_cont({f}::double, 0.5), 6) as median, round(quantile_cont({f}::double, 0.95), 6) as q95, round(max({f}::double), 6) as max from log where confidence > 0.5" for f in an.FEATURES),
    **LOG,
)
simple("dist_bin_stats", an.dist_bin_stats, f"select {_BIN} as distance_bin, count(*) as n, min(point_count) as min_points, round(quantile_cont(point_count::double, 0.05), 6) as q05_points, round(avg(point_count), 6) as mean_points, max(point_count) as max_points from log where confidence > 0.5 and range <= 25 group by 1", **LOG)
_TUNE = f"""select algorithm, round(greatest(0.05e0, quantile_cont(height, 0.01) * 0.9e0), 6) as min_height, round(least(1e0, quantile_cont(height, 0.99) * 1.1e0), 6) as max_height, round(least(0.6e0, quantile_cont(width_max, 0.99) * 1.1e0), 6) as max_width,
  round(least(0.95e0, quantile_cont(linearity, 0.99) + 0.02e0), 6) as max_linearity, round(greatest(0.5e0, quantile_cont(verticality, 0.01) - 0.02e0), 6) as min_verticality,
  greatest(3, cast(floor(quantile_cont(point_count::double, 0.05) filter ({_BIN} = '10-15m')) as int)) as min_points_at_10m from log where confidence > 0.5 group by algorithm"""
simple("tuning_report", an.tuning_report, _TUNE, **LOG)
simple("rejection_pivot", an.rejection_pivot, "select algorithm, " + ", ".join(f'count(*) filter (rejection_reason = \'{k}\') as "{k}"' for k in an.REASONS) + " from log where confidence <= 0.5 group by algorithm", **LOG)
ORACLES.update({k: v.replace("\n,", ",") for k, v in ORACLES.items()})


@query("config_join", twin("select t.algorithm, t.cluster_id, c.max_linearity from log t join (values ('Grid', 0.88e0), ('Dbscan', 0.9e0)) c(algorithm, max_linearity) using (algorithm)", "log"))
def config_join(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster rows with a value in force, of the algorithms that have a config."""
    cfgs = spark.createDataFrame([("Grid", DEFAULT.to_json()), ("Dbscan", DEFAULT.override(pca_max_linearity=0.9).to_json())], "algorithm string, config string")
    values = cfgs.select("algorithm", F.get_json_object("config", "$.pca_max_linearity").cast("double").alias("max_linearity"))
    return fx.cluster_log(spark, sf).join(values, "algorithm").select("algorithm", "cluster_id", "max_linearity")


# ---- sources and sinks, each written and read back


def _profiles_there(spark: SparkSession, sf: str) -> str:
    path = scratch(spark)
    sinks.write_profile_files(fx.profiles(spark, sf), path)
    return path


_PROFILE = "select algorithm, frame_id, round(total_ms, 3) as total_ms, cones_detected from profiles"


@query("src_json_profiles", twin(_PROFILE, "profiles"))
def src_json_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readers.json_profiles(spark, _profiles_there(spark, sf)).select("algorithm", "frame_id", "total_ms", "cones_detected"))


@query("src_json_deskew", twin("select algorithm, frame_id, round(deskew_avg_translation_m, 5) as deskew_avg_translation_m from profiles", "profiles"))
def src_json_deskew(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readers.json_deskew(spark, _profiles_there(spark, sf)).select("algorithm", "frame_id", "deskew_avg_translation_m"))


@query("snk_profile_json", twin("select algorithm, count(*) as frames, round(sum(round(total_ms, 3)), 3) as total_ms from profiles group by algorithm", "profiles"))
def snk_profile_json(spark: SparkSession, sf: str) -> DataFrame:
    from ..schema import PROFILE

    docs = sinks.profile_documents(fx.profiles(spark, sf)).select(F.from_json("value", PROFILE).alias("d"))
    ms = F.aggregate("d.raw_frames", F.lit(0.0), lambda s, f: s + f["total_ms"])
    return docs.select(C("d.metadata.algorithm").alias("algorithm"), C("d.metadata.total_frames").cast("long").alias("frames"), F.round(ms, 3).alias("total_ms"))


_CSV = 'select cast(frame_id as int) as frame_id, cluster_id, cast(point_count as int) as point_count, round(height, 4) as height, rejection_reason from "table"'


def _clusters_there(spark: SparkSession, sf: str) -> str:
    path = scratch(spark)
    sinks.write_clusters(pl.cluster_table(fx.points(spark, sf)), f"{path}/clusters_grid.csv")
    return path


@query("snk_cluster_csv", twin(_CSV, "table"))
def snk_cluster_csv(spark: SparkSession, sf: str) -> DataFrame:
    from ..schema import CLUSTERS

    rows = spark.read.schema(CLUSTERS).option("header", True).csv(_clusters_there(spark, sf) + "/clusters_grid.csv")
    return rows.select("frame_id", "cluster_id", "point_count", "height", "rejection_reason")


@query("src_csv_clusters", twin("select 'Grid' as algorithm, count(*) as n, count(*) filter (confidence > 0.5) as detected from \"table\"", "table"))
def src_csv_clusters(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    sinks.cluster_rows(pl.cluster_table(fx.points(spark, sf))).coalesce(1).write.option("header", True).csv(path + "/log")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path + "/log")
    fs = folder.getFileSystem(conf)
    for f in fs.listStatus(folder):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(path + "/log/clusters_grid.csv"))
    return readers.csv_clusters(spark, path + "/log").groupBy("algorithm").agg(F.count("*").alias("n"), F.count_if(C("confidence") > 0.5).alias("detected"))


@query("src_config", "select 64 as n, 0.12e0 as grid_resolution, 'grid' as clustering_algorithm")
def src_config(spark: SparkSession, sf: str) -> DataFrame:
    import dataclasses

    from ..config import Config

    cfg = Config.from_session(spark)
    n = len([f for f in dataclasses.fields(cfg) if f.name != "gravity_sign"])
    return spark.createDataFrame([(n, cfg.grid_resolution, cfg.clustering_algorithm)], "n int, grid_resolution double, clustering_algorithm string")


@query("snk_config_json", "select 25e0 as max_range, 'y' as world_up_axis, true as use_deskewing")
def snk_config_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark) + "/config_grid"
    sinks.write_config(spark, DEFAULT, path)
    return spark.read.schema("max_range double, world_up_axis string, use_deskewing boolean").json(path)


@query("src_lidar", twin("select frame_id, count(*) as n, round(sum(z), 4) as z from points group by frame_id", "points"))
def src_lidar(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark) + "/sweeps"
    fx.points(spark, sf).drop("o").write.parquet(path)
    return readers.lidar(spark, path).groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("z"))


@query("src_bag", twin("select count(*) as n from points", "points"))
def src_bag(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark) + "/sweeps"
    fx.points(spark, sf).drop("o").write.parquet(path)
    return readers.replay(spark, path).unionByName(readers.replay(spark, "")).agg(F.count("*").alias("n"))


@query("src_imu", twin("select seq, ts_ns, round(wz, 6) as wz from imu", "imu"))
def src_imu(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark) + "/imu"
    fx.imu(spark, sf).write.parquet(path)
    return rounded(readers.imu(spark, path).select("seq", "ts_ns", "wz"))


_ROUND = ", ".join(f"round({c}, 6) as {c}" for c in "xyz")


@query("snk_cones", twin(f"select frame_id, cluster_id, {_ROUND}, round(range, 6) as intensity from final", "final"))
def snk_cones(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sinks.cone_cloud(pl.cones(fx.points(spark, sf))))


@query("snk_cone_points", twin(f"select frame_id, point_idx, {_ROUND}, no as intensity from merged join (select frame_id, cluster_id, row_number() over (partition by frame_id order by cluster_id)::double as no from final) c using (frame_id, cluster_id)", "final"))
def snk_cone_points(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.points(spark, sf)
    return rounded(sinks.cone_points(pl.clustered(p), pl.cones(p)))


@query("snk_obstacles", twin(f"select frame_id, point_idx, {_ROUND}, round(intensity, 6) as intensity from merged", "merged"))
def snk_obstacles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sinks.obstacle_cloud(pl.clustered(fx.points(spark, sf))))


@query("snk_lidar_viz", twin(f"select frame_id, point_idx, {_ROUND} from norm", "norm"))
def snk_lidar_viz(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sinks.lidar_viz(pl.prepared(fx.points(spark, sf)).select("frame_id", "point_idx", "x", "y", "z")))


@query("snk_markers", twin("select ns, type, count(*) as n from (select 'cones' as ns, 'CYLINDER' as type from final union all select 'labels', 'TEXT' from final union all select unnest(['cones', 'labels']), 'DELETEALL' from (select distinct frame_id from final)) t group by all", "final"))
def snk_markers(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.markers(pl.cones(fx.points(spark, sf))).groupBy("ns", "type").agg(F.count("*").alias("n"))
