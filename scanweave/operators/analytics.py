"""Analytics of latency logs, cluster logs and motion compensation: plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE
from ..schema import PHASES

C = F.col
BUDGETS_MS = (50, 20)
FEATURES = ("point_count", "height", "width_max", "avg_intensity", "linearity", "planarity", "scattering", "verticality", "symmetry")


def q(c: str | Column, p: float) -> Column:
    """Exact quantile, linear between ranks."""
    return F.percentile(c, p)


def latency_stats(log: DataFrame) -> DataFrame:
    over = [(F.count_if(C("total_ms") > b) * 100.0 / F.count("*")).alias(f"over_{b}ms_pct") for b in BUDGETS_MS]
    return log.groupBy("algorithm").agg(F.avg("total_ms").alias("mean_ms"), q("total_ms", 0.5).alias("median_ms"), q("total_ms", 0.95).alias("p95_ms"), q("total_ms", 0.99).alias("p99_ms"), F.max("total_ms").alias("max_ms"), *over)


def phase_avg(log: DataFrame) -> DataFrame:
    return log.groupBy("algorithm").agg(*(F.avg(p).alias(p) for p in PHASES))


def phase_p99(log: DataFrame) -> DataFrame:
    return log.groupBy("algorithm").agg(*(q(p, 0.99).alias(p) for p in PHASES))


def boxplot_stats(log: DataFrame, value: str = "total_ms") -> DataFrame:
    """Quartiles and the whiskers: the last values within 1.5 interquartile ranges."""
    box = log.groupBy("algorithm").agg(q(value, 0.25).alias("q1"), q(value, 0.5).alias("median"), q(value, 0.75).alias("q3"))
    near = C(value).between(C("q1") - 1.5 * (C("q3") - C("q1")), C("q3") + 1.5 * (C("q3") - C("q1")))
    return log.join(F.broadcast(box), "algorithm").groupBy("algorithm").agg(  # one row per algorithm of a benchmark sweep
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min(F.when(near, C(value))).alias("low_whisker"), F.max(F.when(near, C(value))).alias("high_whisker"), F.count_if(~near).alias("outliers")
    )


def histogram(log: DataFrame, value: str = "total_ms", width: float = 10.0) -> DataFrame:
    return log.groupBy("algorithm", (F.floor(C(value) / width) * width).alias("bin_from")).agg(F.count("*").alias("n"))


def density(log: DataFrame, value: str = "total_ms", steps: int = 20, bandwidth: float = 10.0, top: float = 200.0) -> DataFrame:
    """Gaussian kernel density per algorithm on a fixed grid, for violin and density figures."""
    grid = F.array(*(F.lit(top * k / steps) for k in range(steps + 1)))
    u = (C("at") - C(value)) / bandwidth
    return log.select("algorithm", value, F.explode(grid).alias("at")).groupBy("algorithm", "at").agg((F.sum(F.exp(-0.5 * u * u)) / (F.count("*") * bandwidth * 2.5066282746310002)).alias("density"))


def deskew_summary(log: DataFrame) -> DataFrame:
    a, m = "deskew_avg_translation_m", "deskew_max_translation_m"
    return log.groupBy("algorithm").agg((F.avg(a) * 100.0).alias("avg_cm"), (F.avg(m) * 100.0).alias("mean_max_cm"), (F.max(m) * 100.0).alias("worst_cm"))


def deskew_frequency(log: DataFrame) -> DataFrame:
    """Largest displacement as measured at 10 Hz and as halved for 20 Hz, one row each, in centimetres."""
    both = log.select("algorithm", "frame_id", C("deskew_max_translation_m").alias("a"), (C("deskew_max_translation_m") * 0.5).alias("b"))
    long = both.unpivot(["algorithm", "frame_id"], ["a", "b"], "group", "metres")
    name = F.when(C("group") == "a", "10Hz (Measured)").otherwise("20Hz (Simulated/Estimated)")
    return long.select("algorithm", "frame_id", name.alias("frequency"), (C("metres") * 100.0).alias("displacement_cm"))


def deskew_series(log: DataFrame) -> DataFrame:
    return log.select("algorithm", "frame_id", (C("deskew_max_translation_m") * 100.0).alias("max_cm"), (C("deskew_avg_translation_m") * 100.0).alias("avg_cm"))


def stability_series(log: DataFrame) -> DataFrame:
    return log.select("algorithm", "frame_id", "cones_detected")


def phase_split(log: DataFrame) -> DataFrame:
    """Rows by comparison: clusterers under one ground remover, and ground removers under one clusterer. A run that is in
    both has two rows."""
    by = lambda kept, cut, name: log.filter(kept).withColumn("comparison", F.lit(name)).withColumn("algorithm", F.upper(F.replace(C("algorithm"), F.lit(cut), F.lit(""))))
    return by(C("algorithm").contains("_patchworkpp"), "_patchworkpp", "clustering").unionByName(by(C("algorithm").startswith("grid_"), "grid_", "ground"))


def status(confidence: Column) -> Column:
    return F.when(confidence > CONFIDENCE, "Detected").otherwise("Rejected")


def distance_bin(r: Column) -> Column:
    """Right-closed bins of 5 m up to 25 m; null beyond."""
    out = F.lit(None).cast("string")
    for hi in (25, 20, 15, 10, 5):
        low = r >= 0 if hi == 5 else r > hi - 5
        out = F.when(low & (r <= hi), f"{hi - 5}-{hi}m").otherwise(out)
    return out


def tagged(log: DataFrame) -> DataFrame:
    return log.withColumns({"status": status(C("confidence")), "distance_bin": distance_bin(C("range"))})


def detected(log: DataFrame) -> DataFrame:
    return tagged(log).filter("status = 'Detected'")


def feature_stats(log: DataFrame) -> DataFrame:
    long = detected(log).select(*(C(f).cast("double").alias(f) for f in FEATURES)).unpivot([], list(FEATURES), "feature", "v").filter("v is not null")
    return long.groupBy("feature").agg(F.min("v").alias("min"), q("v", 0.05).alias("q05"), F.avg("v").alias("mean"), q("v", 0.5).alias("median"), q("v", 0.95).alias("q95"), F.max("v").alias("max"))


def dist_bin_stats(log: DataFrame) -> DataFrame:
    rows = detected(log).filter("distance_bin is not null").groupBy("distance_bin")
    return rows.agg(F.count("*").alias("n"), F.min("point_count").alias("min_points"), q("point_count", 0.05).alias("q05_points"), F.avg("point_count").alias("mean_points"), F.max("point_count").alias("max_points"))


def tuning_report(log: DataFrame) -> DataFrame:
    """Suggested thresholds per algorithm, from quantiles of what was detected."""
    mid = F.when(C("distance_bin") == "10-15m", C("point_count"))
    return detected(log).groupBy("algorithm").agg(
        F.greatest(F.lit(0.05), q("height", 0.01) * 0.9).alias("min_height"), F.least(F.lit(1.0), q("height", 0.99) * 1.1).alias("max_height"), F.least(F.lit(0.6), q("width_max", 0.99) * 1.1).alias("max_width"),
        F.least(F.lit(0.95), q("linearity", 0.99) + 0.02).alias("max_linearity"), F.greatest(F.lit(0.5), q("verticality", 0.01) - 0.02).alias("min_verticality"), F.greatest(F.lit(3), F.floor(q(mid, 0.05)).cast("int")).alias("min_points_at_10m"),
    )


def tuning_against(log: DataFrame, configs: DataFrame) -> DataFrame:
    """The report beside the values in force: configs are (algorithm, parameter, value)."""
    return tuning_report(log).join(configs, "algorithm")


#: Reasons of the rule cascade, as columns of the pivot.
REASONS = ("EARLY_AABB", "POINT_COUNT", "LOW_INTENSITY", "PCA_LINEARITY", "PCA_PLANARITY", "PCA_SCATTER", "VERTICALITY", "HEIGHT_LIMIT", "WIDTH_LIMIT", "ASPECT_RATIO", "SYMMETRY", "NONE")


def rejection_pivot(log: DataFrame) -> DataFrame:
    return tagged(log).filter("status = 'Rejected'").groupBy("algorithm").pivot("rejection_reason", list(REASONS)).count().fillna(0)
