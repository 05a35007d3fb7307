"""Shape features of clusters, and the ordered rules that accept or reject them. Native aggregates and expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE, DEFAULT, MAX_ASPECT, MAX_SYMMETRY, MIN_ASPECT, Config

C = F.col
KEY = ("frame_id", "cluster_id")


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with their columns computed once: expressions above are not merged into those below, which would
    repeat them at every use. A generator of one row stands between."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def aabb(members: DataFrame) -> DataFrame:
    return members.groupBy(*KEY).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def moments(members: DataFrame) -> DataFrame:
    """Count, box, means and population covariances of each cluster, in one pass."""
    pairs = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))
    return members.groupBy(*KEY).agg(
        F.count("*").alias("point_count"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))), F.avg("intensity").alias("avg_intensity"),
        *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs), F.min("point_idx").alias("first_idx"),
    )


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Of a symmetric matrix, largest first, by the trigonometric solution of its cubic."""
    q = (xx + yy + zz) / 3.0
    p2 = ((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0
    p = F.sqrt(p2)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.try_divide(det, 2.0 * p * p2)
    phi = F.when(p2 > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))).otherwise(0.0) / 3.0
    l1 = q + 2.0 * p * F.cos(phi)
    l3 = q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)
    return l1, 3.0 * q - l1 - l3, l3


def with_eigen_features(m: DataFrame) -> DataFrame:
    """Linearity, planarity, scattering, and verticality: the height part of the main axis, from the eigenvalues alone."""
    l1, l2, l3 = eigenvalues(*(C(f"c{k}") for k in ("xx", "yy", "zz", "xy", "xz", "yz")))
    m = settled(m.withColumns({"l1": l1, "l3": l3})).withColumn("l2", C("cxx") + C("cyy") + C("czz") - C("l1") - C("l3"))
    some = (C("l1") + C("l2") + C("l3")) > 1e-6
    part = lambda c: F.when(some, F.try_divide(c, C("l1"))).otherwise(0.0)
    minor = C("l1") * C("l1") - C("l1") * (C("cxx") + C("cyy")) + C("cxx") * C("cyy") - C("cxy") * C("cxy")
    up = F.coalesce(F.try_divide(minor, (C("l1") - C("l2")) * (C("l1") - C("l3"))), F.lit(0.0))
    return m.withColumns({"linearity": part(C("l1") - C("l2")), "planarity": part(C("l2") - C("l3")), "scattering": part(C("l3")), "verticality": F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), up)))})


def with_shape(m: DataFrame) -> DataFrame:
    """Place, height and widths from box and means; z is the lowest point's."""
    wx, wy, h = C("max_x") - C("min_x"), C("max_y") - C("min_y"), C("max_z") - C("min_z")
    m = settled(m).withColumns({"x": C("mean_x"), "y": C("mean_y"), "z": C("min_z"), "height": h, "width_max": F.greatest(wx, wy), "width_min": F.greatest(F.lit(0.001), F.least(wx, wy))})
    aspect = F.when(C("height") > 0.001, C("width_max") / C("height")).otherwise(0.0)
    return m.withColumns({"range": F.sqrt(C("x") * C("x") + C("y") * C("y")), "bearing": F.atan2(C("y"), C("x")), "aspect_ratio": aspect, "symmetry": C("width_max") / C("width_min")})


FEATURES = ("point_count", "x", "y", "z", "range", "bearing", "height", "width_max", "width_min", "aspect_ratio", "avg_intensity", "linearity", "planarity", "scattering", "verticality", "symmetry")


def features(members: DataFrame) -> DataFrame:
    """One row per cluster of (frame_id, cluster_id, point_idx, x, y, z, intensity) members."""
    return settled(with_eigen_features(with_shape(moments(members))).select(*KEY, *FEATURES, "first_idx"))


def expected_points(r: Column, cfg: Config = DEFAULT) -> Column:
    """Least points at a range; the cap comes before the conversion, which could not hold the value of range 0."""
    raw = F.least(F.lit(float(cfg.rule_min_points_cap)), F.coalesce(F.try_divide(F.lit(cfg.rule_min_points_at_10m * 100.0), r * r), F.lit(float(cfg.rule_min_points_cap))))
    return F.least(F.lit(cfg.rule_min_points_cap), F.greatest(F.lit(3), F.floor(raw).cast("int")))


def rejection(cfg: Config = DEFAULT) -> Column:
    """The first rule a cluster fails, or NONE."""
    h, w, r = C("height"), C("width_max"), C("range")
    few = C("point_count") / expected_points(r, cfg).cast("double")
    fine = (C("verticality") > 0.85) & (C("symmetry") < 1.5)
    narrow = F.greatest(F.lit(0.02), cfg.rule_base_min_width - r * cfg.rule_dynamic_width_decay)
    rules = (
        ("NONE", C("point_count") < 2),
        ("EARLY_AABB", (h < cfg.rule_min_height * 0.8) | (h > cfg.rule_max_height * 1.2) | (w > cfg.rule_max_width * 1.5)),
        ("POINT_COUNT", (few < 0.85) & ~fine),
        ("LOW_INTENSITY", C("avg_intensity") < cfg.rule_min_intensity),
        ("PCA_LINEARITY", C("linearity") > cfg.pca_max_linearity),
        ("PCA_PLANARITY", C("planarity") > cfg.pca_max_planarity + 0.1),
        ("PCA_SCATTER", C("scattering") < cfg.pca_min_scatter * 0.3),
        ("VERTICALITY", C("verticality") < cfg.pca_min_verticality),
        ("HEIGHT_LIMIT", (h < cfg.rule_min_height) | (h > cfg.rule_max_height)),
        ("WIDTH_LIMIT", (w < narrow) | (w > cfg.rule_max_width)),
        ("ASPECT_RATIO", (C("aspect_ratio") < MIN_ASPECT) | (C("aspect_ratio") > MAX_ASPECT)),
        ("SYMMETRY", C("symmetry") > MAX_SYMMETRY),
    )
    out = F.lit("NONE")
    for name, failed in reversed(rules):
        out = F.when(failed, name).otherwise(out)
    return out


def classify(clusters: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """clusters with rejection_reason and confidence (1 or 0). Clusters of one point keep the reason NONE and are logged
    without points."""
    out = clusters.withColumn("rejection_reason", rejection(cfg))
    sure = (C("rejection_reason") == "NONE") & (C("point_count") >= 2)
    return out.withColumn("confidence", F.when(sure, 1.0).otherwise(0.0)).withColumn("point_count", F.when(C("point_count") < 2, F.lit(0).cast("long")).otherwise(C("point_count")))


def accepted(clusters: DataFrame) -> DataFrame:
    return clusters.filter(C("confidence") > CONFIDENCE)
