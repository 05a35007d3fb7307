"""Greedy merging in order: a centre joins the first seed in reach, or becomes a seed. Seeds never move.

Per frame this is a fold over the ordered centres, inside Spark; a frame has a few dozen centres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

STATE = "array<struct<id:int,x:double,y:double>>"


def seeds_of(centres: DataFrame, reach: float) -> DataFrame:
    """(frame_id, cluster_id, seed_id) of centres (frame_id, cluster_id, cx, cy), in order of cluster_id; a centre at
    exactly `reach` is out of it."""
    item = F.struct(F.col("cluster_id").cast("int").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    ordered = centres.groupBy("frame_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    near = lambda s, e: (s["x"] - e["x"]) * (s["x"] - e["x"]) + (s["y"] - e["y"]) * (s["y"] - e["y"]) < reach * reach

    def walk(seeds: Column, e: Column) -> Column:
        return F.when(F.exists(seeds, lambda s: near(s, e)), seeds).otherwise(F.concat(seeds, F.array(e)))

    folded = ordered.withColumn("seeds", F.aggregate("items", F.array().cast(STATE), walk))
    # the first seed in reach is the one it joined: seeds that come later were no seeds yet, or are itself
    joined = F.transform("items", lambda e: F.struct(e["id"].alias("cluster_id"), F.try_element_at(F.filter("seeds", lambda s: near(s, e)), F.lit(1))["id"].alias("seed_id")))
    return folded.select("frame_id", F.inline(joined))


def centroids(members: DataFrame) -> DataFrame:
    return members.groupBy("frame_id", "cluster_id").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))


def _in_reach(s: Column, e: Column, reach: float) -> Column:
    return (s["x"] - e["x"]) * (s["x"] - e["x"]) + (s["y"] - e["y"]) * (s["y"] - e["y"]) < reach * reach


def _fold(reach: float):
    """Seeds of an ordered array of (id, x, y)."""
    return lambda seeds, e: F.when(F.exists(seeds, lambda s: _in_reach(s, e, reach)), seeds).otherwise(F.concat(seeds, F.array(e)))


def merge_clusters(members: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """members with cluster_id of the cluster that theirs is merged into; clusters below the least size go first. A frame
    is gathered once, with its centres, and its members are given out again: nothing is computed or joined twice."""
    own = Window.partitionBy("frame_id", "cluster_id")
    cols = [c for c in members.columns if c not in ("frame_id", "cluster_id")]
    m = members.withColumns({"__n": F.count("*").over(own), "__x": F.avg("x").over(own), "__y": F.avg("y").over(own)}).filter(F.col("__n") >= cfg.min_cluster_size)
    item = F.struct(F.col("cluster_id").cast("int").alias("id"), F.col("__x").alias("x"), F.col("__y").alias("y"))
    f = m.groupBy("frame_id").agg(F.sort_array(F.collect_set(item)).alias("items"), F.collect_list(F.struct("cluster_id", *cols)).alias("ms"))
    f = f.withColumn("seeds", F.aggregate("items", F.array().cast(STATE), _fold(cfg.merge_dist)))
    to = F.map_from_entries(F.transform("items", lambda e: F.struct(e["id"], F.try_element_at(F.filter("seeds", lambda s: _in_reach(s, e, cfg.merge_dist)), F.lit(1))["id"])))
    f = f.withColumn("seed_of", to)
    given = F.transform("ms", lambda p: F.struct(F.element_at("seed_of", p["cluster_id"]).alias("cluster_id"), *(p[c].alias(c) for c in cols)))
    return f.select("frame_id", F.inline(given))


def aggregate_duplicates(cones: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Cones (frame_id, cluster_id, x, y, z, range, bearing ...) of one place as one: the mean of their places, the rest
    of the first one's columns; range and bearing follow the mean. `merged` counts them."""
    cols = [c for c in cones.columns if c not in ("frame_id", "cluster_id")]
    reach = cfg.tracking_match_dist
    f = cones.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", F.struct(*cols).alias("c")))).alias("cs"))
    items = F.transform("cs", lambda e: F.struct(e["cluster_id"].cast("int").alias("id"), e["c"]["x"].alias("x"), e["c"]["y"].alias("y")))
    f = f.withColumn("items", items).withColumn("seeds", F.aggregate("items", F.array().cast(STATE), _fold(reach)))
    first = F.transform("items", lambda e: F.try_element_at(F.filter("seeds", lambda s: _in_reach(s, e, reach)), F.lit(1))["id"])
    f = f.withColumn("groups", F.transform(F.arrays_zip(F.col("cs").alias("cs"), first.alias("seed")), lambda e: F.struct(e["seed"].alias("seed"), e["cs"].alias("cs"))))

    def one(e: Column) -> Column:
        group = F.filter("groups", lambda g: g["seed"] == e["cluster_id"])
        mean = lambda c: F.aggregate(group, F.lit(0.0), lambda s, g: s + g["cs"]["c"][c]) / F.size(group)
        return F.struct(e["cluster_id"].alias("cluster_id"), F.size(group).cast("long").alias("merged"), *(mean(c).alias(f"m{c}") for c in "xyz"), e["c"].alias("c"))

    seeds = F.filter("cs", lambda e: F.exists("seeds", lambda s: s["id"] == e["cluster_id"]))
    out = f.select("frame_id", F.inline(F.transform(seeds, one)))
    many = F.col("merged") > 1
    place = {c: F.when(many, F.col(f"m{c}")).otherwise(F.col(f"c.{c}")) for c in "xyz"}
    moved = {"range": F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my")), "bearing": F.atan2("my", "mx")}
    place |= {k: F.when(many, v).otherwise(F.col(f"c.{k}")) for k, v in moved.items() if k in cols}
    return out.select("frame_id", "cluster_id", *((place[c] if c in place else F.col(f"c.{c}")).alias(c) for c in cols), "merged")
