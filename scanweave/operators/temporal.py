"""Joins over time, on nanosecond stamps: range joins by buckets, as-of joins by one sort, and ordered folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_WINDOW = 150_000_000
CACHE = 2000
C = F.col


def window_join(frames: DataFrame, samples: DataFrame, half: int = HALF_WINDOW, at: str = "header_ts_ns") -> DataFrame:
    """Every frame with the samples within `half` of it, both ends included. Both sides are cut into buckets as wide as
    the window, so a frame meets two buckets and the join is an equality with a residual range."""
    width = 2 * half
    left = frames.withColumn("bucket", F.explode(F.sequence(F.expr(f"({at} - {half}) div {width}"), F.expr(f"({at} + {half}) div {width}"))))
    right = samples.withColumn("bucket", F.expr(f"ts_ns div {width}"))
    return left.join(right, "bucket").filter(C("ts_ns").between(C(at) - half, C(at) + half)).drop("bucket")


def as_of(left: DataFrame, right: DataFrame, at: str, values: list[str], bucket_ns: int = 10_000_000_000) -> DataFrame:
    """Each left row with the last right row at or before it (`p_` columns) and the first at or after it (`n_`).

    Rows of both sides are sorted per time bucket, once each way; a bucket without an own neighbour takes the nearest from
    the edges of other buckets, of which there is one row per bucket. So no task sorts all of time, whatever its length.
    """
    row = F.struct("ts_ns", *values)
    b = lambda c: F.expr(f"{c} div {bucket_ns}")
    both = left.select(C(at).alias("t"), b(at).alias("b"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("r"))
    both = both.unionByName(right.select(C("ts_ns").alias("t"), b("ts_ns").alias("b"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("l"), row.alias("r")))
    # running frames from either end, so that the work is linear in the rows of a bucket
    before, after = (Window.partitionBy("b").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (C("t").asc(), C("t").desc()))
    got = both.select("b", "l", F.max("r").over(before).alias("p"), F.min("r").over(after).alias("n")).filter("l is not null")
    edge = right.groupBy(b("ts_ns").alias("b")).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    wanted = left.select(b(at).alias("b")).distinct().withColumn("asked", F.lit(True)).join(edge, "b", "full")
    line = Window.orderBy("b")
    edges = wanted.select(
        "b", F.last("last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("p0"), F.first("first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("n0")
    )
    out = got.join(edges, "b", "left").select("l.*", F.coalesce("p", "p0").alias("p"), F.coalesce("n", "n0").alias("n"))
    return out.select(*left.columns, *(C(f"p.{v}").alias(f"p_{v}") for v in ["ts_ns", *values]), *(C(f"n.{v}").alias(f"n_{v}") for v in ["ts_ns", *values]))


def share(t: Column) -> Column:
    """Place of t between the neighbours that as_of() found, from 0 to 1."""
    span = (C("n_ts_ns") - C("p_ts_ns")).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((t - C("p_ts_ns")).cast("double"), span), F.lit(0.0))))


def interpolated(left: DataFrame, samples: DataFrame, at: str, values: list[str]) -> DataFrame:
    """Left rows with `values` of the samples, linear between neighbours, held at the ends, 0 without samples."""
    near = as_of(left, samples, at, values)
    a = share(C(at))
    blend = lambda v: F.when(C("p_ts_ns").isNull(), F.coalesce(f"n_{v}", F.lit(0.0))).when(C("n_ts_ns").isNull(), C(f"p_{v}")).otherwise((1.0 - a) * C(f"p_{v}") + a * C(f"n_{v}"))
    return near.select(*left.columns, *(blend(v).alias(v) for v in values))


def nearest_sample(frames: DataFrame, samples: DataFrame, at: str = "header_ts_ns") -> DataFrame:
    """The sample of the window that is nearest to each frame; the earlier of two."""
    met = window_join(frames, samples, at=at)
    return met.groupBy("frame_id").agg(F.min(F.struct(F.abs(C("ts_ns") - C(at)).alias("gap"), "ts_ns", "seq")).alias("m")).select("frame_id", "m.gap", "m.ts_ns", "m.seq")


def sorted_cache(samples: DataFrame, most: int = CACHE) -> DataFrame:
    """The latest samples by stamp, then by arrival, oldest first as `slot` from 0. A global order of at most `most` rows:
    a top-k, then a window over what it left."""
    kept = samples.orderBy(C("ts_ns").desc(), C("seq").desc()).limit(most)
    return kept.withColumn("slot", F.row_number().over(Window.orderBy("ts_ns", "seq")) - 1)


STEPS = (-0.05, -0.025, 0.0, 0.025, 0.05)


def velocity(frames: DataFrame, poses: DataFrame, at: str = "header_ts_ns") -> DataFrame:
    """Slope of five positions around each frame (frame_id, vx, vy, vz), of poses (ts_ns, tx, ty, tz) of one edge without
    rotation. See motion()."""
    from ..sources.tf import moving_transforms

    return motion(frames, moving_transforms(poses, "odom", "lidar"), "odom", "lidar", at).select("frame_id", "vx", "vy", "vz")


POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def motion(frames: DataFrame, edges: DataFrame, world: str, body: str, at: str = "header_ts_ns") -> DataFrame:
    """Pose of the body in the world at each frame (tx ... qw), and its velocity there (vx, vy, vz): the slope of five
    positions around the frame. Where one of the poses is unknown, which an identity transform stands for: of two, 20 ms
    apart; else 0."""
    from ..sources.tf import lookup_at

    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(round(u * 1e9)).cast("long").alias("du"), F.lit(u).alias("u")) for k, u in enumerate((*STEPS, -0.02))))
    asked = frames.select("frame_id", at, F.explode(steps).alias("s")).select("frame_id", "s.k", "s.u", (C(at) + C("s.du")).alias("t_ns"))
    near = lookup_at(asked, edges, world, body, "t_ns")
    known = (C("tx") != 0) | (C("ty") != 0) | (C("tz") != 0) | (C("qx") != 0) | (C("qy") != 0) | (C("qz") != 0)
    five, two = known & (C("k") < 5), known & C("k").isin(2, 5)
    per = near.groupBy("frame_id").agg(
        F.count_if(five).alias("n5"), F.count_if(two).alias("n2"), *(F.sum(F.when(C("k") < 5, C("u") * C(v))).alias(f"s_{v}") for v in ("tx", "ty", "tz")),
        *(F.sum(F.when(C("k") == 2, C(v)).when(C("k") == 5, -C(v))).alias(f"d_{v}") for v in ("tx", "ty", "tz")), F.max(F.when(C("k") == 2, F.struct(*POSE))).alias("pose"),
    )
    slope = lambda v: F.when(C("n5") == 5, C(f"s_{v}") / 0.00625).when(C("n2") == 2, C(f"d_{v}") / 0.02).otherwise(0.0)
    return per.select("frame_id", "pose.*", slope("tx").alias("vx"), slope("ty").alias("vy"), slope("tz").alias("vz"))


FAR, ALPHA = 10_000_000_000, 0.005


def clock_step(first: int | None, offset: int, diff: int) -> tuple[int, int]:
    """(first offset, running offset) after one more difference; the running one is truncated toward zero."""
    if first is None:
        first = 0 if abs(diff) < FAR else diff
        return first, first
    return first, int((1.0 - ALPHA) * float(offset) + ALPHA * float(diff)) if first != 0 else offset


def clock_offsets(arrivals: DataFrame, key: str = "sensor") -> DataFrame:
    """Running clock offset per sensor, of rows (sensor, seq, raw_ns, ref_ns) in order of seq. The first difference is the
    offset, or 0 for good if it is under 10 s; later ones move it by a two-hundredth, truncated each time. Truncation
    makes the fold sequential: it is one pass over a sensor's sorted arrivals, of which a task holds one batch."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sensor, first, offset = object(), None, 0
        for b in batches:
            out = []
            for of, diff in zip(b.column("k").to_pylist(), b.column("diff").to_pylist(), strict=True):
                if of != sensor:
                    sensor, first, offset = of, None, 0
                first, offset = clock_step(first, offset, diff)
                out.append(offset)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("seq"), pa.array(out, pa.int64())], ["k", "seq", "offset"])

    rows = arrivals.select(C(key).alias("k"), "seq", (C("raw_ns") - C("ref_ns")).alias("diff"))
    kind = f"k {rows.schema['k'].dataType.simpleString()}, seq {rows.schema['seq'].dataType.simpleString()}, offset long"
    return rows.repartition("k").sortWithinPartitions("k", "seq", "diff").mapInArrow(fold, kind).withColumnRenamed("k", key)


def clock_reference(frames: DataFrame, stamps: DataFrame) -> DataFrame:
    """Reference time of each frame: the last sample stamp received by then, in order of arrival, else its own arrival.
    frames: frame_id, recv_ts_ns; stamps: recv_ts_ns, ts_ns."""
    near = as_of(frames.select("frame_id", "recv_ts_ns"), stamps.select(C("recv_ts_ns").alias("ts_ns"), C("ts_ns").alias("stamp")), "recv_ts_ns", ["stamp"])
    return near.select("frame_id", F.coalesce("p_stamp", "recv_ts_ns").alias("ref_ns"))
