"""Mixing sources to target weights (operator 4), native DataFrame functions only.

Sizes are summed per source; a water level turns weights into targets that never pass a cap; the
repetition rate of a source is target / size. A document is taken floor(rate) times and once more if
its seeded hash falls below the fraction, so reruns agree and no state is shared between tasks.

Edge cases: a null text has size 0; the null source is a source of its own and comes last; a source of
size 0 has target and rate 0; repeated rows are each mixed on their own and, with equal ids, draw alike; a null
id draws as the text `null`; texts are counted whole, however long; an empty table gives no rows. Other columns
pass through `mix` as they are, whatever their names: the new column is always the last one, and is called `mix`
with as many underscores behind it as make the name free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import free_name, hashed_fraction, join_small, table, word_count, written

SEED = 20240607


#: Bits of a row number that count within a partition, in numbers from monotonically_increasing_id.
ROW_BITS = 33


def _numbered(per: DataFrame) -> DataFrame:
    """per with `k`, the place of each source by code point, null last, from 0. Sources are ranged over partitions and
    sorted there; only the sizes of partitions are summed in one task."""
    order = (F.col("source").isNull(), F.col("source"))
    rows = written(per.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", ROW_BITS).alias("part")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part).count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    k = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.withColumn("part", part).join(F.broadcast(parts), "part").select("source", "source_size", k.alias("k"))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Targets share `share` times all sizes by weight; weights repeat over the sources by code point, null last. A target
    stops at `cap` times its source's size and the excess goes to the others by weight until none is above. Each round
    of that is one sum over the sources: what the stopped ones take goes off the total, and the level, which is what
    one unit of weight gets, rises. Stopped sources stay so, and the rounds end when no other joins them.
    """
    per = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    per = written(per.withColumn("w", w).withColumn("most", F.col("source_size").cast("double") * F.lit(float(cap))))
    level, stopped = 0.0, None
    while True:
        full = F.col("most") <= F.lit(level) * F.col("w")
        got = per.agg(
            F.sum("source_size").cast("double").alias("all"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("used"), F.sum(F.when(~full, F.col("w"))).alias("open"), F.count_if(full).alias("stopped")
        ).first()
        if got["open"] is None or got["stopped"] == stopped:
            break
        level, stopped = (got["all"] * float(share) - got["used"]) / got["open"], got["stopped"]
    target = F.least("most", F.lit(level) * F.col("w")) if got["open"] is not None else F.col("most")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, **shares) -> DataFrame:
    """docs with a last struct column `mix`: size, source_size, target, rate, copies. Rows of `copies` 0 stay, for reports.

    The table of rates is written once; it is broadcast if it has few rows, else joined by shuffle. All sizes are sums
    of partial sums, so a source that holds a third of all rows is no larger task than another.
    """
    sized = docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rates = written(source_targets(sized, **shares))
    # the null source joins as a key of its own
    key = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))).alias("source")
    keyed = rates.select(key("source"), F.struct("source_size", "target", "rate").alias("of"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key(source), word_count(F.col(text)).alias("size"), F.col(doc_id).alias("id"))
    out = join_small(rows, keyed, ["source"], rates.count())
    rate = F.col("of.rate")
    extra = (hashed_fraction(seed, F.col("id")) < rate - F.floor(rate)).cast("long")
    both = F.struct("size", F.col("of.source_size").alias("source_size"), F.col("of.target").alias("target"), rate.alias("rate"), (F.floor(rate) + extra).alias("copies"))
    return out.select("row.*", both.alias(free_name("mix", docs.columns)))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as it is taken; the last column, a struct, gains `copy`, from 0."""
    *own, m = (F.col(f"`{c}`") for c in mixed.columns)
    copies = mixed.select(F.struct(*own).alias("row"), m.alias("m")).filter("m.copies > 0")
    copies = copies.select("row", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m.copies") - 1)).alias("copy"))
    return copies.select("row.*", F.col("m").withField("copy", F.col("copy")).alias(mixed.columns[-1]))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mix(docs)
    return m.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (
  select *, [3e0, 1e0, 2e0][1 + ((row_number() over (order by source is null, source) - 1) % 3)::int] as w,
         source_size::double * 2e0 as most from per),
level as (
  select *, coalesce(sum(most) over (o rows between unbounded preceding and 1 preceding), 0e0) as used,
         sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0e0) as w_left,
         sum(source_size) over () as all_size
  from weighted window o as (order by most / w, source is null, source)),
lam as (select *, (all_size::double * 1.5e0 - used) / w_left as lvl from level),
target as (
  select source, source_size,
         coalesce(least(most, (select arg_min(lvl, most / w) from lam where most > lvl * w) * w), most) as target
  from lam),
rated as (select *, case when source_size > 0 then target / source_size else 0e0 end as rate from target)
select d.doc_id, d.size, r.source_size, r.target,
       d.size * (floor(r.rate)::bigint
         + (('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint::double / 4503599627370496e0
            < r.rate - floor(r.rate))::bigint) as taken
from sized d join rated r on d.source is not distinct from r.source
"""

QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {"op4_mixing": SQL}
