"""Exact dedup by content sort (operator 3).

Rows are ranged over partitions by (first bytes of the normalised text, identifier): Spark samples these short keys
for the splitters, so neither sample nor splitters hold whole texts. The identifier in the key lets a group of copies
of any size spread over partitions. Each partition is sorted externally by its whole texts; equal texts are then
neighbours and are found by comparing whole neighbouring texts as the rows stream by. Only texts whose first bytes are
those of a partition's first or last row can go on in another one: their runs of equal texts, one row each, are
matched by the SHA-256 of the whole text, which the rows carry anyway.

Edge cases: a null text counts as empty, so null and empty texts are copies; texts are compared whole, however long;
a null identifier loses against any other; of repeated rows (same text and identifier) one stays; an empty table gives
no rows; other columns are ignored by `exact_copies` and kept by `drop_copies`, whatever their names. `keep` is
"smallest" or "largest" identifier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written

PREFIX = 64


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sha, part, run, head, lead): run numbers equal neighbouring texts, lead those with the same first bytes."""
    part, run, lead, last = TaskContext.get().partitionId(), -1, -1, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = []
        for c, before in zip(("text", "lead"), last or (None, None), strict=True):
            col = batch.column(c)
            same = pc.equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
            new.append(np.append(last is None or col[0].as_py() != before, ~same))
        last = tuple(batch.column(c)[n - 1].as_py() for c in ("text", "lead"))
        runs, leads = run + np.cumsum(new[0]), lead + np.cumsum(new[1])
        run, lead = int(runs[-1]), int(leads[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("sha"), pa.array([part] * n, pa.int32()), pa.array(runs), pa.array(new[0]), pa.array(leads)], ["doc_id", "sha", "part", "run", "head", "lead"]
        )


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (normalise(plain) if normalise else plain).alias("text"))
    rank = (lambda c: F.col(c)) if keep == "largest" else (lambda c: F.bitwise_not(F.col(c)))  # reverses the order, without overflow
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("sha"), F.substring("text", 1, PREFIX).alias("lead"))
    order = [rank("doc_id").desc_nulls_last()]
    sorted_ = rows.repartitionByRange("lead", *order).sortWithinPartitions("text", *order).select("doc_id", "text", "sha", "lead")
    found = written(sorted_.mapInArrow(_runs, "doc_id long, sha string, part int, run long, head boolean, lead long"))
    best = F.max(F.when(F.col("head"), F.struct(rank("doc_id").alias("rank"), "doc_id"))).alias("first")
    runs = found.groupBy("part", "run").agg(F.count("*").alias("n"), best, F.first("sha").alias("sha"), F.first("lead").alias("lead"))
    # runs that a splitter may have cut: one group each where texts are equal; the first row of the best run stays
    ends = found.groupBy("part").agg(F.max("lead").alias("last"))  # a row for each partition
    edges = runs.join(F.broadcast(ends), "part").filter("lead = 0 or lead = last")
    edges = edges.groupBy("sha").agg(F.collect_list(F.struct("part", "run")).alias("at"), F.sum("n").alias("size"), F.max(F.struct("first.rank", (-F.col("part")).alias("p"), "first.doc_id")).alias("best"))
    edges = edges.select(F.inline("at"), "size", F.col("best.doc_id").alias("best_id"), (-F.col("best.p")).alias("best_part"))
    whole = runs.join(edges, ["part", "run"], "left").select(
        "part", "run", F.when(F.col("size").isNull(), F.col("first.doc_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("size", "n").alias("group_size"), F.coalesce("best_part", "part").alias("keep_part")
    )
    return (
        found.join(whole, ["part", "run"])
        .select("doc_id", "keep_id", "group_size", (F.col("head") & (F.col("part") == F.col("keep_part"))).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs without the copies that exact_copies() gives up; all columns stay. Of repeated rows one stays."""
    from pyspark.sql import Window

    identity = lambda i, sha: F.struct(F.coalesce(i.cast("long"), F.lit(0)).alias("id"), i.isNull().alias("none"), sha.alias("sha")).alias("key")
    stay = exact_copies(docs, text, doc_id, keep, normalise).filter("kept").select(identity(F.col("doc_id"), F.col("text_sha256")))
    plain = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), identity(F.col(doc_id), F.sha2(normalise(plain) if normalise else plain, 256)))
    one = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    return keyed.join(stay, "key", "left_semi").withColumn("n", one).filter("n = 1").select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")


SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": SQL}
