"""A corpus pipeline over `documents`: quality rules, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Decisions take effect: rejected documents, copies, and
all but one of near copies go; a document is emitted as often as the mix takes it; the last stage returns pieces and
their places in sequences. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.base import table, written
from scanweave.llm.exact import drop_copies
from scanweave.llm.jaccard import drop_near_copies
from scanweave.llm.mixing import emit_copies, mix
from scanweave.llm.packing import default_tokenizer, pack
from scanweave.llm.quality_rules import STAGE_RULES, drop_rejected


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule, repeated lines by their share of the text."""
    return drop_rejected(docs, rules=STAGE_RULES)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return drop_copies(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8 or more."""
    return drop_near_copies(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    return emit_copies(mix(rows)).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 ids."""
    return pack(docs, default_tokenizer(), with_ids=False)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Packing by a tokenizer has no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
