"""The pipeline's stages against plain versions, on a small table with odd rows."""

from collections import Counter

import corpus_pipeline as cp
import pytest

from .test_operators import TEXTS, plain_components, plain_counts, prose, rows


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(50 + k, prose(60 + k, 100), "abc"[k % 3]) for k in range(12)]
    return rows(spark, [*TEXTS, *extra]).repartition(2)


def test_every_stage(spark, docs):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    start = docs.collect()
    one = cp.quality_rules(spark, docs, "").collect()
    assert {r["doc_id"] for r in one if plain_counts(r["text"])[0] < 50} == set()
    assert {50 + k for k in range(12)} <= {r["doc_id"] for r in one}  # clean documents stay
    two = cp.exact_dedup(spark, spark.createDataFrame(one, docs.schema), "").collect()
    assert len(two) == len({r["text"] for r in one})
    three = cp.near_dedup(spark, spark.createDataFrame(two, docs.schema), "").collect()
    want = plain_components([(r["doc_id"], r["text"], r["source"]) for r in two], 5, 80)
    assert {r["doc_id"] for r in three} == {c for _, _, c in want}
    four = cp.mixing(spark, spark.createDataFrame(three, docs.schema), "")
    assert four.columns == docs.columns
    times = Counter(r["doc_id"] for r in four.collect())
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in three}
    five = cp.packing(spark, four, "").collect()
    assert Counter(r["doc_id"] for r in five if r["piece"] == 0) == times and len(start) == docs.count()


def test_run_on_a_folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).filter("length > 1024").count() == 0


def test_empty_table(spark, tmp_path):
    rows(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
