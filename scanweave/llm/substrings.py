"""Substring dedup (operator 1): Rabin-Karp hashes of every window of words, counted in Spark.

A word is removed if a window of `window` words covers it whose words also start in a document with a smaller id. All
windows are judged on the input. Repeated windows of a document merge into maximal intervals, and those are cut out.

Moving a hash per window through a shuffle would cost several times the text. Windows are therefore counted in two
steps that lose none:

1. Every window has an anchor, the smallest Rabin-Karp hash of the half-length windows inside it. Equal windows have
   equal anchors. Neighbouring windows that share one form a stretch, so there are many fewer stretches than windows.
   Anchors are counted, and the stretches whose anchor is found in documents of different ids go on.
2. Equal stretches (same anchor and same hash over their words) are one unit with the smallest id that has it. Where an
   anchor has several units, the hash of each of their windows is counted under it, as (anchor, window hash): 128 bits
   of two polynomials. The smallest id of a window goes back to the stretches and so to the documents.

What goes on to a step is told by marks (see marks.py): fixed-size bitmaps of the keys that count, read while a scan
streams by. A mark set by chance lets a row through that changes nothing. So texts that have no part in a step do not
move, and of the others each moves at most twice. Sums per key are partial before their shuffle, and the two joins
back from keys to rows take the keys that many rows have by a broadcast that is bounded (base.join_counted).

Edge cases: a null text has no words; texts shorter than a window stay whole; repeats inside one document, or among
rows of one id, are kept; a null id counts as larger than any other; repeated rows are treated alike; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import join_counted, table, written
from .marks import Marks, marks
from .words import WINDOW_BASE, WORD_BASE, Words, mix, running, signed, slices, sliding_min, spans

WINDOW = 50
NO_ID = (1 << 63) - 1


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] numbers, then from lo[1] on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _stretches(window: int, only: Marks | None = None):
    """Anchor and id of every stretch; with `only`, whole stretches, of the anchors marked there."""
    half = window // 2
    longest = window - half + 1  # windows that can share one anchor, where its words do not recur

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            w = Words(cut.column("text"))
            at, per = w.window_starts(window)
            if not len(at):
                continue
            h = w.hashes()
            s = running(h, WORD_BASE)
            i = np.arange(len(h) - half + 1)
            anchor = sliding_min(mix(spans(s, i, i + half, WORD_BASE)), window - half + 1)[at]
            doc = np.repeat(np.arange(len(per)), per)
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
            lo = np.flatnonzero(new)
            if only is None:
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[lo])), cut.column("rid").take(pa.array(doc[lo]))], ["anchor", "rid"])
                continue
            n = np.diff(np.append(lo, len(at)))
            keep = only.has(anchor[lo])
            lo, n = lo[keep], n[keep]
            # an anchor that recurs (periodic text) would make a stretch without bound: it is cut
            pieces = -(-n // longest)
            lo, left = _ranges(np.zeros(len(lo), np.int64), pieces) * longest + np.repeat(lo, pieces), np.repeat(lo + n, pieces)
            n = np.minimum(left - lo, longest)
            big = running(h, WINDOW_BASE)
            whole = mix(spans(big, at[lo], at[lo] + n + window - 1, WINDOW_BASE) + n.astype(np.uint64))
            rows = doc[lo]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(anchor[lo])), cut.column("rid").take(pa.array(rows)), cut.column("th").take(pa.array(rows)), pa.array((at[lo] - w.first[rows]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(whole))],
                ["anchor", "rid", "th", "start", "n", "whole"],
            )

    return run


def _window_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            w = Words(cut.column("text"))
            units = cut.column("units")  # of a document: (anchor, whole, min_rid, start, n)
            flat = units.flatten()
            per = np.diff(units.offsets.to_numpy())
            doc = np.repeat(np.arange(len(per)), per)
            start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
            big = running(w.hashes(), WINDOW_BASE)
            at = _ranges(w.first[doc] + start, n)
            unit = pa.array(np.repeat(np.arange(len(n)), n))
            got = mix(spans(big, at, at + window, WINDOW_BASE))
            yield pa.RecordBatch.from_arrays(
                [*(flat.field(k).take(unit) for k in ("anchor", "whole", "min_rid")), pa.array(_ranges(np.zeros(len(n), np.int64), n).astype(np.int32)), pa.array(signed(got))],
                ["anchor", "whole", "min_rid", "k", "h"],
            )

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, th, runs) of the documents with windows that a smaller id has too; runs are (first window, windows) in any
    order. docs: rid, th, key, text, where the key is a hash of rid and th."""
    stretches = docs.select("rid", "text").mapInArrow(_stretches(window), "anchor long, rid long")
    shared = written(stretches.groupBy("anchor").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi").select("anchor"))
    hits = written(docs.select("rid", "th", "text").mapInArrow(_stretches(window, marks(shared, "anchor")), "anchor long, rid long, th long, start int, n int, whole long"))
    # equal stretches as one: their smallest id, and the place of one of them to read its words from
    units = written(hits.groupBy("anchor", "whole").agg(F.min("rid").alias("min_rid"), F.max("rid").alias("max_rid"), F.count("*").alias("rows"), F.min(F.struct("rid", "th", "start", "n")).alias("at")))
    # under an anchor with one such unit, all its windows are where the unit is; others are counted window by window
    crowded = marks(written(units.groupBy("anchor").agg(F.count("*").alias("units")).filter("units > 1").select("anchor")), "anchor")
    asked = crowded.keep(units.select("anchor", "whole", "min_rid", "at"), "anchor")
    asked = asked.select(F.col("at.rid").alias("rid"), F.col("at.th").alias("th"), F.struct("anchor", "whole", "min_rid", F.col("at.start").alias("start"), F.col("at.n").alias("n")).alias("u"))
    asked = written(asked.groupBy("rid", "th").agg(F.collect_list("u").alias("units")).withColumn("key", F.xxhash64("rid", "th")))
    texts = marks(asked, "key").keep(docs.select("key", "rid", "th", "text"), "key").drop("key")
    one = texts.join(asked.drop("key"), ["rid", "th"]).dropDuplicates(["rid", "th"])
    windows = written(one.select("text", "units").mapInArrow(_window_hashes(window), "anchor long, whole long, min_rid long, k int, h long"))
    least = written(windows.groupBy("anchor", "h").agg(F.min("min_rid").alias("least"), F.max("min_rid").alias("most"), F.count("*").alias("rows")).filter("least < most").drop("most"))
    # per unit, its windows that a smaller id has in another unit; at most window / 2 + 1 of them
    earlier = join_counted(windows, least, ["anchor", "h"], windows.count()).filter("least < min_rid")
    earlier = earlier.groupBy("anchor", "whole").agg(F.collect_list(F.struct("k", "least")).alias("ks"))
    known = units.select("anchor", "whole", "min_rid", "max_rid", "rows").join(earlier, ["anchor", "whole"], "left")
    known = written(known.filter("ks is not null or min_rid < max_rid").drop("max_rid"))
    marked = join_counted(hits, known, ["anchor", "whole"], hits.count())
    # all windows of a stretch if its unit has a smaller id, else those that another unit has with one
    run = lambda start, n: F.struct(start.alias("start"), n.alias("n"))
    some = F.transform(F.filter("ks", lambda x: x["least"] < F.col("rid")), lambda x: run(F.col("start") + x["k"], F.lit(1)))
    runs = F.when(F.col("min_rid") < F.col("rid"), F.array(run(F.col("start"), F.col("n")))).otherwise(some)
    marked = marked.select("rid", "th", F.explode(runs).alias("run"))
    return marked.groupBy("rid", "th").agg(F.collect_set("run").alias("runs"))


def intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [lo, hi) of words that the windows cover."""
    s = np.unique(starts)
    if not len(s):
        return s, s
    new = np.append(True, s[1:] > s[:-1] + window)
    lo = np.flatnonzero(new)
    return s[lo], s[np.append(lo[1:], len(s)) - 1] + window


def _windows_of(runs: pa.ListArray) -> list[np.ndarray]:
    """First words of the windows of each row's runs."""
    ends, flat = runs.offsets.to_numpy(), runs.values
    start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n"))
    return [_ranges(start[a:b], n[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _cut_out(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            n_words, n_removed, sha, kept, spans_ = [], [], [], [], []
            for text, starts in zip(cut.column("text").to_pylist(), _windows_of(cut.column("runs")), strict=True):
                words = text.encode().split()  # bytes split at the same six characters
                lo, hi = intervals(starts, window)
                out, at = [], 0
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    out += words[at:a]
                    at = b
                out += words[at:]
                whole = b" ".join(out)
                n_words.append(len(words))
                n_removed.append(len(words) - len(out))
                sha.append(hashlib.sha256(whole).hexdigest())
                if with_text:
                    kept.append(whole.decode())
                    spans_.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            cols = [cut.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols += [pa.array(kept, pa.string()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text and the removed
    intervals of words (start, end)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), F.xxhash64("text").alias("th"), "doc_id", "text").withColumn("key", F.xxhash64("rid", "th"))
    found = written(repeated_windows(rows.select("rid", "th", "key", "text"), window).withColumn("key", F.xxhash64("rid", "th")))
    # texts without a repeat are done where they are read; the others move to their runs
    marked = marks(found, "key")
    none = F.array().cast(found.schema["runs"].dataType)
    whole = marked.keep(rows.select("key", "doc_id", "text"), "key", others=True).select("doc_id", "text", none.alias("runs"))
    cut = marked.keep(rows, "key").join(found.drop("key"), ["rid", "th"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<struct<start:bigint,end:bigint>>" * with_text
    return whole.unionByName(cut).mapInArrow(_cut_out(window, with_text), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
least as (select h, min(doc_id) as lo from win group by h),
gone as (select distinct doc_id, i + k as j from win join least using (h), (select unnest(range(50)) as k) where lo < doc_id),
word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
kept as (select doc_id, string_agg(word, ' ' order by j) as t, count(*) as n from word anti join gone using (doc_id, j) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES = {"op1_substring_dedup": SQL}
