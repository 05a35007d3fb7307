"""Best-fit packing of token sequences (operator 9).

Bounded-space online best-fit, run by each task over the rows it scans, in their order and without a shuffle: a fixed
number of bins is open; a bitset has bit f set while an open bin has f places free, so the tightest bin that fits is
the lowest set bit from the piece's length on. When one bin too many is open, the fullest closes. Full pieces are
sequences of their own.

The pieces of the bins that are still open when a task ends, at most OPEN_BINS of them, are packed again by best fit,
longest first, by one task for every MERGED bins or so, which may keep all of its bins open: so few rows are left that
they are bounded anyway. This goes on until one task is left or a round saves little. What is lost is the free space
of bins that the first round closes and of those that the last round leaves open.

Edge cases: a null or empty text is the end id alone; a text of any length is cut into pieces and its whole text is
encoded; repeated rows are packed each on their own; a null identifier passes through; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, written
from .words import slices

CAPACITY, END_ID, OPEN_BINS = 1024, 2, 512
#: Open bins that one task of a later round packs again, and the rounds after which the rest stays as it is.
MERGED, ROUNDS = 8 * OPEN_BINS, 4
KIND = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Open bins by free space. place() gives the bin's number and the offset in it; `closed` collects the bins that
    became full or were closed."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        b = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            free, b = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.bins[rest].append(b)
            self.bits |= 1 << rest
            self.open += 1
            if self.open > self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        else:
            self.closed.append(b)
        return b, self.capacity - free


class Packer:
    """Packs rows (doc_id, piece, start, length, ids_crc32, ids). The rows of a bin are given out when it closes, so it
    holds what is in the open bins: at most OPEN_BINS times the capacity in ids."""

    def __init__(self, first: int, capacity: int, open_bins: int):
        self.fit, self.first, self.held = BestFit(capacity, open_bins), first, {}

    def add(self, rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for r in rows:
            b, at = self.fit.place(r[3])
            self.held.setdefault(b, []).append((*r[:5], self.first + b, at, r[5]))
            for c in self.fit.closed:
                out += self.held.pop(c)
            self.fit.closed.clear()
        return out

    def rest(self) -> list[tuple]:
        return [r for rows in self.held.values() for r in rows]


def _batch(rows: list[tuple], still_open: bool, with_ids: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
    cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)] + [pa.array([still_open] * len(rows), pa.bool_())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
    if with_ids:
        cols.append(pa.array([r[7] for r in rows], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole if it fits, else full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _first_round(path: str, capacity: int, end_id: int, open_bins: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        enc, packer = encoder(path), Packer(TaskContext.get().partitionId() << 32, capacity, open_bins)
        for cut in slices(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for doc, ids in zip(cut.column("doc_id").to_pylist(), enc.encode(cut.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                    own = ids[s : s + n]
                    rows.append((doc, k, s, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
            yield _batch(packer.add(rows), False, with_ids)
        yield _batch(packer.rest(), True, with_ids)

    return run


def _next_round(number: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(number << 56 | TaskContext.get().partitionId() << 32, capacity, capacity * MERGED)
        for b in batches:
            ids = b.column("ids").to_pylist() if with_ids else [None] * b.num_rows
            rows = list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")), ids, strict=True))
            yield _batch(packer.add(rows), False, with_ids)
        yield _batch(packer.rest(), True, with_ids)

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, its ids."""
    kind, own = KIND + ", open boolean" + ", ids array<int>" * with_ids, [c.split()[0] for c in KIND.split(", ")] + ["ids"] * with_ids
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(rows.mapInArrow(_first_round(tokenizer, capacity, end_id, open_bins, with_ids), kind))
    done, tasks, bins = found.filter("not open").select(own), 0, 0
    for number in range(1, ROUNDS + 1):
        last, bins = bins, found.filter("open").select("sequence_id").distinct().count()
        if bins <= 1 or tasks == 1 or number > 1 and 2 * bins > last:
            break
        tasks = -(-bins // MERGED)
        # the order is fixed by the rows, so that a task that runs again packs alike
        order = (F.col("length").desc(), "sequence_id", "offset")
        found = found.filter("open").repartition(tasks, "sequence_id").sortWithinPartitions(*order)
        found = written(found.mapInArrow(_next_round(number, capacity, with_ids), kind))
        done = done.unionByName(found.filter("not open").select(own))
    return done.unionByName(found.filter("open").select(own))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict = {}
