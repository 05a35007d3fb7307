"""Marks: a bitmap of 64-bit keys that scans carry along to leave out rows that cannot count.

A key sets two bits; a row whose key has both set passes. Every marked key passes, and a few others by chance, so what
follows must not be changed by rows too many. There are 16 to 32 bits a key, up to MOST_BITS (32 MB), which is all that
the driver and each task ever hold; with more keys than fit, more rows pass, and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, release

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Bits of one bitmap that Spark builds, and rows that are looked at and given back at a time.
PART, ROWS = 32768, 512


@dataclass(frozen=True)
class Marks:
    """`bits` packed, the least bit of a byte first."""

    bits: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(U)
        mask = U(len(self.bits) * 8 - 1)
        low, high = keys & mask, (keys >> U(32)) & mask
        return np.logical_and(*((self.bits[p >> U(3)] >> (p & U(7)).astype(np.uint8)) & 1 for p in (low, high))).astype(bool)

    def keep(self, rows: DataFrame, key: str, others: bool = False) -> DataFrame:
        """Rows whose key is marked, or all others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    hit = self.has(part.column(key).to_numpy(zero_copy_only=False)) != others
                    if hit.any():
                        yield part.filter(pa.array(hit))
                release()

        return rows.mapInArrow(run, rows.schema)


def marks(keys: DataFrame, key: str) -> Marks:
    """Marks of a column of well-mixed hashes without nulls. `keys` is a written table: it is counted first."""
    bits = min(max(LEAST_BITS, 1 << (16 * max(keys.count(), 1) - 1).bit_length()), MOST_BITS)
    mask = F.lit(bits - 1).cast("long")
    places = F.array(F.col(key).bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask))
    places = keys.select(F.explode(places).alias("p")).select((F.col("p") / PART).cast("long").alias("part"), (F.col("p") % PART).alias("p"))
    out = np.zeros((bits // PART, PART // 8), np.uint8)
    for r in places.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("p").alias("bits")).toLocalIterator():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return Marks(out.reshape(-1))
