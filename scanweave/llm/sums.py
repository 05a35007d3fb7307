"""Tables of whole-number counters of fixed size, added up over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

KIND = "chunk int, task int, sums binary"


def _rows(chunks, blobs: list[bytes]) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([task] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "task", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk that the task meets; holds the table's fixed size at most."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column("chunk").to_pylist(), b.column("sums").to_pylist(), strict=True):
            v = np.frombuffer(x, np.int64)
            total[c] = total[c] + v if c in total else v
    if total:
        yield _rows(total, [v.tobytes() for v in total.values()])


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, chunks: int = 64) -> np.ndarray:
    """Sum over all tasks of count(batches), a table of `size` counters. Tables are added in two steps, so that no
    task reads every task's table when there are many; `size` numbers come to the driver."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = count(batches).astype(np.int64).reshape(chunks, -1)
        full = [k for k in range(chunks) if parts[k].any()]
        if full:
            yield _rows(full, [parts[k].tobytes() for k in full])

    got = rows.mapInArrow(own, KIND)
    from pyspark.sql import functions as F

    got = got.repartition("chunk", F.col("task") % 64).mapInArrow(_add, KIND).repartition("chunk").mapInArrow(_add, KIND)
    out = np.zeros((chunks, size // chunks), np.int64)
    for r in got.select("chunk", "sums").collect():
        out[r["chunk"]] += np.frombuffer(r["sums"], np.int64)
    return out.reshape(size)
