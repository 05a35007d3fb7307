"""Decoding of packed point messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

OUT = "frame_id bigint, point_idx bigint, x double, y double, z double, intensity double"


def decode(messages: DataFrame, offset: int = 0, step: int = 16) -> DataFrame:
    """Points of messages (frame_id, data binary): four little-endian floats every `step` bytes from `offset` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, data in zip(b.column("frame_id").to_pylist(), b.column("data").to_pylist(), strict=True):
                n = max(0, (len(data or b"") - offset) // step)
                raw = np.frombuffer(data or b"", np.uint8, n * step, offset).reshape(n, step)[:, :16].copy().view("<f4").astype(np.float64)
                cols = [pa.array(np.full(n, frame, np.int64)), pa.array(np.arange(n)), *(pa.array(raw[:, k]) for k in range(4))]
                yield pa.RecordBatch.from_arrays(cols, ["frame_id", "point_idx", "x", "y", "z", "intensity"])

    return messages.select("frame_id", "data").mapInArrow(run, OUT)
