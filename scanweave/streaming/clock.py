"""Running clock offsets per sensor, kept as state between triggers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import clock_step

OUT = "sensor bigint, seq bigint, offset bigint"


def offsets_stream(arrivals: DataFrame) -> DataFrame:
    """(sensor, seq, offset) of a stream of (sensor, seq, raw_ns, ref_ns). The rows of a trigger are taken in order of seq."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, offset = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for diff in (rows["raw_ns"] - rows["ref_ns"]).tolist():
            first, offset = clock_step(first, offset, int(diff))
            out.append(offset)
        state.update((first, offset))
        yield pd.DataFrame({"sensor": key[0], "seq": rows["seq"].to_numpy(), "offset": out})

    return arrivals.groupBy("sensor").applyInPandasWithState(fold, OUT, "first bigint, offset bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_imu(frames: DataFrame, samples: DataFrame, half_ms: int = 150, delay: str = "300 milliseconds") -> DataFrame:
    """Stream of sweeps (alias f) with the samples (alias s) around each: an equality on buckets as wide as the window, of
    which a sweep meets two, and the range itself, whose watermarks let old samples go. Both sides have an event time `ts`."""
    from pyspark.sql import functions as F

    bucket = lambda by: F.floor((F.unix_millis("ts") + by) / (2 * half_ms))
    f = frames.withWatermark("ts", delay).withColumn("bucket", F.explode(F.sequence(bucket(-half_ms), bucket(half_ms)))).alias("f")
    s = samples.withWatermark("ts", delay).withColumn("bucket", bucket(0)).alias("s")
    near = F.expr(f"f.bucket = s.bucket and s.ts between f.ts - interval {half_ms} milliseconds and f.ts + interval {half_ms} milliseconds")
    return f.join(s, near)
