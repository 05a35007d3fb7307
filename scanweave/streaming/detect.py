"""Detection on sweeps as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.pipeline import BATCH, cones
from ..sources.readers import lidar_stream


def start_detection(spark: SparkSession, source: str, sink: str, checkpoint: str, cfg: Config = BATCH, files: int = 8) -> StreamingQuery:
    """Cones of every sweep file that appears in `source`, appended to `sink`; a file holds whole sweeps. It works off
    what there is and stops; run again, it goes on from its checkpoint. A batch that is run again is written again to
    the same folder of its number, so it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        cones(batch, cfg).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return lidar_stream(spark, source, files).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
