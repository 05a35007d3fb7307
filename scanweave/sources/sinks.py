"""Writers of results: profiles, cluster logs, configs, detections, points and markers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..schema import CLUSTERS, PHASES

C = F.col
#: Colour of a marker by cone colour.
COLORS = {"BLUE": (0.0, 0.0, 1.0), "YELLOW": (1.0, 1.0, 0.0), "ORANGE": (1.0, 0.5, 0.0), "ORANGE_BIG": (1.0, 0.3, 0.0), "UNKNOWN": (0.7, 0.7, 0.7)}


def _profile_frame() -> Column:
    """A frame of a profile: milliseconds to 3 and metres to 5 digits."""
    ms = [F.round(c, 3).alias(c) for c in (*PHASES, "total_ms")]
    metres = [F.round(c, 5).alias(c) for c in ("deskew_avg_translation_m", "deskew_max_translation_m")]
    return F.struct("frame_id", *ms, "cones_detected", *metres)


def profile_documents(log: DataFrame) -> DataFrame:
    """One JSON document per algorithm: metadata and frames, milliseconds to 3 and metres to 5 digits. A document is a
    run's log, a row per frame."""
    docs = log.groupBy("algorithm").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(_profile_frame())).alias("raw_frames"))
    return docs.select("algorithm", F.to_json(F.struct(F.struct("algorithm", C("n").alias("total_frames")).alias("metadata"), "raw_frames")).alias("value"))


def write_profile_files(log: DataFrame, path: str, frames: int = 20_000) -> None:
    """profiler_*.json.gz files, a document each, under the name that readers look for. Each task writes what it has of an
    algorithm, in order, and begins another document after so many frames: nothing is shuffled, a document fits in a
    task, and the driver only renames. total_frames is that of the document. Rows without an algorithm are in documents
    whose algorithm is null."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []

        def closed() -> pa.RecordBatch:
            # the name comes as JSON text, and so do the frames
            return pa.RecordBatch.from_arrays([pa.array([f'{{"metadata":{{"algorithm":{head},"total_frames":{len(held)}}},"raw_frames":[{",".join(held)}]}}'])], ["value"])

        for batch in batches:
            for name, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (name != head or len(held) == frames):
                    yield closed()
                    held = []
                head = name
                held.append(frame)
        if held:
            yield closed()

    name = F.regexp_extract(F.to_json(F.struct("algorithm"), {"ignoreNullFields": "false"}), r'(?s)^\{"algorithm":(.*)\}$', 1)
    rows = log.sortWithinPartitions("algorithm", "frame_id").select(name.alias("algorithm"), F.to_json(_profile_frame()).alias("frame"))
    rows.mapInArrow(documents, "value string").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    spark = log.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    for k, part in enumerate(parts):
        if not fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(folder, f"profiler_{k}.json.gz")):
            raise OSError(f"{part} could not be renamed")


def write_profiles(log: DataFrame, path: str) -> None:
    """A folder per algorithm with profiler JSON, and the rows themselves as Parquet beside."""
    profile_documents(log).write.mode("overwrite").partitionBy("algorithm").text(f"{path}/json")
    log.write.mode("overwrite").partitionBy("algorithm").parquet(f"{path}/parquet")


def cluster_rows(clusters: DataFrame) -> DataFrame:
    """The 20 columns of a cluster log, in order, four digits."""
    names = [c.split()[:2] for c in CLUSTERS.split(", ")]
    return clusters.select(*(F.round(n, 4).alias(n) if t == "double" else C(n).cast(t).alias(n) for n, t in names))


def write_clusters(clusters: DataFrame, path: str) -> None:
    cluster_rows(clusters).write.mode("overwrite").option("header", True).csv(path)


def write_config(spark: SparkSession, cfg: Config, path: str) -> None:
    spark.createDataFrame([(cfg.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def cone_cloud(cones: DataFrame) -> DataFrame:
    """Detections as points; the intensity is the range."""
    return cones.select("frame_id", "cluster_id", "x", "y", "z", C("range").alias("intensity"))


def numbered_cones(cones: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return cones.withColumn("cone_no", F.row_number().over(Window.partitionBy("frame_id").orderBy("cluster_id")))


def cone_points(members: DataFrame, cones: DataFrame) -> DataFrame:
    """Points of accepted cones; the intensity is the cone's number in its frame, from 1."""
    ids = numbered_cones(cones).select("frame_id", "cluster_id", "cone_no")
    return members.join(ids, ["frame_id", "cluster_id"]).select("frame_id", "point_idx", "x", "y", "z", C("cone_no").cast("double").alias("intensity"))


def obstacle_cloud(members: DataFrame) -> DataFrame:
    """Points of merged clusters, not all obstacles."""
    return members.filter(C("cluster_id").isNotNull()).select("frame_id", "point_idx", "x", "y", "z", "intensity")


def lidar_viz(points: DataFrame, debug: bool = True) -> DataFrame:
    """The compensated, truncated sweep; nothing unless debugging."""
    return points if debug else points.limit(0)


def markers(cones: DataFrame) -> DataFrame:
    """Per cone a cylinder and a label, per frame two commands that clear the old ones."""
    ids = numbered_cones(cones)
    color = F.create_map(*(F.lit(v) for k, rgb in COLORS.items() for v in (k, "{:.1f},{:.1f},{:.1f}".format(*rgb))))
    tall = F.greatest(F.lit(0.1), C("height"))
    none = F.lit(None)
    shape = lambda ns, kind, z, scale, text: F.struct(F.lit(ns).alias("ns"), F.lit(kind).alias("type"), C("cone_no").alias("id"), z.alias("z"), scale.alias("scale_z"), text.cast("string").alias("text"))
    pair = F.array(shape("cones", "CYLINDER", C("z") + C("height") / 2.0, tall, none), shape("labels", "TEXT", C("z") + C("height") + 0.20, F.lit(0.3), F.format_string("%.1fm", C("range"))))
    own = ids.select("frame_id", "x", "y", F.element_at(color, C("color")).alias("rgb"), F.explode(pair).alias("m")).select("frame_id", "m.ns", "m.type", "m.id", "x", "y", "m.z", "m.scale_z", "rgb", "m.text")
    clear = cones.select("frame_id").distinct().select("frame_id", F.explode(F.array(F.lit("cones"), F.lit("labels"))).alias("ns"))
    blank = {"type": F.lit("DELETEALL"), "id": F.lit(0), "x": none.cast("double"), "y": none.cast("double"), "z": none.cast("double"), "scale_z": none.cast("double"), "rgb": none.cast("string"), "text": none.cast("string")}
    return clear.select("frame_id", "ns", *(v.alias(k) for k, v in blank.items())).unionByName(own)


def run_queue(stream: DataFrame, write, checkpoint: str):
    """Results of a stream handed to write(batch, id) once per trigger. A bounded queue that drops the oldest has no
    meaning for batches: the source's rate limit bounds what is in flight, and nothing is dropped."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").start()
