"""Readers of sweeps, samples, latency profiles and cluster logs. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from .. import schema

C = F.col


def lidar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.POINTS).parquet(path)


def imu(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.IMU).parquet(path)


def _stream(spark: SparkSession, kind: str, files: int) -> DataStreamReader:
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files)


def lidar_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """Sweeps as they arrive in a folder, at most so many files a trigger."""
    return _stream(spark, schema.POINTS, files).parquet(path)


def imu_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    return _stream(spark, schema.IMU, files).parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A recording is the same files, read as a batch; an empty path is no recording."""
    return lidar(spark, path) if path else spark.createDataFrame([], schema.POINTS)


def json_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all profiler_*.json files under a folder, gzipped ones too, tagged with their run's algorithm, which may
    be null. Malformed and empty files, and those without metadata, give no rows. A task holds one document."""
    docs = spark.read.schema(schema.PROFILE).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "profiler_*.json{,.gz}").json(path)
    return docs.filter("metadata is not null").select(C("metadata.algorithm").alias("algorithm"), F.inline("raw_frames"))


def json_deskew(spark: SparkSession, path: str) -> DataFrame:
    """The same, of runs that have displacements."""
    return json_profiles(spark, path).filter("deskew_avg_translation_m is not null")


def csv_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all clusters_*.csv files, with the algorithm of the file's name: first letter upper, the rest lower."""
    rows = spark.read.schema(schema.CLUSTERS).option("header", True).option("pathGlobFilter", "clusters_*.csv").csv(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"clusters_(.*)\.csv", 1)
    return rows.select("*", F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1000))).alias("algorithm"))


def configs(spark: SparkSession, path: str) -> DataFrame:
    """(algorithm, config): each config_*.json file as text."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "config_*.json").text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"config_(.*)\.json", 1)
    return rows.select(F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1000))).alias("algorithm"), C("value").alias("config"))


def decode_points(messages: DataFrame, offset: int = 0, step: int = 16) -> DataFrame:
    """Points of messages (frame_id, data binary): little-endian float x, y, z, intensity, `step` bytes apart."""
    from ..operators.decode import decode

    return decode(messages, offset, step)
