"""Files, text tables and client messages as DataFrames."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltspark.config import SEGMENT_BYTES, EngineConfig

SEGMENT_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("file_size", T.LongType()),
    T.StructField("data", T.BinaryType()), T.StructField("offset", T.LongType()), T.StructField("is_last_segment", T.BooleanType()),
    T.StructField("file_hash", T.StringType()),
])


def binary_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, size, modified, content of each file below path. Fails if the path is empty or does not exist. Files
    without bytes are not listed; a client sends nothing for them either."""
    if not path:
        raise ValueError("a path is needed")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def text_as_files(df: DataFrame, file_id: str, text: str, *keep: str) -> DataFrame:
    """Rows of a text table as files: file_id, keep, size in bytes, content in UTF-8. Null text is an empty file."""
    content = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    return df.select(F.col(file_id).alias("file_id"), *keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"), content.alias("content"))


def segments(files: DataFrame, keys: list[str], content: str = "content", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Cut each file into messages of segment_bytes: keys, file_size, offset, is_last_segment, data. An empty or null
    file gives no message."""
    if segment_bytes < 1:
        raise ValueError("segment_bytes must be positive")
    n = F.length(content)
    at = F.explode(F.sequence(F.lit(0), n - 1, F.lit(segment_bytes))).alias("_at")
    cut = files.filter(n > 0).select(*keys, content, n.cast("long").alias("file_size"), at)
    data = F.substring(F.col(content), F.col("_at") + 1, F.lit(segment_bytes))
    return cut.select(*keys, "file_size", F.col("_at").cast("long").alias("offset"), (F.col("_at") + segment_bytes >= F.col("file_size")).alias("is_last_segment"), data.alias("data"))


def job_start(config: EngineConfig, path: Column, unix_seconds: Column) -> Column:
    """The start message of a client as a struct; source_details is JSON with the path escaped."""
    return F.struct(
        F.lit(config.client_id).alias("client_id"), F.concat(F.lit("backup-"), unix_seconds.cast("string")).alias("backup_job_id"),
        F.lit(config.policy_id).alias("backup_policy_id"), F.lit("").alias("encryption_key_id"), unix_seconds.cast("long").alias("timestamp"),
        F.lit("filesystem").alias("source_type"), F.to_json(F.struct(path.alias("path"))).alias("source_details"),
    )


def job_end(path: Column, n_segments: Column) -> Column:
    """The end message of a client as a struct."""
    return F.struct(F.lit("COMPLETED").alias("status"), F.format_string("Backed up %s in %d segments", path, n_segments.cast("long")).alias("summary"))


def segment_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Segments that land as parquet files in a folder, as a stream."""
    return spark.readStream.schema(SEGMENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def random_bytes(size: int, seed: int = 0) -> bytes:
    """Seeded bytes for fixtures."""
    return random.Random(seed).randbytes(size)
