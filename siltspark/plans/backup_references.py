"""Orphan references of the backup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.functions.columns import fingerprint_bytes, month
from siltspark.operators.nested import listed_chunks
from siltspark.operators.references import orphans_by_mask, temporal_orphans
from siltspark.session import table


def job_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, t, source_key, period of each distinct reference from a job's file listing to a chunk. Fingerprints are bytes
    here, half as wide as their digits."""
    jobs = table(spark, sf_dir, "backup_jobs")
    rows = listed_chunks(jobs, ["job_id", "start_time", "end_time"])
    return rows.select(F.unhex("fingerprint").alias("key"), F.col("end_time").alias("t"), F.col("job_id").alias("source_key"), month("start_time").alias("period")).distinct()


def chunk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, t, source_key, period of each distinct reference from a chunk to the object that should hold it."""
    rows = table(spark, sf_dir, "chunks").select(fingerprint_bytes("storage_location").alias("key"), F.col("last_referenced_time").alias("t"), fingerprint_bytes("fingerprint").alias("source_key"), month("creation_time").alias("period"))
    return rows.filter(F.col("key").isNotNull() & F.col("source_key").isNotNull())


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, period, source_key, target_key, kind: one row for each distinct orphan reference."""
    none = F.lit(None).cast("timestamp")
    chunks = table(spark, sf_dir, "chunks").select(fingerprint_bytes("fingerprint").alias("key"), F.col("creation_time").alias("begin"), none.alias("end"), F.lit(False).alias("always"))
    held = table(spark, sf_dir, "wellknown_chunks").select(fingerprint_bytes("fingerprint").alias("key"), none.alias("begin"), none.alias("end"), F.lit(True).alias("always"))
    deletions = table(spark, sf_dir, "gc_log").select(fingerprint_bytes("fingerprint").alias("key"), F.col("deleted_at").alias("at"))
    objects = table(spark, sf_dir, "chunk_store").select(fingerprint_bytes("object_key").alias("key"), F.col("stored_at").alias("begin"), F.col("deleted_at").alias("end"), F.lit(False).alias("always"))
    digits = lambda c: F.lower(F.hex(c))
    found = [
        ("backup_jobs", F.col("source_key"), temporal_orphans(job_references(spark, sf_dir), chunks.unionByName(held), deletions)),
        ("chunks", digits("source_key"), temporal_orphans(chunk_references(spark, sf_dir), objects)),
    ]
    parts = [df.select(F.lit(name).alias("source_table"), "period", source.alias("source_key"), digits("key").alias("target_key"), "kind") for name, source, df in found]
    return parts[0].unionByName(parts[1]).distinct()


def orphans_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, period, kind, orphans, sources: counts per table and month."""
    return orphans(spark, sf_dir).groupBy("source_table", "period", "kind").agg(F.count("*").alias("orphans"), F.count_distinct("source_key").alias("sources"))


def arrivals_without_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arrival_no, mask: arrivals whose (job_id, client_id) agrees with no backup job; client_id may be null."""
    jobs = table(spark, sf_dir, "backup_jobs").select("job_id", "client_id")
    return orphans_by_mask(table(spark, sf_dir, "chunk_arrivals").select("arrival_no", "job_id", "client_id"), jobs, ["job_id", "client_id"], match="partial").select("arrival_no", "mask")
