"""Queries over the backup tables and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.config import EngineConfig
from siltspark.functions.columns import fingerprint_key
from siltspark.operators import cache_model, jobs, store
from siltspark.operators.dedup import first_occurrences
from siltspark.session import scratch_path, table
from siltspark.sources.files import binary_files


def update_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint, size, storage_location: the first row of each chunk, updated from the object store."""
    key = fingerprint_key("fingerprint").alias("fingerprint")
    held = first_occurrences(table(spark, sf_dir, "chunks").select(key, "size", "storage_location", "creation_time"), ["creation_time", "size", "storage_location"])
    fresh = table(spark, sf_dir, "chunk_store").select(fingerprint_key("object_key").alias("fingerprint"), "size").groupBy("fingerprint").agg(F.max("size").alias("size"))
    fresh = fresh.select("fingerprint", "size", F.concat(F.lit(EngineConfig().location_prefix), "fingerprint").alias("storage_location"))
    return store.update_by_key(held.select("fingerprint", "size", "storage_location"), fresh, "fingerprint")


def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, status, end_time of the last state delivered of each job."""
    states = table(spark, sf_dir, "backup_jobs").select("job_id", "end_time", "status", "client_id")
    return store.latest_jobs(states, "end_time").select("job_id", "status", "end_time")


def recent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks not referenced since the start of 2025, as a scan for eviction would list them."""
    return table(spark, sf_dir, "chunks").filter(F.col("last_referenced_time") < F.to_timestamp(F.lit("2025-01-01 00:00:00"))).select("fingerprint", "size", "last_referenced_time")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.invalid_rows(table(spark, sf_dir, "chunks"), ["fingerprint", "storage_location", "size", "creation_time", "last_referenced_time"], "fingerprint")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as sessions: every seventh event starts a job, every following one ends a job."""
    n = F.col("event_id")
    kind = F.when(n % 7 == 0, "START").when(n % 7 == 1, "END").otherwise("SEGMENT")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("stream_id"), n.alias("seq"), kind.alias("event_type"), F.concat(F.lit("job-"), (n % 5).cast("string")).alias("backup_job_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.when(n % 2 == 0, "COMPLETED").otherwise("FAILED").alias("status"))


def session_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.session_violations(session_events(spark, sf_dir), timeout_s=EngineConfig().timeout_s)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backup_job_id, start_time, end_time, status of the jobs of the event log."""
    return jobs.job_status(session_events(spark, sf_dir))


def _first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = fingerprint_key("fingerprint").alias("fingerprint")
    rows = table(spark, sf_dir, "chunks").select(key, "storage_location", "size", "creation_time", "last_referenced_time")
    return first_occurrences(rows, ["creation_time", "size", "storage_location", "last_referenced_time"])


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint, size, creation_time of each fingerprint that arrives, looked up in a store that has the chunks."""
    held = store.ChunkStore(spark, scratch_path(spark, "store"))
    held.chunks.append(_first_chunks(spark, sf_dir))
    asked = table(spark, sf_dir, "chunk_arrivals").select(fingerprint_key("fingerprint").alias("fingerprint")).filter(F.col("fingerprint").isNotNull()).distinct()
    return held.lookup(asked).select("fingerprint", "size", "creation_time")


def touched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint, last_referenced_time of the chunks, moved on by every arrival."""
    touches = table(spark, sf_dir, "chunk_arrivals").select(fingerprint_key("fingerprint").alias("fingerprint"), F.col("observed_at").alias("at"))
    return store.with_touches(_first_chunks(spark, sf_dir), touches.filter(F.col("fingerprint").isNotNull())).select("fingerprint", "last_referenced_time")


def object_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint, exists, size of every chunk's object."""
    objects = table(spark, sf_dir, "chunk_store").select(fingerprint_key("object_key").alias("fingerprint"), "size").filter(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.max("size").alias("size"))
    asked = table(spark, sf_dir, "chunks").select(fingerprint_key("fingerprint").alias("fingerprint")).distinct()
    return store.exists_results(asked, objects)


def created_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of the table, created in a store that fills in a start time where it is missing: here for odd starts."""
    states = table(spark, sf_dir, "backup_jobs").select("job_id", "client_id", "backup_policy_id", F.when(F.unix_seconds("start_time") % 2 == 0, F.col("start_time")).alias("start_time"), "end_time", "status", "source_type")
    held = store.ChunkStore(spark, scratch_path(spark, "store"))
    held.create_jobs(store.latest_jobs(states, "end_time"), F.to_timestamp(F.lit("2020-01-01 00:00:00")))
    return held.jobs.read().select("job_id", "client_id", "start_time", "status")


def jobs_of_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.select_jobs(table(spark, sf_dir, "backup_jobs"), client_id=EngineConfig().client_id).select("job_id", "status", "start_time")


def jobs_of_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.select_jobs(table(spark, sf_dir, "backup_jobs"), status="FAILED").select("job_id", "client_id", "start_time")


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as calls of fifty caches: puts and gets, now and then a removal, a question to the filter, a count
    of the keys, and rarely a clear."""
    n = F.col("event_id")
    op = F.when(n % 101 == 0, "clear").when(n % 13 == 0, "remove").when(n % 7 == 0, "contains").when(n % 11 == 0, "size").when(n % 2 == 0, "put").otherwise("get")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("cache"), n.alias("seq"), op.alias("op"), F.concat(F.lit("k"), F.pmod(n * 7 + F.floor(n / 8), F.lit(23)).cast("string")).alias("key"))


def cache_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of the caches, which are large enough here to evict nothing (evictions: lru_outcomes)."""
    return cache_model.cache_replay(cache_log(spark, sf_dir), "cache", ["seq"], EngineConfig().lru_capacity, EngineConfig().filter_buckets)


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, size, sha256 of files on disk: a line about each nation, written to a folder of its own and scanned."""
    path = scratch_path(spark, "files")
    table(spark, sf_dir, "nation").select("n_name", F.concat("n_name", F.lit(" of region "), F.col("n_regionkey").cast("string")).alias("value")).write.partitionBy("n_name").text(path)
    found = binary_files(spark, path, "*.txt")
    name = F.replace(F.regexp_extract("path", "n_name=([^/]+)/", 1), F.lit("%20"), F.lit(" "))
    return found.select(name.alias("name"), "size", F.sha2("content", 256).alias("sha256"))
