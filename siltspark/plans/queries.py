"""The registry of core queries over the test tables, with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.operators.nested import flatten_listings, listed_chunks
from siltspark.plans import backup_references, documents, tables
from siltspark.plans.sql import oracle_sql
from siltspark.session import table

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup_references.orphans(spark, sf_dir)


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup_references.orphans_per_period(spark, sf_dir)


def p2_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup_references.arrivals_without_job(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_chunks(table(spark, sf_dir, "backup_jobs"), ["job_id"]).distinct()


def _listing(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Rows of one job delivered in several states stay apart by the hash of their text; copies are one row.
        jobs = table(spark, sf_dir, "backup_jobs").select("job_id", F.md5("files_metadata").alias("state"), "files_metadata").filter(F.col("state").isNotNull())
        firsts = jobs.groupBy("job_id", "state").agg(F.first("files_metadata").alias("files_metadata"))
        rows = flatten_listings(firsts, name, ["job_id", "state"])
        # The whole entry is for tables of other forms; here its two fields tell all.
        return rows.drop("entry").withColumn("perms", F.array_join(F.from_json("perms", "array<string>"), ",")) if name == "access" else rows

    run.__name__ = f"p4_{name}"
    return run


def queries() -> dict[str, Query]:
    d, t = documents, tables
    found: list[Query] = [
        d.file_segments, d.chunk_documents, d.chunk_boundaries, d.chunk_blockwise, d.chunk_blake3, d.chunk_listing, d.dedup_outcomes, d.unique_chunks,
        d.incremental_ingest, d.job_summary, d.file_progress, d.dedup_ratios, d.lru_outcomes, d.filter_slots, d.filter_misses, d.filter_removals,
        d.put_validation, d.chunk_lookup, d.manifest, d.manifest_json, d.restore_roundtrip, d.restore_segments, d.streamed_files, d.stored_backup,
        d.resent_files, d.verify_blake3, d.session_messages, d.streamed_progress,
        t.update_chunks, t.latest_jobs, t.recent_chunks, t.constraints, t.session_violations, t.job_events, t.chunk_metadata, t.touched_chunks,
        t.object_exists, t.created_jobs, t.jobs_of_client, t.jobs_of_status, t.cache_facade, t.scanned_files,
        p2_found, p2_counts, p2_arrivals, p4_found, *map(_listing, ("files", "chunks", "attributes", "access")),
    ]
    return {f.__name__: f for f in found}
