"""Counters, ratios and progress of backup jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltspark.operators.dedup import STORED, running_totals

_DUP = lambda: F.sum(F.when(F.col("outcome") != STORED, F.col("size")).otherwise(0))


def per_file(files: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunks, bytes_processed, bytes_deduplicated of every file; files without chunks have zeros."""
    sums = outcomes.groupBy(*keys).agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes_processed"), _DUP().alias("bytes_deduplicated"))
    return files.select(*keys).distinct().join(sums, keys, "left").na.fill(0, ["chunks", "bytes_processed", "bytes_deduplicated"])


def job_summary(files: DataFrame, outcomes: DataFrame, job: str, keys: list[str]) -> DataFrame:
    """Totals of each job: files_processed, chunks_processed, bytes_processed, bytes_deduplicated, message."""
    totals = per_file(files, outcomes, [job, *[k for k in keys if k != job]]).groupBy(job).agg(
        F.count("*").alias("files_processed"), F.sum("chunks").alias("chunks_processed"), F.sum("bytes_processed").alias("bytes_processed"), F.sum("bytes_deduplicated").alias("bytes_deduplicated")
    )
    return totals.withColumn("message", final_message("files_processed", "chunks_processed"))


def file_progress(files: DataFrame, outcomes: DataFrame, job: str, keys: list[str], current_file: Column) -> DataFrame:
    """The progress event of each file: job totals so far, in the order of keys."""
    totals = running_totals(per_file(files, outcomes, [job, *[k for k in keys if k != job]]), job, keys, ["bytes_processed", "bytes_deduplicated", "chunks"])
    return totals.select(job, *[k for k in keys if k != job], current_file.alias("current_file"), "bytes_processed", "bytes_deduplicated", F.concat(F.lit("Processed file: "), current_file).alias("message"))


def final_message(files: str, chunks: str) -> Column:
    return F.format_string("Backup completed. Processed %d files, %d chunks", F.col(files), F.col(chunks))


def dedup_ratios(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each group: chunks, unique_chunks, total_bytes, dedup_ratio_exact (bytes of repeats over all bytes) and
    dedup_ratio_approx (taking every unique chunk to be as large as the first); percent, 0 where there are no bytes."""
    by_fp = chunks.groupBy(*keys, "fingerprint").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"), F.max("size").alias("_one"), F.min(F.struct(*order, F.col("size").alias("_size"))).alias("_row"))
    out = by_fp.groupBy(*keys).agg(F.sum("_n").alias("chunks"), F.count("*").alias("unique_chunks"), F.sum("_bytes").alias("total_bytes"), F.sum("_one").alias("_unique"), F.min("_row").alias("_first"))
    share = lambda kept: F.when(F.col("total_bytes") > 0, F.round((F.col("total_bytes") - kept) / F.col("total_bytes") * 100, 6)).otherwise(F.lit(0.0))
    return out.select(*keys, "chunks", "unique_chunks", "total_bytes", share(F.col("_unique")).alias("dedup_ratio_exact"), share(F.col("unique_chunks") * F.col("_first._size")).alias("dedup_ratio_approx"))
