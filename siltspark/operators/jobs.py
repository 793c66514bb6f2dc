"""Backup sessions: order checks, events, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_violations(events: DataFrame, stream: str = "stream_id", order: str = "seq", timeout_s: int | None = None) -> DataFrame:
    """stream, order, event_type, error_code, error_message of events that break the protocol.

    events: event_type START, SEGMENT or END, backup_job_id, timestamp (unix seconds). A segment or end before any start
    of its stream has no active job; an end that names another job than the current one and a start while a job is
    active are reported too, as is, with a timeout, an event later than that after the stream's start. A stream is one
    connection: its events are ranked in one window."""
    before = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start, end = F.col("event_type") == "START", F.col("event_type") == "END"
    rows = events.withColumn("_job", F.last(F.when(start, F.col("backup_job_id")), True).over(before)).withColumn("_begun", F.last(F.when(start, F.col("timestamp")), True).over(before))
    rows = rows.withColumn("_open", F.last(F.when(start, F.lit(True)).when(end, F.lit(False)), True).over(before))
    none = ~start & F.col("_job").isNull()
    code = F.when(none, "FailedPrecondition").when(end & (F.col("backup_job_id") != F.col("_job")), "JobMismatch").when(start & F.coalesce("_open", F.lit(False)), "AlreadyActive")
    message = F.when(none, "No active backup job").when(end & (F.col("backup_job_id") != F.col("_job")), "end of another job").when(start, "start while a job is active")
    if timeout_s is not None:
        late = F.col("timestamp") - F.col("_begun") > timeout_s
        code, message = F.coalesce(code, F.when(late, "DeadlineExceeded")), F.coalesce(F.when(code.isNotNull(), message), F.when(late, "session timed out"))
    return rows.select(stream, order, "event_type", code.alias("error_code"), F.when(code.isNotNull(), message).alias("error_message")).filter(F.col("error_code").isNotNull())


def job_status(events: DataFrame) -> DataFrame:
    """backup_job_id, start_time, end_time, status of each job: INITIATED until its end says otherwise. Of ends in one
    second the larger status counts."""
    ends = F.col("event_type") == "END"
    out = events.filter(F.col("event_type").isin("START", "END")).groupBy("backup_job_id").agg(
        F.min(F.when(~ends, F.col("timestamp"))).alias("_start"), F.max(F.when(ends, F.col("timestamp"))).alias("_end"), F.max(F.when(ends, F.struct("timestamp", "status"))).alias("_last")
    )
    return out.select("backup_job_id", F.timestamp_seconds("_start").alias("start_time"), F.timestamp_seconds("_end").alias("end_time"), F.coalesce("_last.status", F.lit("INITIATED")).alias("status"))


def manifest(chunks: DataFrame, job: str, path: str) -> DataFrame:
    """job, path, size, chunks: for each file the array of its fingerprint, offset and size in order."""
    rows = chunks.groupBy(job, path).agg(F.array_sort(F.collect_list(F.struct("offset", "size", "fingerprint"))).alias("_c"), F.sum("size").alias("size"))
    return rows.select(job, path, "size", F.transform("_c", lambda c: F.struct(c["fingerprint"].alias("fingerprint"), c["offset"].alias("offset"), c["size"].alias("size"))).alias("chunks"))


def files_metadata(manifests: DataFrame, job: str, path: str) -> DataFrame:
    """job, files_metadata: the manifests of each job as JSON, files in order of path. A job's listing is one value, as
    the jobs table holds it; the manifest rows are the form for large jobs."""
    files = F.array_sort(F.collect_list(F.struct(F.col(path).alias("path"), "size", "chunks")))
    return manifests.groupBy(job).agg(F.to_json(F.struct(files.alias("files"))).alias("files_metadata"))
