"""Files back from their chunks, with a check of every one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltspark.config import SEGMENT_BYTES
from siltspark.functions.columns import binary_text, sha2_hex, text_binary
from siltspark.sources.files import segments


def restore_files(chunks: DataFrame, objects: DataFrame, keys: list[str], files: list[str] | None = None, path: str | None = None) -> DataFrame:
    """keys, content, size, missing_chunks, complete of each file. chunks: keys, offset, size, fingerprint; objects:
    fingerprint, chunk_data, unique. files: only those paths (None or empty: all).

    A file with a missing chunk, a gap or an overlap has null content and is not complete; it is never short without
    notice. A file is one value and must fit in one (2 GB)."""
    wanted = chunks.filter(F.col(path).isin(files)) if files and path else chunks
    rows = wanted.select(*keys, "offset", "size", "fingerprint").join(objects.select("fingerprint", "chunk_data"), "fingerprint", "left")
    part = F.struct("offset", binary_text("chunk_data").alias("s"))
    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("_p"), F.count(F.when(F.col("chunk_data").isNull(), 1)).alias("missing_chunks"), F.sum("size").alias("size"), F.max(F.col("offset") + F.col("size")).alias("_end"), F.min("offset").alias("_start"), F.sum(F.length("chunk_data")).alias("_bytes"))
    joined = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("next"), F.lit(True).alias("ok")), lambda a, p: F.struct((p["offset"] + F.length(p["s"])).alias("next"), (a["ok"] & (p["offset"] == a["next"])).alias("ok")))
    complete = (F.col("missing_chunks") == 0) & joined["ok"] & (F.col("_end") == F.col("_bytes"))
    content = text_binary(F.array_join(F.transform("_p", lambda p: p["s"]), ""))
    return whole.select(*keys, "size", "missing_chunks", F.coalesce(complete, F.lit(False)).alias("complete"), F.when(complete, content).alias("content"))


def restore_segments(restored: DataFrame, keys: list[str], restore_job_id: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The complete files as messages: restore_job_id, keys, data, offset, is_last_segment."""
    return segments(restored.filter("complete"), keys, "content", segment_bytes).select(F.lit(restore_job_id).alias("restore_job_id"), *keys, "data", "offset", "is_last_segment")


def restore_check(restored: DataFrame, originals: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, ok: whether each original file came back with the same hash. Empty files have no chunks and need none."""
    theirs = restored.select(*keys, sha2_hex("content").alias("_got"))
    mine = originals.select(*keys, sha2_hex(F.col(content)).alias("_want"), (F.coalesce(F.length(content), F.lit(0)) == 0).alias("_empty"))
    return mine.join(theirs, keys, "left").select(*keys, (F.col("_empty") | F.coalesce(F.col("_got") == F.col("_want"), F.lit(False))).alias("ok"))


def initiate_restore(unix_seconds: int) -> dict[str, str]:
    return {"restore_job_id": f"restore-{unix_seconds}", "status": "INITIATED", "message": "Restore initiated"}
