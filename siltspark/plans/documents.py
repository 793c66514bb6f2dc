"""Backup of the documents table: each document is a file of its UTF-8 bytes, its source the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.config import EngineConfig
from siltspark.operators import cache_model, dedup, jobs, metrics, restore, store
from siltspark.operators.chunking import chunk_files
from siltspark.session import materialize, scratch_path, table, widen
from siltspark.sources.files import SEGMENT_SCHEMA, job_end, job_start, segments, text_as_files

ORDER = ["job", "file_id", "chunk_index"]
LRU_CAPACITY = 300
NO_JOB = "(none)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = widen(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit(NO_JOB)).alias("job")))
    return text_as_files(docs, "doc_id", "text", "job")


def chunks(spark: SparkSession, sf_dir: str, config: EngineConfig | None = None, with_data: bool = False) -> DataFrame:
    return chunk_files(files(spark, sf_dir).drop("size"), config=config, with_data=with_data)


def file_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segments(files(spark, sf_dir).drop("size"), ["file_id"], segment_bytes=4096)
    return cut.select("file_id", "file_size", "offset", "is_last_segment", F.sha2("data", 256).alias("sha256"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).drop("job")


def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with every line break fourfold, so that boundary patterns are everywhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("replace(text, chr(10), repeat(chr(10), 4))").alias("text"))
    return chunk_files(text_as_files(docs, "doc_id", "text").drop("size"))


def chunk_blockwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, EngineConfig(max_size=1024, block_aligned=True)).drop("job")


def chunk_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, EngineConfig(hash_alg="blake3")).drop("job")


def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("file_id", "chunk_index", "size", F.substring("fingerprint", 1, 16).alias("fingerprint"))


def cut_once(spark: SparkSession, sf_dir: str, with_data: bool = False) -> DataFrame:
    """The chunks, written out, for queries that read them more than once: texts are cut and hashed once."""
    return materialize(chunks(spark, sf_dir, with_data=with_data), "chunks")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classify(cut_once(spark, sf_dir), ORDER, complete=True)


def dedup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select("file_id", "chunk_index", "outcome")


def unique_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unique_chunks(chunks(spark, sf_dir), ORDER, EngineConfig().location_prefix)


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, documents before 2025 and the others, the second against a store that has the first."""
    early = F.col("authored_at") < F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit(NO_JOB)).alias("job"), F.when(early, 1).otherwise(2).alias("batch"))
    every = materialize(chunk_files(text_as_files(widen(docs), "doc_id", "text", "job", "batch").drop("size")), "chunks")
    first, second = every.filter("batch = 1"), every.filter("batch = 2")
    out = dedup.classify(first, ORDER, complete=True).unionByName(dedup.classify(second, ORDER, first.select("fingerprint"), complete=True))
    return out.select("file_id", "chunk_index", "batch", "outcome")


def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.job_summary(files(spark, sf_dir), outcomes(spark, sf_dir), "job", ["file_id"])


def file_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_progress(files(spark, sf_dir), outcomes(spark, sf_dir), "job", ["file_id"], F.col("file_id").cast("string"))


def dedup_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dedup_ratios(chunks(spark, sf_dir), ["job"], ["file_id", "chunk_index"])


def lru_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_model.lru_outcomes(cut_once(spark, sf_dir), "fingerprint", ORDER, LRU_CAPACITY).select("file_id", "chunk_index", "hit")


def _stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(dedup.first_occurrences(chunks(spark, sf_dir), ORDER), "stored-keys")


def filter_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_model.filter_slots(dedup.first_occurrences(chunks(spark, sf_dir), ORDER), "fingerprint", ORDER, EngineConfig().filter_buckets)


def filter_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored fingerprints that the filter denies."""
    keys, buckets = _stored_keys(spark, sf_dir), EngineConfig().filter_buckets
    found = cache_model.filter_contains(keys, "fingerprint", cache_model.filter_slots(keys, "fingerprint", ORDER, buckets), buckets)
    return found.filter(~F.col("might_contain")).select("fingerprint")


def filter_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots after all keys were added and those of even documents removed."""
    keys = _stored_keys(spark, sf_dir).select(F.col("fingerprint").alias("key"), *ORDER)
    added = keys.select(F.lit("add").alias("op"), F.lit(0).alias("turn"), "key", *ORDER)
    removed = keys.filter(F.col("file_id") % 2 == 0).select(F.lit("remove").alias("op"), F.lit(1).alias("turn"), "key", *ORDER)
    return cache_model.filter_replay(added.unionByName(removed), ["turn", *ORDER], EngineConfig().filter_buckets)


def put_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put requests of all chunks; some without a fingerprint, some without data, some with another fingerprint."""
    rows = chunks(spark, sf_dir, with_data=True)
    turn = F.col("file_id") % 10
    fp = F.when(turn == 0, "").when(turn == 1, F.lit(None).cast("string")).when(turn == 2, F.reverse("fingerprint")).otherwise(F.col("fingerprint"))
    requests = rows.select("file_id", "chunk_index", fp.alias("fingerprint"), F.when(turn != 3, F.col("data")).alias("chunk_data"))
    return store.put_results(requests, EngineConfig().node_id, verify=True).select("file_id", "chunk_index", "success", "storage_location", "storage_node_id", "error_code", "error_message")


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Get requests: chunks of all documents, and their first halves as keys that nothing has."""
    rows = cut_once(spark, sf_dir, with_data=True)
    objects = _objects(rows)
    requests = rows.select("fingerprint").unionAll(rows.select(F.substring("fingerprint", 1, 32)))
    return store.get_results(requests, objects).groupBy("fingerprint", "found", "size").agg(F.count("*").alias("requests"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests, in their long form."""
    rows = jobs.manifest(chunks(spark, sf_dir), "job", "file_id")
    return rows.select("job", "file_id", F.col("size").alias("file_size"), F.posexplode("chunks").alias("position", "c")).select("job", "file_id", "file_size", "position", "c.*")


def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, sha256 of the listing that the jobs table holds of each job."""
    made = jobs.files_metadata(jobs.manifest(chunks(spark, sf_dir), "job", "file_id"), "job", "file_id")
    return made.select("job", F.sha2(F.col("files_metadata"), 256).alias("sha256"))


def _objects(rows: DataFrame) -> DataFrame:
    """The bytes of each fingerprint. First keys are found without bytes, which are then fetched for those alone."""
    firsts = dedup.first_occurrences(rows.drop("data"), ORDER)
    return rows.join(firsts.select(*ORDER), ORDER, "left_semi").select("fingerprint", F.col("data").alias("chunk_data"))


def _restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_once(spark, sf_dir, with_data=True)
    return restore.restore_files(rows.drop("data"), _objects(rows), ["file_id"])


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    originals = files(spark, sf_dir)
    checked = restore.restore_check(_restored(spark, sf_dir), originals, ["file_id"])
    return checked.join(originals.select("file_id", "size", F.sha2("content", 256).alias("sha256")), "file_id")


def restore_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = restore.restore_segments(_restored(spark, sf_dir), ["file_id"], "restore-0", 4096)
    return cut.select("restore_job_id", "file_id", "offset", "is_last_segment", F.sha2("data", 256).alias("sha256"))


def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, file_path, size, sha256 of the files a stream of their segments is put together to."""
    from siltspark.streaming.ingest import assemble

    cut = segments(files(spark, sf_dir).select(F.col("job").alias("job_id"), F.col("file_id").cast("string").alias("file_path"), "content"), ["job_id", "file_path"], segment_bytes=4096)
    landing, out, state = (scratch_path(spark, x) for x in ("landing", "assembled", "stream"))
    # Spread over files at random, so that segments of a file arrive in several micro-batches, out of order.
    cut.withColumn("file_hash", F.lit(None).cast("string")).select(*[f.name for f in SEGMENT_SCHEMA.fields]).repartition(6, F.xxhash64("file_path", "offset")).write.parquet(landing)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(SEGMENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(landing)
    query = assemble(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("job_id", "file_path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def stored_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, file_path, complete, sha256: two batches ingested into a store on disk, one job restored from it."""
    from siltspark.engine import Engine

    engine = Engine(spark, scratch_path(spark, "store"))
    every = files(spark, sf_dir).select(F.col("job").alias("job_id"), F.col("file_id").cast("string").alias("file_path"), "content")
    every = materialize(every, "files")
    odd = F.col("file_path").cast("long") % 2 == 1
    for name, part in (("even", ~odd), ("odd", odd)):
        engine.ingest(every.filter(part), F.timestamp_seconds(F.lit(0)), name)
    return engine.restore("mainline").select("job_id", "file_path", "complete", F.sha2("content", 256).alias("sha256"))


def resent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, file_path, versions, complete, sha256: all documents ingested, then all of them again, changed; what is
    restored is the last version of each."""
    from siltspark.engine import Engine

    engine = Engine(spark, scratch_path(spark, "store"))
    every = files(spark, sf_dir).select(F.lit("nightly").alias("job_id"), F.col("file_id").cast("string").alias("file_path"), "content")
    changed = every.withColumn("content", F.concat(F.lit(b"second version\n"), "content"))
    for name, part in (("first", every), ("second", changed)):
        engine.ingest(part, F.timestamp_seconds(F.lit(0)), name)
    held = engine.versions("nightly").groupBy("job_id", "file_path").agg(F.count("*").alias("versions"))
    back = engine.restore("nightly").select("job_id", "file_path", "complete", F.sha2("content", 256).alias("sha256"))
    return held.join(back, ["job_id", "file_path"])


def verify_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put requests with BLAKE3 fingerprints, those of every third document with another one."""
    rows = chunks(spark, sf_dir, EngineConfig(hash_alg="blake3"), with_data=True)
    fp = F.when(F.col("file_id") % 3 == 0, F.reverse("fingerprint")).otherwise(F.col("fingerprint"))
    requests = rows.select("file_id", "chunk_index", fp.alias("fingerprint"), F.col("data").alias("chunk_data"))
    return store.put_results(requests, EngineConfig().node_id, True, "blake3").select("file_id", "chunk_index", "success", "storage_node_id", "error_message")


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start and end message of a client that sends each document as a job of its own, in segments of 4,096 bytes."""
    path, at = F.concat(F.coalesce("repo", F.lit("")), F.lit('/"'), F.col("doc_id").cast("string"), F.lit('".txt')), F.unix_seconds(F.coalesce("authored_at", F.timestamp_seconds(F.lit(0))))
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", job_start(EngineConfig(), path, at).alias("s"), job_end(path, F.ceil(F.octet_length("text") / 4096)).alias("e"))
    return docs.select("doc_id", "s.*", "e.*")


def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, events, bytes_processed: a stream of segments is ingested and its progress events are received as a stream."""
    from siltspark.engine import Engine
    from siltspark.sources.files import segment_stream
    from siltspark.streaming.ingest import ingest_stream, progress_stream

    landing, path, state, received, seen = (scratch_path(spark, x) for x in ("landing", "store", "stream", "received", "stream"))
    cut = segments(files(spark, sf_dir).select(F.col("job").alias("job_id"), F.col("file_id").cast("string").alias("file_path"), "content"), ["job_id", "file_path"], segment_bytes=4096)
    cut.withColumn("file_hash", F.lit(None).cast("string")).select(*[f.name for f in SEGMENT_SCHEMA.fields]).repartition(4, F.xxhash64("file_path", "offset")).write.parquet(landing)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    engine = Engine(spark, path)
    ingest_stream(engine, segment_stream(spark, landing, 2), state).awaitTermination()
    progress_stream(engine).writeStream.format("parquet").option("path", received).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    events = spark.read.parquet(received)
    return events.groupBy("job_id").agg(F.count("*").alias("events"), F.max("bytes_processed").alias("bytes_processed"), F.count(F.when(F.col("line").startswith("["), 1)).alias("lines"))
