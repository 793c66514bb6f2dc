"""The engine facade: ingest files into a store, report, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.config import EngineConfig
from siltspark.operators.cache_model import latest_keys, lru_outcomes
from siltspark.operators.chunking import chunk_files
from siltspark.operators.dedup import DUPLICATE, STORED, classify
from siltspark.operators.jobs import manifest
from siltspark.operators.metrics import file_progress, job_summary
from siltspark.operators.restore import initiate_restore, restore_files, restore_segments
from siltspark.operators.store import ChunkStore, VersionedTable
from siltspark.session import materialize

KEYS = ["job_id", "file_path"]
ORDER = ["job_id", "file_path", "chunk_index"]


class Engine:
    """Backup and restore over one store. Files are DataFrames of job_id, file_path, content."""

    def __init__(self, spark: SparkSession, store_path: str | None = None, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        path = store_path or self.config.store_path
        if not path:
            raise ValueError("a store path is needed")
        self.path = path.rstrip("/")
        self.store = ChunkStore(spark, path, self.config)
        self.manifests = VersionedTable(spark, f"{path}/manifests", "job_id string, file_path string, version long, offset long, size long, fingerprint string")
        self.recent = VersionedTable(spark, f"{path}/recent", "key string, age long")

    def classify(self, chunks: DataFrame) -> DataFrame:
        """chunks with outcome. In lru mode only the last lru_capacity fingerprints are remembered, without the store;
        they are kept from one ingest to the next."""
        if self.config.mode == "exact":
            return classify(chunks, ORDER, self.store.chunks.read(), complete=True)
        hits = lru_outcomes(chunks, "fingerprint", ORDER, self.config.lru_capacity, seed=self.recent.read())
        return hits.withColumn("outcome", F.when(F.col("hit"), DUPLICATE).otherwise(STORED)).drop("hit")

    def ingest(self, files: DataFrame, now: Column | None = None, batch: str | None = None) -> DataFrame:
        """Chunk, classify and store files; the outcome of every chunk. Bytes are stored before metadata and metadata
        before manifests, so a failure in between leaves nothing that refers to bytes that aren't there; with a batch name
        the whole may be run again. A file that was ingested before under its job gets a new version; a path that
        comes twice in one ingest is two files of one version and cannot be restored."""
        # Cut and hashed once: everything below reads this.
        chunks = materialize(chunk_files(files.select(*KEYS, "content"), config=self.config, with_data=True), "chunks")
        outcomes = materialize(self.classify(chunks.drop("data")), "outcomes")
        if self.config.mode == "lru":
            self.recent.replace(latest_keys(chunks, "fingerprint", ORDER, self.config.lru_capacity, self.recent.read()))
        # Only first occurrences carry their bytes through a shuffle.
        new = chunks.join(outcomes.filter(F.col("outcome") == STORED).select(*ORDER), ORDER, "left_semi")
        self.store.put(new.select("fingerprint", F.col("data").alias("chunk_data")), self.config.verify_on_put, batch)
        self.store.insert_chunks(outcomes, ORDER, now, batch)
        if self.config.touch_on_hit:
            self.store.touch(outcomes, now, batch)
        version = self.manifests.version() + 1
        self.manifests.append(outcomes.select(*KEYS, F.lit(version).cast("long").alias("version"), "offset", "size", "fingerprint"), batch)
        return outcomes

    def _latest(self, job_id: str | None = None) -> DataFrame:
        """Manifest rows of the last version of each file."""
        rows = self.manifests.read()
        rows = rows.filter(F.col("job_id") == job_id) if job_id is not None else rows
        last = rows.groupBy(*KEYS).agg(F.max("version").alias("version"))
        return rows.join(last, [*KEYS, "version"], "left_semi")

    def summary(self, files: DataFrame, outcomes: DataFrame) -> DataFrame:
        return job_summary(files, outcomes, "job_id", KEYS)

    def progress(self, files: DataFrame, outcomes: DataFrame) -> DataFrame:
        return file_progress(files, outcomes, "job_id", KEYS, F.col("file_path"))

    def manifest(self, job_id: str | None = None) -> DataFrame:
        return manifest(self._latest(job_id), "job_id", "file_path")

    def versions(self, job_id: str) -> DataFrame:
        """job_id, file_path, version, size of every version held of a job's files."""
        return self.manifests.read().filter(F.col("job_id") == job_id).groupBy(*KEYS, "version").agg(F.sum("size").alias("size"))

    def restore(self, job_id: str, files: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Files of a job, the last version of each or the given one. files: only those paths (None or empty: all)."""
        rows = self._latest(job_id) if version is None else self.manifests.read().filter((F.col("job_id") == job_id) & (F.col("version") == version))
        return restore_files(rows, self.store.objects(), KEYS, files, "file_path")

    def restore_stream(self, job_id: str, unix_seconds: int, files: list[str] | None = None) -> DataFrame:
        return restore_segments(self.restore(job_id, files), KEYS, initiate_restore(unix_seconds)["restore_job_id"])
