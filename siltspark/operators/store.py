"""A content-addressed chunk store and the metadata tables of chunks and jobs, as parquet with versioned commits.

A table is a folder of data folders and a log. A commit writes data first and then one small log entry that lists the
data folders of the new version; readers use the last entry. A failed writer leaves unlisted data and no trace in what
is read, and no path that a plan reads is ever overwritten. One writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltspark.config import EngineConfig
from siltspark.functions.columns import storage_location
from siltspark.operators.chunking import fingerprint as fingerprint_of
from siltspark.operators.dedup import first_occurrences
from siltspark.session import list_files, list_folders, path_bytes, read_bytes, remove_path, write_bytes

CHUNKS = "fingerprint string, storage_location string, size long, creation_time timestamp, last_referenced_time timestamp"
CHUNK_DATA = "fingerprint string, chunk_data binary, size long, prefix string"
JOBS = "job_id string, client_id string, backup_policy_id string, start_time timestamp, end_time timestamp, status string, source_type string, source_details string, files_metadata string"


class VersionedTable:
    """A table of data folders under versioned commits. path may be on any file system that Spark reads. However many
    commits there were, reading is one scan of the folders that the last one lists."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: list[str] | None = None, merge_at: int = 16):
        """merge_at: folders beyond which an append merges the newest ones."""
        self.spark, self.path, self.schema, self.partition_by, self.merge_at = spark, path.rstrip("/"), T.StructType.fromDDL(schema), partition_by or [], merge_at

    def version(self) -> int:
        return max((int(n[:-5]) for n, _ in list_files(self.spark, f"{self.path}/_log") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"folders": [], "properties": {}, "batches": []}
        return json.loads(read_bytes(self.spark, f"{self.path}/_log/{version:012d}.json"))

    def read(self) -> DataFrame:
        return self._scan(self.entry()["folders"])

    def _scan(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # A folder is a partition by name, so that one scan can have partitions of its own below each.
        scan = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders])
        return scan.select(*[f"`{f.name}`" for f in self.schema.fields])

    def _commit(self, entry: dict) -> int:
        version = self.version() + 1
        write_bytes(self.spark, f"{self.path}/_log/{version:012d}.json", json.dumps(entry).encode())  # fails if another writer was first
        return version

    def _write(self, df: DataFrame) -> str:
        folder = f"commit={uuid.uuid4().hex}"
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]
        df.select(*columns).write.partitionBy(*self.partition_by).parquet(f"{self.path}/{folder}")
        return folder

    def append(self, df: DataFrame, batch: str | None = None, properties: dict | None = None) -> int:
        """Add rows. A batch name that was committed before adds nothing, so a repeated delivery is harmless."""
        entry = self.entry()
        if batch is not None and batch in entry["batches"]:
            return self.version()
        folder = self._write(df)
        version = self._commit({"folders": [*entry["folders"], folder], "properties": entry["properties"] | (properties or {}), "batches": [*entry["batches"], *[batch] * (batch is not None)]})
        return self.merge() if len(entry["folders"]) >= self.merge_at else version

    def replace(self, df: DataFrame) -> int:
        """Put df in place of all rows; df may be read from this table."""
        entry = self.entry()
        return self._commit({**entry, "folders": [self._write(df)]})

    def merge(self) -> int:
        """Merge the newest folders into one: all that are no larger than what is newer, so that every row is written a
        logarithmic number of times."""
        entry = self.entry()
        sizes = [path_bytes(self.spark, f"{self.path}/{f}") for f in entry["folders"]]
        n, total = 1, sizes[-1] if sizes else 0
        while n < len(sizes) and (sizes[-1 - n] <= total or n < self.merge_at // 2):
            total += sizes[-1 - n]
            n += 1
        if n < 2 or not sizes:
            return self.version()
        merged = self._write(self._scan(entry["folders"][-n:]))
        return self._commit({**entry, "folders": [*entry["folders"][:-n], merged]})

    def vacuum(self) -> int:
        """Remove the folders and log entries that the last version does not need; the number of folders removed. For
        when nothing reads an older version any more."""
        kept, last = set(self.entry()["folders"]), self.version()
        gone = [f for f in list_folders(self.spark, self.path) if f.startswith("commit=") and f not in kept]
        for f in gone:
            remove_path(self.spark, f"{self.path}/{f}")
        for name, _ in list_files(self.spark, f"{self.path}/_log"):
            if name.endswith(".json") and int(name[:-5]) < last:
                remove_path(self.spark, f"{self.path}/_log/{name}")
        return len(gone)


def update_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the non-key columns of new where the key is in both; keys that only new has are not added. Keys of new
    are unique; a null key updates nothing."""
    fresh = new.filter(F.col(key).isNotNull()).select(key, F.struct(*[c for c in old.columns if c != key]).alias("_new"))
    joined = old.join(fresh, key, "left")
    return joined.select(*[F.col(c) if c == key else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns])


def put_results(requests: DataFrame, node_id: str, verify: bool = False, hash_alg: str = "sha2") -> DataFrame:
    """requests (fingerprint, chunk_data) with success, storage_location, storage_node_id, error_code, error_message: the
    answer to each. Missing fingerprints and missing data are refused; with verify, data whose hash_alg hash differs too."""
    no_fp, no_data = F.coalesce(F.col("fingerprint"), F.lit("")) == "", F.coalesce(F.length("chunk_data"), F.lit(0)) == 0
    wrong = (fingerprint_of("chunk_data", hash_alg) != F.col("fingerprint")) if verify else F.lit(False)
    message = F.when(no_fp, "fingerprint is required").when(no_data, "chunk_data is required").when(wrong, "fingerprint does not match chunk_data")
    ok = message.isNull()
    return requests.select("*", ok.alias("success"), F.when(ok, F.col("fingerprint")).alias("storage_location"), F.when(ok, F.lit(node_id)).alias("storage_node_id"), F.when(~ok, "InvalidArgument").alias("error_code"), message.alias("error_message"))


def get_results(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """requests (fingerprint) with chunk_data, size, found, error_code, error_message. objects has one row a
    fingerprint. A missing object is no error; an empty or null fingerprint is."""
    empty = F.coalesce(F.col("fingerprint"), F.lit("")) == ""
    held = objects.select("fingerprint", "chunk_data", F.lit(True).alias("_there"))
    out = requests.join(held, "fingerprint", "left")
    found = F.coalesce("_there", F.lit(False)) & ~empty
    return out.select(*requests.columns, "chunk_data", F.when(found, F.length("chunk_data").cast("long")).alias("size"), found.alias("found"), F.when(empty, "InvalidArgument").alias("error_code"), F.when(empty, "fingerprint is required").alias("error_message"))


def exists_results(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """requests (fingerprint) with exists and size (null where there is none), without reading bytes. objects:
    fingerprint, size, one row a fingerprint. Null and empty fingerprints don't exist."""
    held = objects.select("fingerprint", F.col("size").alias("_size"), F.lit(True).alias("_there"))
    out = requests.join(held, "fingerprint", "left")
    return out.select(*[f"`{c}`" for c in requests.columns if c not in ("exists", "size")], F.coalesce("_there", F.lit(False)).alias("exists"), F.col("_size").alias("size"))


def with_touches(chunks: DataFrame, touches: DataFrame) -> DataFrame:
    """Chunk metadata with last_referenced_time moved on by touches (fingerprint, at): the latest of both. Touches are
    combined before they are shuffled, so one chunk may hold most of them; touches of unknown chunks play no part."""
    latest = touches.groupBy("fingerprint").agg(F.max("at").alias("_at"))
    return chunks.join(latest, "fingerprint", "left").withColumn("last_referenced_time", F.greatest("last_referenced_time", "_at")).select(*chunks.columns)


def with_job_defaults(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """jobs with the columns a job row has; start_time is now where it is missing."""
    now = F.current_timestamp() if now is None else now
    fields = T.StructType.fromDDL(JOBS).fields
    cols = [(F.col(f"`{f.name}`") if f.name in jobs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    return jobs.select(*cols).withColumn("start_time", F.coalesce("start_time", now))


class ChunkStore:
    """Chunk bytes, chunk metadata, touches and jobs below one path. Bytes and metadata are separate tables, so that no
    scan of metadata reads bytes. The hash algorithm is recorded at the first write; another one is refused."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.data = VersionedTable(spark, f"{path}/chunk_data", CHUNK_DATA, ["prefix"])
        self.chunks = VersionedTable(spark, f"{path}/chunks", CHUNKS)
        self.touches = VersionedTable(spark, f"{path}/touches", "fingerprint string, at timestamp")
        self.jobs = VersionedTable(spark, f"{path}/backup_jobs", JOBS)
        known = self.data.entry()["properties"].get("hash_alg")
        if known and known != self.config.hash_alg:
            raise ValueError(f"this store holds {known} fingerprints, not {self.config.hash_alg}")

    def objects(self) -> DataFrame:
        return self.data.read()

    def put(self, requests: DataFrame, verify: bool = False, batch: str | None = None) -> DataFrame:
        """Store fingerprint, chunk_data rows; one row of a fingerprint is kept and one already held stays, as equal
        fingerprints mean equal bytes. Returns the answer to each request."""
        results = put_results(requests, self.config.node_id, verify, self.config.hash_alg)
        good = results.filter("success").select("fingerprint", "chunk_data").dropDuplicates(["fingerprint"])
        new = good.join(self.objects().select("fingerprint"), "fingerprint", "left_anti")
        # The first two digits as a folder: a lookup by fingerprint reads one of 256.
        self.data.append(new.select("fingerprint", "chunk_data", F.length("chunk_data").alias("size"), F.substring("fingerprint", 1, 2).alias("prefix")), batch, {"hash_alg": self.config.hash_alg})
        return results

    def get(self, requests: DataFrame) -> DataFrame:
        return get_results(requests, self.objects())

    def exists(self, requests: DataFrame) -> DataFrame:
        """requests with exists and size, without reading bytes."""
        return exists_results(requests, self.objects())

    def metadata(self) -> DataFrame:
        """Metadata of all chunks, with the touches since."""
        return with_touches(self.chunks.read(), self.touches.read())

    def lookup(self, requests: DataFrame) -> DataFrame:
        """requests with the metadata of their chunks, null where there is none."""
        return requests.join(self.metadata(), "fingerprint", "left")

    def insert_chunks(self, outcomes: DataFrame, order: list[str], now: Column | None = None, batch: str | None = None) -> None:
        """Metadata of the chunks that are new."""
        now = F.current_timestamp() if now is None else now
        firsts = first_occurrences(outcomes.filter("outcome = 'STORED'"), order, ["size"])
        fresh = firsts.join(self.chunks.read().select("fingerprint"), "fingerprint", "left_anti")
        self.chunks.append(fresh.select("fingerprint", storage_location("fingerprint", self.config.location_prefix).alias("storage_location"), "size", now.alias("creation_time"), now.alias("last_referenced_time")), batch)

    def touch(self, outcomes: DataFrame, now: Column | None = None, batch: str | None = None) -> None:
        """Move last_referenced_time of the chunks that were met again: their fingerprints and the time are appended,
        and merged into the metadata when it is read or folded."""
        now = F.current_timestamp() if now is None else now
        met = outcomes.filter("outcome like 'DEDUPLICATED%'").select("fingerprint").distinct()
        self.touches.append(met.select("fingerprint", now.alias("at")), batch)

    def fold_touches(self) -> None:
        """Write the touches into the metadata and begin anew."""
        self.chunks.replace(self.metadata())
        self.touches.replace(self.touches.read().limit(0))

    def update_chunks(self, new: DataFrame) -> None:
        self.chunks.replace(update_by_key(self.chunks.read(), new, "fingerprint"))

    def create_jobs(self, jobs: DataFrame, now: Column | None = None) -> None:
        """Add jobs; a job_id that is held or comes twice is an error. A job without start_time starts now."""
        again = jobs.groupBy("job_id").count().filter("count > 1 or job_id is null").limit(1).count() or jobs.join(self.jobs.read(), "job_id", "left_semi").limit(1).count()
        if again:
            raise ValueError("job_id must be new, unique and not null")
        self.jobs.append(with_job_defaults(jobs, now))

    def update_jobs(self, new: DataFrame) -> None:
        """Set the columns of new (job_id and any others) in the jobs it names."""
        old = self.jobs.read()
        same = old.join(new.select("job_id"), "job_id", "left_semi").select("job_id", *[c for c in old.columns if c not in new.columns])
        self.jobs.replace(update_by_key(old, new.join(same, "job_id"), "job_id"))

    def find_jobs(self, client_id: str | None = None, status: str | None = None) -> DataFrame:
        """The jobs of a client, of a status, or both."""
        return select_jobs(self.jobs.read(), client_id, status)

    def verify_fingerprints(self) -> DataFrame:
        """Objects whose bytes do not have their fingerprint."""
        return self.objects().filter(fingerprint_of("chunk_data", self.config.hash_alg) != F.col("fingerprint")).select("fingerprint", "size")

    def vacuum(self) -> int:
        """Remove what no table's last version needs."""
        return sum(t.vacuum() for t in (self.data, self.chunks, self.touches, self.jobs))


def select_jobs(jobs: DataFrame, client_id: str | None = None, status: str | None = None) -> DataFrame:
    """The jobs of a client, of a status, or both; the equalities reach the scan."""
    for column, value in (("client_id", client_id), ("status", status)):
        if value is not None:
            jobs = jobs.filter(F.col(column) == value)
    return jobs


def invalid_rows(df: DataFrame, not_null: list[str], key: str) -> DataFrame:
    """One row a constraint: its name and the number of rows that break it."""
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in not_null]).unpivot([], not_null, "constraint", "rows").withColumn("constraint", F.concat(F.col("constraint"), F.lit(" not null")))
    repeated = df.filter(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") - 1).alias("n")).agg(F.lit(f"{key} unique").alias("constraint"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return nulls.unionByName(repeated)


def latest_jobs(states: DataFrame, order: str) -> DataFrame:
    """The last state of each job among states delivered in any order; ties go to the larger row."""
    rest = [c for c in states.columns if c != "job_id"]
    last = F.max(F.struct(order, *[c for c in rest if c != order])).alias("_last")
    return states.groupBy("job_id").agg(last).select("job_id", *[F.col(f"_last.{c}").alias(c) for c in rest])

