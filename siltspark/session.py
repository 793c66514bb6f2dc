"""Session helpers: shared scratch tables, small files on any file system that Spark reads, table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Only where that is unset and the session runs
    on one machine (tests) a temporary folder is made and registered; on a cluster that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltspark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path for one new table in the shared folder; no two calls give the same."""
    return f"{shared_dir(spark)}/siltspark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything that this library wrote below the shared folder. For when no result that reads it is needed."""
    remove_path(spark, f"{shared_dir(spark)}/siltspark")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and size of the files in a folder, by name; none if there is no such folder."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return []
    return sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(at) if f.isFile())


def list_folders(spark: SparkSession, path: str) -> list[str]:
    at, fs = _path(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of everything below a path."""
    at, fs = _path(spark, path)
    return fs.getContentSummary(at).getLength()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small new file; fails if there is one."""
    at, fs = _path(spark, path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def remove_path(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_parallelism(spark: SparkSession) -> int:
    """Partitions a shuffle of this session has; operators derive their bucket counts from it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def widen(scan: DataFrame) -> DataFrame:
    """A table scan with work for every core: inputs of fewer splits than cores (small or single files) are spread, all
    others stay as they are read. For scans only; the splits of a plan with shuffles are not known beforehand."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
