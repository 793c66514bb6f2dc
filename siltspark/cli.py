"""Backup and restore from the command line: spark-submit siltspark/cli.py backup --file PATH --store PATH."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltspark.config import EngineConfig
from siltspark.engine import Engine
from siltspark.sources.files import binary_files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siltspark", description="Deduplicating backup and restore.")
    commands = out.add_subparsers(dest="command", required=True)
    backup = commands.add_parser("backup", help="chunk, deduplicate and store files")
    backup.add_argument("--file", required=True, help="file, folder or pattern")
    backup.add_argument("--client", default=EngineConfig.client_id)
    backup.add_argument("--job", help="job id; backup-<unix seconds> if not given")
    restore = commands.add_parser("restore", help="write a job's files to a folder as parquet")
    restore.add_argument("--job", required=True)
    restore.add_argument("--to", required=True)
    restore.add_argument("--only", nargs="*", default=[], help="paths; all if none is given")
    for command in (backup, restore):
        command.add_argument("--store", help="store path; SILTSPARK_STORE if not given")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """What the command did: job_id, and the job's totals or the number of files restored and refused."""
    config = EngineConfig.from_env(**({"store_path": args.store} if args.store else {}))
    engine = Engine(spark, config=config)
    if args.command == "restore":
        found = engine.restore(args.job, args.only)
        found.filter("complete").write.mode("errorifexists").parquet(args.to)
        complete = spark.read.parquet(args.to).count()
        return {"job_id": args.job, "restored": complete, "incomplete": found.count() - complete}
    now = int(time.time())
    job = args.job or f"backup-{now}"
    files = binary_files(spark, args.file).select(F.lit(job).alias("job_id"), F.col("path").alias("file_path"), "content")
    start = spark.createDataFrame([(job, args.client, config.policy_id, "INITIATED", "filesystem")], "job_id string, client_id string, backup_policy_id string, status string, source_type string")
    engine.store.create_jobs(start, F.timestamp_seconds(F.lit(now)))
    summary = engine.summary(files, engine.ingest(files, batch=job)).first()
    end = spark.createDataFrame([(job, "COMPLETED")], "job_id string, status string").withColumn("end_time", F.current_timestamp())
    engine.store.update_jobs(end)
    return summary.asDict() if summary else {"job_id": job, "files_processed": 0}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siltspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, value in run(spark, args).items():
        print(f"{name}: {value}")
    spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
