"""Has this key been seen before? An exact ledger of keys on disk, hash-partitioned into buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.session import default_parallelism, scratch_path

_LAST = (1 << 63) - 1


class KeyLedger:
    """All keys admitted so far, with the position at which each came first.

    On disk the ledger is a parquet table bucketed by key. A batch is reduced to its first position of each key (a
    combinable minimum, so one key with a third of the rows costs one row per task), brought into the ledger's buckets
    and sort-merge joined with it; the ledger itself is never shuffled, and no task holds more than the sort buffers
    of a bucket, which spill. New keys are appended as a generation. Answers are exact: the error rate is zero.

    Ranks within a key come from its first position: a row is a repeat if it isn't at the key's first position. Rows
    find that by a join on (position, key), which is as even as the positions are, whatever the keys."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """path: where the ledger lives; the same path and buckets open it again. buckets: fixed when it is made; size
        them so that one bucket of the whole history sorts in a task."""
        self.spark = spark
        self.buckets = buckets or default_parallelism(spark)
        self.path = path or scratch_path(spark, "ledger")
        self.name = f"siltspark_ledger_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (key BINARY, first_at BIGINT, generation BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.empty = spark.table(self.name).limit(1).count() == 0

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, firsts: DataFrame) -> int:
        # Generations have random names: a name never means two sets of files, whoever else opened the ledger.
        generation = uuid.uuid4().int >> 66
        rows = firsts.select("key", "first_at", F.lit(generation).alias("generation"))
        rows.repartition(self.buckets, "key").sortWithinPartitions("key").write.mode("append").insertInto(self.name)
        self.empty = False
        return generation

    def _new(self, batch: DataFrame, key: Column, at: Column) -> DataFrame:
        """key, first_at of the batch's keys that the ledger lacks."""
        firsts = batch.select(key.alias("key"), F.coalesce(at.cast("long"), F.lit(_LAST)).alias("at")).filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("at").alias("first_at"))
        if self.empty:
            return firsts
        known = self.keys().select("key", F.lit(True).alias("known")).hint("merge")
        return firsts.join(known, "key", "left").filter(F.col("known").isNull()).select("key", "first_at")

    def learn(self, batch: DataFrame, key: Column) -> int:
        """Append the keys of a history that has no positions."""
        return self._append(self._new(batch, key, F.lit(None)))

    def admit(self, batch: DataFrame, key: Column, at: str) -> DataFrame:
        """Append the batch's new keys and answer for each of its rows: at, key, seen.

        seen: the key is in the ledger from before, or in a batch row with a smaller `at`. A null key is never seen and
        is not kept. A null `at` counts as after all others; rows tied at a key's first position are all new, so give
        positions without ties where copies must count. Empty batches and an empty ledger are fine; other columns of
        the batch are ignored, whatever their names."""
        at_col = F.coalesce(F.col(f"`{at}`").cast("long"), F.lit(_LAST))
        generation = self._append(self._new(batch, key, F.col(f"`{at}`")))
        new = self.keys().filter(F.col("generation") == generation).select(F.col("key").alias("_k"), F.col("first_at").alias("_a"), F.lit(True).alias("_new"))
        # Away from the buckets of keys: a key with a third of the rows would have one task.
        new = new.repartition("_a", "_k")
        rows = batch.select(F.col(f"`{at}`").alias("at"), at_col.alias("_at"), key.alias("key"))
        out = rows.join(new, (F.col("_at") == F.col("_a")) & (F.col("key") == F.col("_k")), "left")
        return out.select(F.col("at").alias(at), "key", (F.col("key").isNotNull() & F.col("_new").isNull()).alias("seen"))


def answer_errors(answers: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """rows, without_key, seen, wrong, error_rate of a batch's answers, from a recount by another way: of each key all
    rows but one are repeats, and that one too if the key is in history (column key). wrong is the summed difference
    between seen rows and that count."""
    known = history.filter(F.col("key").isNotNull()).select("key").distinct().withColumn("known", F.lit(1))
    per_key = answers.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("seen").cast("long")).alias("s"))
    wrong = per_key.join(known, "key", "left").agg(F.coalesce(F.sum(F.abs(F.col("s") - F.col("n") + 1 - F.coalesce("known", F.lit(0)))), F.lit(0)).alias("wrong"), F.coalesce(F.sum("n"), F.lit(0)).alias("_with"), F.coalesce(F.sum("s"), F.lit(0)).alias("seen"))
    total = answers.agg(F.count("*").alias("rows"))
    # Both sides are one row each.
    return total.join(wrong, F.lit(True)).select("rows", (F.col("rows") - F.col("_with")).alias("without_key"), "seen", "wrong", F.when(F.col("rows") > 0, F.col("wrong") / F.col("rows")).otherwise(0.0).alias("error_rate"))
