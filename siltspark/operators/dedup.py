"""Exact classification of chunks against each other and against a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltspark.functions.columns import storage_location
from siltspark.session import default_parallelism, materialize

STORED, DUPLICATE, KNOWN = "STORED", "DEDUPLICATED", "DEDUPLICATED (from DB)"


def _order(order: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in order])


def first_occurrences(chunks: DataFrame, order: list[str], carry: list[str] | None = None, fp: str = "fingerprint") -> DataFrame:
    """One row per fingerprint: its smallest order and, of that row, carry. A combinable aggregate: a fingerprint that
    holds a third of all rows is reduced before the shuffle. Null fingerprints give none."""
    named = [*order, *[c for c in carry or [] if c not in order]]
    # The least order itself, where nothing else is carried, is half the aggregation buffer.
    least = F.min(_order(order)) if len(named) == len(order) else F.min_by(F.struct(*[F.col(f"`{c}`") for c in named]), _order(order))
    return chunks.filter(F.col(fp).isNotNull()).groupBy(fp).agg(least.alias("_first")).select(fp, *[F.col(f"_first.`{c}`").alias(c) for c in named])


def classify(chunks: DataFrame, order: list[str], store: DataFrame | None = None, fp: str = "fingerprint", complete: bool = False) -> DataFrame:
    """chunks with outcome: STORED for the first row of a new fingerprint in the given order, DEDUPLICATED (from DB)
    for the first row of one that the store has, DEDUPLICATED for all later rows. Scope is the whole input, whatever
    its job. The order must be unique and not null. Rows without a fingerprint have a null outcome. complete: all
    rows have one; then no fingerprint is computed again for the rows that only get their mark.

    The decision is keyed on the order columns, not on the fingerprint: only first rows are marked, and joined back on
    their unique order, so no group of equal fingerprints is ever gathered in one task."""
    firsts = first_occurrences(chunks, order, fp=fp)
    if store is not None:
        known = store.select(F.col("fingerprint").alias(fp)).filter(F.col(fp).isNotNull()).distinct().withColumn("_known", F.lit(True))
        firsts = firsts.join(known, fp, "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(None).cast("boolean"))
    marks = firsts.select(*order, F.when(F.col("_known"), KNOWN).otherwise(STORED).alias("_mark"))
    out = chunks.drop("outcome").join(marks, order, "left")
    outcome = F.coalesce("_mark", F.lit(DUPLICATE))
    outcome = outcome if complete else F.when(F.col(fp).isNotNull(), outcome)
    return out.select(*[f"`{c}`" for c in chunks.columns if c != "outcome"], outcome.alias("outcome"))


def unique_chunks(chunks: DataFrame, order: list[str], prefix: str, fp: str = "fingerprint") -> DataFrame:
    """fingerprint, storage_location, size of each distinct fingerprint; size is that of its first row."""
    firsts = first_occurrences(chunks, order, ["size"], fp)
    return firsts.select(F.col(fp).alias("fingerprint"), storage_location(fp, prefix).alias("storage_location"), "size")


def running_totals(per_file: DataFrame, job: str, order: list[str], sums: list[str], ranges: int | None = None) -> DataFrame:
    """per_file with each of sums replaced by its running total within the job, in the given order (unique in a job).

    Rows are put into ranges of (job, order); a window covers a job's rows of one range, and what earlier ranges add up
    to is taken from their sums, so one large job is shared out like many small ones."""
    spark = per_file.sparkSession
    names = per_file.columns
    ranged = per_file.repartitionByRange(ranges or default_parallelism(spark), job, *order).withColumn("_range", F.spark_partition_id())
    # Range bounds come from a sample; written out, a retried task cannot move them.
    ranged = materialize(ranged, "totals")
    earlier = Window.partitionBy(job).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(job, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    before = before.select(F.col(job).alias("_job"), F.col("_range").alias("_r"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy(job, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(*[F.sum(c).over(within).alias(c) if c in sums else F.col(c) for c in names], "_range")
    out = summed.join(before, summed[job].eqNullSafe(F.col("_job")) & (F.col("_range") == F.col("_r")))
    return out.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in sums else F.col(c) for c in names])
