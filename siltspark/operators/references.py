"""References to records that do not exist.

A reference is a composite key, parts of which may be null. References are grouped by null mask; each mask is matched
on its non-null columns only, under declared semantics (orphans_by_mask). Where one part of the key is a time, the
match is not equality but life: the target must live at that time (temporal_orphans)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltspark.session import materialize

#: Targets and references of one key meet by the hour; groups of one task are those of one key and hour.
BUCKET_S = 3600
#: References without a time are equal for all rows of a key, so a key's rows are spread over that many groups.
SALTS = 64
_NEVER, _ALWAYS = -(1 << 62), 1 << 62


def orphans_by_mask(refs: DataFrame, targets: DataFrame, keys: list[str], target_keys: list[str] | None = None, match: str = "simple") -> DataFrame:
    """The rows of refs that refer to no row of targets, with mask: the key columns that are null, joined by commas.

    match, as in SQL: simple - a reference with any null refers to nothing and is no orphan; full - all null is no
    reference, partly null is an orphan; partial - all null is no reference, partly null must agree with some target
    on its non-null columns. Null target columns agree with nothing. Repeated rows stay repeated; empty tables are
    fine. Every mask is an anti-join on its own columns with the distinct targets projected to them, so a column that
    holds nulls never turns a join into a filter over pairs."""
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"unknown match {match!r}")
    target_keys = target_keys or keys
    out = None
    for present in product((True, False), repeat=len(keys)):
        used = [k for k, p in zip(keys, present) if p]
        lacks = [k for k, p in zip(keys, present) if not p]
        if not used or (lacks and match == "simple"):
            continue
        condition = F.lit(True)
        for k, p in zip(keys, present):
            condition = condition & (F.col(f"`{k}`").isNotNull() if p else F.col(f"`{k}`").isNull())
        part = refs.drop("mask").filter(condition)
        if not (lacks and match == "full"):
            there = targets.select(*[F.col(f"`{t}`").alias(f"_t{i}") for i, (t, p) in enumerate(zip(target_keys, present)) if p]).na.drop().distinct()
            on = [part[f"`{k}`"] == there[f"_t{i}"] for i, (k, p) in enumerate(zip(keys, present)) if p]
            part = part.join(there, on, "left_anti")
        part = part.withColumn("mask", F.lit(",".join(lacks)))
        out = part if out is None else out.unionByName(part)
    return out


def lives(refs: DataFrame, targets: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """key, at, alive, begun of what refs (key, t, salt) ask for, once or more for each pair: whether a target of the key lives
    at that time, whether one begins by it, null at all if the key has no target. See temporal_orphans.

    No pair of references and targets is formed. Rows of one key are put in order of time, targets before references
    of the same time, and what lives is a running maximum. The groups are (key, hour), or (key, salt) for references
    without a time; what earlier hours leave behind is carried over from per-hour maxima, which are combined before
    the shuffle. So a key with a third of all rows is spread over its hours and salts."""
    micros = lambda c: F.unix_micros(c)
    null = F.lit(None).cast("long")
    state = ("born", "ends", "gone", "begun")
    is_ref = F.col("turn") == 1
    asked = [F.lit(0).alias("salt")]
    r = refs.select(
        "key", F.coalesce(micros("t"), F.lit(_ALWAYS)).alias("at"), F.lit(1).alias("turn"), *[null.alias(s) for s in state], F.lit(False).alias("there"), "salt",
    )
    always = F.coalesce(F.col("always"), F.lit(False))
    begin = F.when(always, F.lit(_NEVER)).otherwise(F.coalesce(micros("begin"), F.lit(_NEVER)))
    born = always | F.col("begin").isNotNull()
    t = targets.filter(F.col("key").isNotNull()).select(
        "key", begin.alias("at"), F.lit(0).alias("turn"), F.when(always, F.lit(_ALWAYS)).when(born, micros("begin")).alias("born"),
        F.when(born, F.when(always, F.lit(_ALWAYS + 1)).otherwise(F.coalesce(micros("end"), F.lit(_ALWAYS + 1)))).alias("ends"), null.alias("gone"), F.lit(1).cast("long").alias("begun"), F.lit(True).alias("there"), *asked,
    )
    events = r.unionByName(t)
    if deletions is not None:
        events = events.unionByName(deletions.filter(F.col("key").isNotNull() & F.col("at").isNotNull()).select("key", micros("at").alias("at"), F.lit(0).alias("turn"), null.alias("born"), null.alias("ends"), micros("at").alias("gone"), null.alias("begun"), F.lit(False).alias("there"), *asked))
    bucket = F.when(F.col("at").isin(_NEVER, _ALWAYS), F.col("at")).otherwise(F.floor(F.col("at") / (BUCKET_S * 1000000)))
    events = events.withColumn("bucket", bucket)

    group = ["key", "bucket", "salt"]
    sums = events.groupBy(*group).agg(*[F.max(s).alias(s) for s in state], F.max("there").alias("there"), F.max(is_ref).alias("asked"))
    by_key = Window.partitionBy("key")
    before = by_key.orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*group, "asked", *[F.max(s).over(before).alias(s) for s in state], F.max("there").over(by_key).alias("there")).filter("asked")
    carried = carried.select("key", null.alias("at"), F.lit(-1).alias("turn"), *state, "there", "salt", "bucket")
    w = Window.partitionBy(*group).orderBy(F.col("at").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(carried).select("key", "at", "turn", *[F.max(s).over(w).alias(s) for s in state], F.max("there").over(w).alias("there")).filter(is_ref)
    alive = F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("born") > F.col("gone"))) & (F.col("ends") > F.col("at"))
    return seen.filter("there").select("key", "at", F.coalesce(alive, F.lit(False)).alias("alive"), F.col("begun").isNotNull().alias("begun"))


def temporal_orphans(refs: DataFrame, targets: DataFrame, deletions: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """The rows of refs whose target does not live at their time, with kind.

    refs: key (string or binary), t timestamp, any other columns. targets: key, begin timestamp, end timestamp (null: none), always
    boolean (lives at any time). deletions: key, at. A target row lives at t if begin <= t, t < end and no deletion of
    its key lies in [begin, t]. kind: missing - the key has no target row; late - all its rows begin after t; else
    deleted. Null masks: a null key refers to nothing and is dropped (match simple); a null t means the end of all
    time. A target row with a null begin exists but never lives. A target has an end or deletions, not both.

    The composite key is (key, t), and references are grouped by its null mask. Those with a time are anti-joined on
    (key, t) with the pairs at which a target lives, those without one on the key alone with the keys alive at the end
    of all time; kinds come from anti-joins of the orphans with the keys that have targets and the pairs by which one
    has begun. The pairs (made by `lives`) and the orphans are written out, so that no join makes them again. A key with a third
    of the references has many times; where it has none, adaptive execution splits its side of the join."""
    own = [f"`{c}`" for c in refs.columns if c not in ("kind", "_at")]
    r = refs.filter(F.col("key").isNotNull()).select(*own, F.unix_micros("t").alias("_at"))
    salt = F.when(F.col("t").isNull(), F.pmod(F.xxhash64(*own), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    known = materialize(lives(r.select("key", "t", salt.alias("salt")), targets, deletions), "lives").withColumnRenamed("at", "_at")
    living = known.filter("alive")
    timed = r.filter(F.col("_at").isNotNull()).join(living.filter(F.col("_at") != _ALWAYS).select("key", "_at"), ["key", "_at"], "left_anti")
    open_ = r.filter(F.col("_at").isNull()).join(living.filter(F.col("_at") == _ALWAYS).select("key"), "key", "left_anti")
    orphans = materialize(timed.select(*own, "_at").unionByName(open_.select(*own, F.lit(_ALWAYS).alias("_at"))), "orphans")
    missing = orphans.join(known.select("key"), "key", "left_anti").withColumn("kind", F.lit("missing"))
    there = orphans.join(known.select("key"), "key", "left_semi")
    begun = known.filter("begun and not alive").select("key", "_at")
    late = there.join(begun, ["key", "_at"], "left_anti").withColumn("kind", F.lit("late"))
    deleted = there.join(begun, ["key", "_at"], "left_semi").withColumn("kind", F.lit("deleted"))
    return missing.select(*own, "kind").unionByName(late.select(*own, "kind")).unionByName(deleted.select(*own, "kind"))
