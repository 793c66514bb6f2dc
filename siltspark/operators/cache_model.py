"""Models of bounded memory: a least-recently-used cache of fingerprints and a one-slot-per-bucket filter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltspark.functions.columns import weak_hash
from siltspark.session import default_parallelism, materialize


#: Summaries of ranges that are combined at a time.
AT_ONCE = 8


def _recent(keys: list[str], capacity: int) -> list[str]:
    """The last capacity distinct keys of an access log, oldest first."""
    out: dict[str, None] = {}
    for k in reversed(keys):
        out.setdefault(k)
        if len(out) == capacity:
            break
    return list(reversed(out))


def latest_keys(accesses: DataFrame, key: str, order: list[str], capacity: int, seed: DataFrame | None = None) -> DataFrame:
    """key, age of what an LRU cache of the capacity holds after the accesses, age 0 being the oldest. seed: what it
    held before, in the same form. The result has at most capacity rows, a parameter."""
    last = accesses.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.max(F.struct(*order)).alias("at"))
    found = [r["key"] for r in last.orderBy(F.desc("at")).limit(capacity).select("key").collect()][::-1]
    before = [r["key"] for r in seed.orderBy("age").collect()] if seed is not None else []
    kept = _recent([*before, *found], capacity)
    return accesses.sparkSession.createDataFrame([(k, i) for i, k in enumerate(kept)], "key string, age long")


def lru_outcomes(accesses: DataFrame, key: str, order: list[str], capacity: int, ranges: int | None = None, seed: DataFrame | None = None) -> DataFrame:
    """accesses with hit boolean: whether an LRU cache of the capacity holds the key when it is reached in order. The
    cache starts with the keys of seed (key, age; see latest_keys), or empty. Each access, hit or miss, makes its key
    the most recent. order must be unique; rows with a null key never hit and leave the cache as it is.

    Exact and parallel: the cache before any position is just the last capacity distinct keys, so each range of the
    order reports its own last keys. These summaries combine: of neighbours the last keys of the latest one, then of the
    one before. In log(ranges) rounds each range combines what it has with that of AT_ONCE ranges, each round that many
    times as far back, and then holds the cache it starts from; the ranges are replayed independently. A row holds at
    most AT_ONCE summaries of capacity keys."""
    spark = accesses.sparkSession
    ranges = ranges or default_parallelism(spark)
    names = accesses.columns
    slim = accesses.select(F.struct(*[F.col(f"`{c}`") for c in order]).alias("_pos"), F.col(f"`{key}`").alias("key"))
    ranged = slim.filter(F.col("key").isNotNull()).repartitionByRange(ranges, "_pos").withColumn("range", F.spark_partition_id())
    # Range bounds come from a sample; written out, a retried task cannot move them.
    ranged = materialize(ranged.select("range", F.col("_pos").alias("at"), F.col("key").cast("string")), "lru-ranges")
    last = ranged.groupBy("range", "key").agg(F.max("at").alias("at"))
    order_of = lambda df: df.select("range", "key", *[F.col(f"at.`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    o_cols = [f"o{i}" for i in range(len(order))]
    summary_schema = "range int, keys array<string>"

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"range": [pdf["range"].iloc[0] + 1], "keys": [pdf.sort_values(o_cols)["key"].tail(capacity).tolist()]})

    # What the range before leaves behind; the first range starts from the seed.
    start = order_of(last).groupBy("range").applyInPandas(summary, summary_schema).filter(F.col("range") < ranges)
    first = [r["key"] for r in seed.orderBy("age").collect()][-capacity:] if seed is not None else []
    every = spark.range(ranges).select(F.col("id").cast("int").alias("range"))
    start = every.join(start, "range", "left").unionByName(spark.createDataFrame([(0, first)], summary_schema))
    start = start.groupBy("range").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    merged = F.udf(lambda parts: _recent([k for p in sorted(parts, key=lambda p: -p["back"]) for k in p["keys"] or []], capacity), "array<string>")
    reach = 1
    while reach < ranges:
        # Each round reads the one before once, so the plan grows by a round and no more.
        ahead = start.select(F.explode(F.sequence(F.lit(0), F.lit(AT_ONCE - 1))).alias("back"), "range", "keys")
        ahead = ahead.select((F.col("range") + F.col("back") * reach).alias("range"), F.struct("back", "keys").alias("part")).filter(F.col("range") < ranges)
        start = ahead.groupBy("range").agg(F.collect_list("part").alias("parts")).select("range", merged("parts").alias("keys"))
        reach *= AT_ONCE
    types = dict(slim.select("_pos.*").dtypes)

    def replay(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        cache: dict[str, None] = dict.fromkeys(held["keys"].iloc[0]) if len(held) else {}
        rows = pdf.sort_values(o_cols)
        hits = []
        for k in rows["key"]:
            hit = k in cache
            if hit:
                del cache[k]
            cache[k] = None
            if len(cache) > capacity:
                del cache[next(iter(cache))]
            hits.append(hit)
        return rows[o_cols].assign(hit=hits)

    schema = ", ".join(f"o{i} {types[c]}" for i, c in enumerate(order)) + ", hit boolean"
    hits = order_of(ranged).groupBy("range").cogroup(start.groupBy("range")).applyInPandas(replay, schema)
    hits = hits.select(*[F.col(f"o{i}").alias(c) for i, c in enumerate(order)], F.col("hit").alias("_hit"))
    out = accesses.drop("hit").join(hits, order, "left")
    return out.select(*[f"`{c}`" for c in names if c != "hit"], F.coalesce("_hit", F.lit(False)).alias("hit"))


def cache_replay(log: DataFrame, cache: str, order: list[str], capacity: int, filter_buckets: int) -> DataFrame:
    """The answers of caches to a log of put, get, remove, contains, size and clear (columns cache, op, key and order):
    cache, order, op, key, answer (get, contains, remove: 1 or 0; size: the number of keys held; else null).

    A cache is an LRU list of the capacity with a one-slot-per-bucket filter beside it. put and a get that hits make
    the key the most recent, and put evicts the least recent beyond the capacity. put adds to the filter, remove takes
    from both and tells whether the list had the key; contains asks the filter alone, which a clear leaves as it is.
    Ops with a null key where one is needed answer 0.

    What a cache holds depends on all before it, so the list is replayed in order, apart for each cache and each
    stretch between two clears. The filter needs no replay: a slot holds the hash of the bucket's last put, unless that
    hash has been removed since."""
    names = [F.col(cache).alias("cache"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]]
    o_cols = [f"o{i}" for i in range(len(order))]
    rows = log.select(*names, "op", F.col("key").cast("string").alias("key"), weak_hash(F.col("key").cast("string")).alias("h"))
    at = F.struct(*o_cols)
    cleared = Window.partitionBy("cache").orderBy(*o_cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("epoch", F.coalesce(F.sum(F.when(F.col("op") == "clear", 1).otherwise(0)).over(cleared), F.lit(0)))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(filter_buckets)))
    put = (F.col("op") == "put") & F.col("key").isNotNull()
    removed = (F.col("op") == "remove") & F.col("key").isNotNull()
    before = Window.partitionBy("cache", "bucket").orderBy(*o_cols).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("cache", "bucket", "h").orderBy(*o_cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("slot", F.last(F.when(put, F.struct(F.col("h"), at.alias("at"))), True).over(before)).withColumn("gone", F.last(F.when(removed, at), True).over(same))
    there = (F.col("slot.h") == F.col("h")) & (F.col("gone").isNull() | (F.col("gone") < F.col("slot.at")))
    rows = rows.withColumn("there", F.coalesce(there, F.lit(False)))
    types = dict(rows.dtypes)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, None] = {}
        pdf = pdf.sort_values(o_cols)
        answers: list[int | None] = []
        for op, key, there in zip(pdf["op"], pdf["key"], pdf["there"]):
            known = key is not None and key in held
            answer = None
            if op == "put" and key is not None:
                held.pop(key, None)
                held[key] = None
                if len(held) > capacity:
                    del held[next(iter(held))]
            elif op == "get":
                answer = int(known)
                if known:
                    held[key] = held.pop(key)
            elif op == "remove":
                answer = int(known)
                held.pop(key, None)
            elif op == "contains":
                answer = int(there)
            elif op == "size":
                answer = len(held)
            answers.append(answer)
        return pdf[["cache", *o_cols, "op", "key"]].assign(answer=pd.array(answers, dtype="Int64"))

    schema = f"cache {types['cache']}, " + "".join(f"o{i} {types[f'o{i}']}, " for i in range(len(order))) + "op string, key string, answer long"
    out = rows.groupBy("cache", "epoch").applyInPandas(replay, schema)
    return out.select(F.col("cache").alias(cache), *[F.col(f"o{i}").alias(c) for i, c in enumerate(order)], "op", "key", "answer")


def filter_slots(keys: DataFrame, key: str, order: list[str], buckets: int) -> DataFrame:
    """bucket, slot: the hash the filter keeps in each bucket after adding the keys in order; the last one wins.
    Null keys are not added."""
    h = weak_hash(key)
    rows = keys.filter(F.col(key).isNotNull()).select(F.pmod(h, F.lit(buckets)).alias("bucket"), h.alias("_h"), F.struct(*order).alias("_o"))
    return rows.groupBy("bucket").agg(F.max_by("_h", "_o").alias("slot"))


def filter_contains(probes: DataFrame, key: str, slots: DataFrame, buckets: int) -> DataFrame:
    """probes with might_contain: the bucket's slot equals the key's hash. An empty bucket holds zero, which is also
    the hash of the empty key. A null key is not contained."""
    h = weak_hash(key)
    asked = probes.drop("might_contain").withColumn("_b", F.pmod(h, F.lit(buckets)))
    # One slot a bucket, so the right side has at most `buckets` rows, a parameter.
    out = asked.join(F.broadcast(slots.select(F.col("bucket").alias("_b"), F.col("slot").alias("_slot"))), "_b", "left")
    return out.select(*[f"`{c}`" for c in probes.columns if c != "might_contain"], F.coalesce(h == F.coalesce("_slot", F.lit(0).cast("long")), F.lit(False)).alias("might_contain"))


def filter_replay(events: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """bucket, slot after a log of add and remove events (columns op, key). A remove empties the slot only if it holds
    the key's hash, so each bucket's events are folded in order; buckets are independent of each other."""
    h = weak_hash("key")
    rows = events.filter(F.col("key").isNotNull() & F.col("op").isin("add", "remove")).select(F.pmod(h, F.lit(buckets)).alias("bucket"), h.alias("h"), "op", F.struct(*order).alias("o"))
    # After the bucket's last add only removals follow: the slot is that add's hash unless one of them names it.
    adds = rows.filter("op = 'add'").groupBy("bucket").agg(F.max_by("h", "o").alias("slot"), F.max("o").alias("at"))
    gone = rows.filter("op = 'remove'").join(adds, "bucket").filter((F.col("o") > F.col("at")) & (F.col("h") == F.col("slot"))).select("bucket").distinct()
    return adds.join(gone.withColumn("_gone", F.lit(True)), "bucket", "left").select("bucket", F.when(F.col("_gone"), F.lit(0).cast("long")).otherwise(F.col("slot")).alias("slot"))
