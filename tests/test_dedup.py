import random
from collections import OrderedDict

from conftest import rows
from pyspark.sql import functions as F

from siltspark.operators import cache_model, dedup, metrics

SCHEMA = "job string, file int, idx int, fingerprint string, size long"


def data(n=400, seed=1):
    rng = random.Random(seed)
    return [("j%d" % (i % 3), i // 5, i % 5, None if rng.random() < 0.05 else "hot" if rng.random() < 0.35 else "f%d" % rng.randrange(90), rng.randrange(1, 9)) for i in range(n)]


def test_classify_with_hot_and_null_keys(spark):
    table = data()
    store = spark.createDataFrame([("f1",), ("f2",), ("f2",), (None,)], "fingerprint string")
    got = dict(((r["file"], r["idx"]), r["outcome"]) for r in dedup.classify(spark.createDataFrame(table, SCHEMA), ["file", "idx"], store).collect())
    seen = set()
    for _, file, idx, fp, _ in sorted(table, key=lambda r: r[1:3]):
        want = None if fp is None else "DEDUPLICATED" if fp in seen else "DEDUPLICATED (from DB)" if fp in ("f1", "f2") else "STORED"
        seen.add(fp)
        assert got[file, idx] == want
    assert dedup.classify(spark.createDataFrame([], SCHEMA), ["file", "idx"]).count() == 0


def test_invariants_and_ratios(spark):
    df = spark.createDataFrame([r for r in data() if r[3]], SCHEMA).withColumn("size", F.length("fingerprint").cast("long"))
    out = dedup.classify(df, ["file", "idx"])
    t = out.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("outcome") == "STORED", F.col("size"))).alias("stored"), F.count_distinct("fingerprint").alias("u"), F.count(F.when(F.col("outcome") == "STORED", 1)).alias("n")).first()
    assert t["u"] == t["n"]
    ratios = metrics.dedup_ratios(df.withColumn("one", F.lit(1)), ["one"], ["file", "idx"]).first()
    assert ratios["total_bytes"] == t["all"] and abs(ratios["dedup_ratio_exact"] - (t["all"] - t["stored"]) / t["all"] * 100) < 1e-5


def test_summary_counts_files_without_chunks(spark):
    files = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "job string, file int")
    chunks = spark.createDataFrame([("a", 1, 0, "x", 5), ("a", 1, 1, "x", 5)], SCHEMA)
    out = dedup.classify(chunks, ["file", "idx"])
    assert rows(metrics.job_summary(files, out, "job", ["file"])) == [("a", 2, 2, 10, 5, "Backup completed. Processed 2 files, 2 chunks"), ("b", 1, 0, 0, 0, "Backup completed. Processed 1 files, 0 chunks")]
    progress = rows(metrics.file_progress(files, out, "job", ["file"], F.col("file").cast("string")), "file", "bytes_processed", "bytes_deduplicated")
    assert progress == [(1, 10, 5), (2, 10, 5), (3, 0, 0)]


def test_lru_equals_simulation(spark):
    table = data(700, 3)
    df = spark.createDataFrame(table, SCHEMA)
    for capacity in (1, 3, 20, 1000):
        cache, want = OrderedDict(), {}
        for _, file, idx, fp, _ in sorted(table, key=lambda r: r[1:3]):
            want[file, idx] = fp in cache
            if fp is None:
                want[file, idx] = False
                continue
            cache[fp] = None
            cache.move_to_end(fp)
            if len(cache) > capacity:
                cache.popitem(last=False)
        got = {(r["file"], r["idx"]): r["hit"] for r in cache_model.lru_outcomes(df, "fingerprint", ["file", "idx"], capacity, 5).collect()}
        assert got == want


def test_filter_equals_simulation(spark):
    rng = random.Random(9)
    events = [(i, rng.choice(["add", "add", "remove"]), "key%d" % rng.randrange(60)) for i in range(300)] + [(300, "add", None)]
    buckets = 16
    weak = lambda k: sum((i + 1) * ord(c) for i, c in enumerate(k))
    slots = [0] * buckets
    touched = set()
    for _, op, key in events:
        if key is None:
            continue
        h = weak(key)
        if op == "add":
            slots[h % buckets] = h
            touched.add(h % buckets)
        elif slots[h % buckets] == h:
            slots[h % buckets] = 0
    df = spark.createDataFrame(events, "n int, op string, key string")
    got = cache_model.filter_replay(df, ["n"], buckets)
    assert rows(got) == sorted(((b, slots[b]) for b in touched), key=repr)
    probes = spark.createDataFrame([("key1",), ("zz",), ("",), (None,)], "key string")
    want = sorted(((k, k is not None and slots[weak(k) % buckets] == weak(k)) for k in ("key1", "zz", "", None)), key=repr)
    assert rows(cache_model.filter_contains(probes, "key", got, buckets)) == want


def test_running_totals_of_a_large_job(spark):
    rng = random.Random(2)
    table = [(None if i % 50 == 0 else "big" if i % 3 else "j%d" % (i % 7), i, rng.randrange(100)) for i in range(500)]
    got = {r["n"]: r["v"] for r in dedup.running_totals(spark.createDataFrame(table, "job string, n int, v long"), "job", ["n"], ["v"], 5).collect()}
    sums = {}
    for job, n, v in table:
        sums[job] = sums.get(job, 0) + v
        assert got[n] == sums[job]
    assert dedup.running_totals(spark.createDataFrame([], "job string, n int, v long"), "job", ["n"], ["v"]).count() == 0
