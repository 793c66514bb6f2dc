import random
from collections import OrderedDict

from conftest import rows

from siltspark.operators.cache_model import cache_replay, latest_keys, lru_outcomes

LOG = "cache int, seq int, op string, key string"


def brute(log, capacity, buckets):
    hash_of = lambda k: sum(ord(c) * (i + 1) for i, c in enumerate(k))
    lists, slots, out = {}, {}, []
    for cache, seq, op, key in sorted(log, key=lambda r: (r[0], r[1])):
        held, answer = lists.setdefault(cache, OrderedDict()), None
        at = (cache, hash_of(key) % buckets) if key is not None else None
        if op == "put" and key is not None:
            held[key] = None
            held.move_to_end(key)
            if len(held) > capacity:
                held.popitem(last=False)
            slots[at] = hash_of(key)
        elif op == "get":
            answer = int(key in held)
            if answer:
                held.move_to_end(key)
        elif op == "remove":
            answer = int(key in held)
            held.pop(key, None)
            if at and slots.get(at) == hash_of(key):
                slots[at] = 0
        elif op == "contains":
            answer = int(at is not None and slots.get(at, 0) == hash_of(key))
        elif op == "size":
            answer = len(held)
        elif op == "clear":
            held.clear()
        out.append((cache, seq, op, answer))
    return sorted(out, key=repr)


def test_log_equals_brute_force(spark):
    rng = random.Random(5)
    ops = ["put"] * 6 + ["get"] * 5 + ["contains", "contains", "remove", "size", "clear"]
    log = [(c, i, rng.choice(ops), None if rng.random() < 0.03 else "k%d" % rng.randrange(12)) for c in range(3) for i in range(300)]
    got = cache_replay(spark.createDataFrame(log, LOG), "cache", ["seq"], 5, 7)
    assert rows(got, "cache", "seq", "op", "answer") == brute(log, 5, 7)
    assert cache_replay(spark.createDataFrame([], LOG), "cache", ["seq"], 5, 7).count() == 0


def test_least_recent_goes_first(spark):
    log = [(1, i, op, k) for i, (op, k) in enumerate([("put", "k1"), ("get", "k1"), ("put", "k2"), ("put", "k3"), ("put", "k4"), ("size", None), ("get", "k1"), ("get", "k2"), ("remove", "k2"), ("remove", "k2"), ("clear", None), ("contains", "k3"), ("get", "k3")])]
    got = [r[1] for r in sorted(((r[1], r[3]) for r in rows(cache_replay(spark.createDataFrame(log, LOG), "cache", ["seq"], 3, 25), "cache", "seq", "op", "answer")), key=lambda r: r[0])]
    assert got == [None, 1, None, None, None, 3, 0, 1, 1, 0, None, 1, 0]


def test_seeded_ranges_equal_one_cache(spark):
    rng = random.Random(9)
    keys = [None if rng.random() < 0.05 else "k%d" % min(rng.randrange(60), rng.randrange(60)) for _ in range(900)]
    held, want = OrderedDict(), []
    for k in keys:
        want.append(k is not None and k in held)
        if k is not None:
            held[k] = None
            held.move_to_end(k)
            if len(held) > 20:
                held.popitem(last=False)
    table = lambda lo, hi: spark.createDataFrame([(i, keys[i]) for i in range(lo, hi)], "n int, key string")
    got, seed = [], None
    for lo, hi in ((0, 400), (400, 401), (401, 900)):
        part = table(lo, hi)
        got += [r[1] for r in sorted(rows(lru_outcomes(part, "key", ["n"], 20, ranges=5, seed=seed), "n", "hit"))]
        seed = latest_keys(part, "key", ["n"], 20, seed)
    assert got == want
    assert [r["key"] for r in seed.orderBy("age").collect()] == list(held)
    assert lru_outcomes(table(0, 0), "key", ["n"], 20).count() == 0
