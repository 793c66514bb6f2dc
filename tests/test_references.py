import random
from datetime import datetime, timedelta

import pytest
from conftest import rows

from siltspark.operators.references import orphans_by_mask, temporal_orphans

DAY = datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(minutes=17 * n)


@pytest.mark.parametrize("log", [True, False])
def test_temporal_equals_brute_force(spark, log):
    rng = random.Random(4 + log)
    pick = lambda: None if rng.random() < 0.15 else rng.randrange(300)
    key = lambda: None if rng.random() < 0.05 else "hot" if rng.random() < 0.4 else "k%d" % rng.randrange(40)
    refs = [(key(), pick(), i) for i in range(600)]
    targets = [(key(), pick(), None if log or rng.random() < 0.3 else rng.randrange(300), rng.random() < 0.02) for _ in range(120)]
    gone = [(key(), pick()) for _ in range(80)] if log else []
    targets = [t for t in targets if t[0] not in ("k1", "k2")] + targets[:5]
    r = spark.createDataFrame([(k, at(t), i, "x") for k, t, i in refs], "key string, t timestamp, n int, kind string")
    t = spark.createDataFrame([(k, at(b), at(e), a) for k, b, e, a in targets], "key string, begin timestamp, end timestamp, always boolean")
    d = spark.createDataFrame([(k, at(x)) for k, x in gone], "key string, at timestamp") if log else None
    far = 10**9

    def kind(k, when):
        mine = [x for x in targets if x[0] == k]
        when = far if when is None else when
        for _, b, e, always in mine:
            if always or b is not None and b <= when and (e is None or when < e) and not any(x is not None and b <= x <= when for g, x in gone if g == k):
                return None
        return "missing" if not mine else "late" if all(b is not None and b > when for _, b, _, _ in mine) else "deleted"

    want = sorted(((i, kind(k, when)) for k, when, i in refs if k is not None and kind(k, when)), key=repr)
    assert rows(temporal_orphans(r, t, d), "n", "kind") == want


def test_boundaries_and_empty_tables(spark):
    t = spark.createDataFrame([("a", at(5), at(9), None), ("b", at(5), None, None)], "key string, begin timestamp, end timestamp, always boolean")
    d = spark.createDataFrame([("b", at(7))], "key string, at timestamp")
    refs = spark.createDataFrame([("a", at(4)), ("a", at(5)), ("a", at(8)), ("a", at(9))], "key string, t timestamp")
    assert rows(temporal_orphans(refs, t), "t", "kind") == [(at(4), "late"), (at(9), "deleted")]
    refs = spark.createDataFrame([("b", at(5)), ("b", at(6)), ("b", at(7)), ("b", None), ("c", at(1))], "key string, t timestamp")
    assert rows(temporal_orphans(refs, t, d), "key", "kind") == [("b", "deleted"), ("b", "deleted"), ("c", "missing")]
    assert temporal_orphans(refs.limit(0), t).count() == 0
    assert temporal_orphans(refs, t.limit(0)).count() == 5


@pytest.mark.parametrize("match", ["simple", "full", "partial"])
def test_masks_equal_brute_force(spark, match):
    rng = random.Random(8)
    pick = lambda: None if rng.random() < 0.3 else rng.randrange(4)
    refs = [(i, pick(), pick(), pick()) for i in range(200)]
    targets = [(pick(), pick(), pick()) for _ in range(25)]

    def orphan(k):
        if all(v is None for v in k) or None in k and match == "simple":
            return False
        if None in k and match == "full":
            return True
        return not any(all(a is None or a == b for a, b in zip(k, t)) for t in targets)

    want = sorted(((r[0], ",".join(n for n, v in zip("abc", r[1:]) if v is None)) for r in refs if orphan(r[1:])), key=repr)
    got = orphans_by_mask(spark.createDataFrame(refs, "n int, a int, b int, c int"), spark.createDataFrame(targets, "a int, b int, c int"), ["a", "b", "c"], match=match)
    assert rows(got, "n", "mask") == want
