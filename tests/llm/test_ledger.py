import random

from conftest import rows
from pyspark.sql import functions as F

from siltspark.functions.columns import fingerprint_bytes
from siltspark.llm.ledger import KeyLedger, answer_errors
from siltspark.session import scratch_path

SCHEMA = "no long, fp string, key string"


def keys(n, seed):
    rng = random.Random(seed)
    fp = lambda i: "%064x" % i
    out = []
    for i in range(n):
        k = fp(7) if rng.random() < 0.35 else fp(rng.randrange(150))
        out.append((i, rng.choice([k, k.upper(), "x/" + k + "?v=1", k + "0", None, "", k + " " + k[::-1]]), "clash"))
    return out


def key(text):
    import re

    runs = [r for r in re.findall("[0-9a-f]+", (text or "").lower()) if len(r) == 64]
    return runs[0] if len(runs) == 1 else None


def test_equals_set(spark):
    path = scratch_path(spark, "ledger")
    table, old = keys(600, 1), keys(40, 2)
    ledger = KeyLedger(spark, path, 3)
    ledger.learn(spark.createDataFrame(old, SCHEMA), fingerprint_bytes("fp"))
    seen = {key(t) for _, t, _ in old} - {None}
    start = set(seen)
    every = None
    for lo, hi in ((0, 250), (250, 250), (250, 600)):
        if lo == 250:
            ledger = KeyLedger(spark, path, 3)  # opened again
        answers = ledger.admit(spark.createDataFrame(table[lo:hi], SCHEMA), fingerprint_bytes("fp"), "no")
        every = answers if every is None else every.unionByName(answers)
        got = {r["no"]: r["seen"] for r in answers.collect()}
        for no, text, _ in table[lo:hi]:
            k = key(text)
            assert got[no] == (k is not None and k in seen)
            seen.add(k)
    history = spark.createDataFrame([(bytearray.fromhex(k),) for k in start], "key binary")
    report = answer_errors(every, history, "no").first()
    assert report["wrong"] == 0 and report["rows"] == 600 and report["error_rate"] == 0.0


def test_ties_and_null_positions(spark):
    ledger = KeyLedger(spark)
    a = "%064x" % 1
    df = spark.createDataFrame([(5, a), (5, a), (None, a), (9, a)], "no long, fp string")
    assert rows(ledger.admit(df, fingerprint_bytes("fp"), "no"), "no", "seen") == [(5, False), (5, False), (9, True), (None, True)]
    assert ledger.admit(df.limit(0), F.col("fp").cast("binary"), "no").count() == 0
