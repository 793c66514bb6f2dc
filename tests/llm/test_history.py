import hashlib
import random

from siltspark.llm.history import History
from siltspark.llm.shingles import WORD, pack, run_set, unpack
from siltspark.session import scratch_path

SCHEMA = "occurrence_id long, fingerprint string, data binary, id string"


def corpus(n=260, seed=1):
    """Variants of some texts, a large cluster of one of them, shared boilerplate, exact copies, bytes and nulls."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    boiler = [word() for _ in range(30)]
    bases = [[word() for _ in range(60)] + boiler for _ in range(12)]
    out = []
    for i in range(n):
        pick = rng.random()
        if pick < 0.04:
            out.append((i, None, None))
            continue
        if pick < 0.08:
            out.append((i, None, b"\xff\xfe" + bytes([rng.randrange(3)])))
            continue
        if pick < 0.12:
            out.append((i, rng.choice(["", "xyz", None]), rng.choice([b"", b"two words", b" "])))
            continue
        words = list(bases[0] if pick < 0.5 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7, 12])):
            words[rng.randrange(len(words))] = word()
        data = " ".join(words).encode()
        fp = hashlib.sha256(data).hexdigest()
        out.append((i, rng.choice([fp, fp.upper(), f"sha256:{fp} ", None, "broken"]), None if rng.random() < 0.05 else data))
    return [(i, f, bytearray(d) if d is not None else None, "clash") for i, f, d in out]


def brute(table):
    import re

    def key(f, d):
        runs = [r for r in re.findall("[0-9a-f]+", (f or "").lower()) if len(r) == 64]
        return runs[0] if len(runs) == 1 else hashlib.sha256(d).hexdigest() if d is not None else None

    def shingles(d):
        try:
            words = WORD.findall(bytes(d).decode().lower()) if d is not None else []
        except UnicodeDecodeError:
            words = []
        return set(zip(words, words[1:], words[2:]))

    seen, want = [], {}
    for i, f, d, _ in table:
        k, s = key(f, d), shingles(d)
        exact = min((j for j, kk, _ in seen if k is not None and kk == k), default=None)
        near = min((j for j, _, ss in seen if s and ss and 10 * len(s & ss) >= 7 * len(s | ss)), default=None)
        want[i] = (exact, near)
        seen.append((i, k, s))
    return want


def admit(spark, table, cuts, reopen=False, **kw):
    kw["path"] = scratch_path(spark, "history")
    history = History(spark, **kw)
    got = {}
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        history = History(spark, **kw) if reopen else history
        part = spark.createDataFrame(table[lo:hi], SCHEMA)
        got.update({r[0]: (r[1], r[2]) for r in history.admit(part, "occurrence_id", "fingerprint", "data").collect()})
    return got


def test_one_batch_equals_brute_force(spark):
    table = corpus()
    assert admit(spark, table, [0, len(table)]) == brute(table)


def test_batches_with_compaction_equal_brute_force(spark):
    table = corpus(150, 2)
    assert admit(spark, table, [0, 60, 60, 110, 150], reopen=True, compact_every=2) == brute(table)


def test_hot_cluster_wide_windows(spark):
    table = corpus(200, 3)
    assert admit(spark, table, [0, 120, 200], star=4, group_rows=100) == brute(table)


def test_empty_batches(spark):
    assert admit(spark, [], [0, 0]) == {}
    table = corpus(60, 4)
    assert admit(spark, table, [0, 0, 60]) == brute(table)


def test_packing():
    s = run_set("Ein Wort, noch ein WORT und noch_eins 3 mal", 3)
    assert (unpack(pack(s)) == s).all() and len(run_set("a b", 3)) == 0
    assert (run_set("a b c d", 3) == run_set("A. b;C_d", 3)).all()



def test_reads_follow_the_batch_and_not_the_history(spark):
    rng = random.Random(7)
    text = lambda: " ".join("w%d" % rng.randrange(5000) for _ in range(40)).encode()
    history = History(spark, ranges=4, group_rows=100)
    rows = lambda lo, hi: spark.createDataFrame([(i, None, bytearray(text()), "") for i in range(lo, hi)], SCHEMA)
    history.admit(rows(0, 1500), "occurrence_id", "fingerprint", "data")
    read = []
    for i in range(10):
        before = history.entries_read.value
        assert history.admit(rows(2000 + 2 * i, 2002 + 2 * i), "occurrence_id", "fingerprint", "data").count() == 2
        read.append(history.entries_read.value - before)
    assert sum(read[-3:]) <= 1.2 * sum(read[2:5]) and max(read) < 0.25 * 1500 * 13, read


def test_hot_copies_and_late_ties(spark):
    """A third of each batch is one text, another third one fingerprint without data."""
    fp = "ab" * 32
    table = [(i, fp if i % 3 == 1 else None, bytearray(b"the same four words") if i % 3 == 0 else None if i % 3 == 1 else bytearray(b"w%d a b c d" % i), "") for i in range(90)]
    assert admit(spark, table, [0, 30, 31, 90], compact_every=2) == brute(table)


def test_batches_are_whole_jobs(spark):
    from siltspark.llm.queries import job_batches

    rng = random.Random(3)
    jobs, n = [], 0
    for j in range(120):
        for _ in range(rng.randrange(1, 8)):
            jobs.append((n, f"j{j if rng.random() < 0.8 else max(0, j - 2)}" if rng.random() < 0.95 else None))
            n += 1
    begins = job_batches(spark.createDataFrame(jobs, "occurrence_id long, job_id string"), 10)
    assert begins[0] == 0 and len(begins) >= 3
    spread = {}
    for i, job in jobs:
        spread.setdefault(job, set()).add(sum(i >= b for b in begins))
    assert all(len(v) == 1 for job, v in spread.items() if job is not None)
    assert job_batches(spark.createDataFrame([], "occurrence_id long, job_id string")) == []
    assert job_batches(spark.createDataFrame([(1, "a"), (9, "b"), (5, "b"), (12, "a")], "occurrence_id long, job_id string")) == [1]
