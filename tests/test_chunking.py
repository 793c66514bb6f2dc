import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltspark.config import EngineConfig
from siltspark.functions.blake3 import digests
from siltspark.operators.chunking import chunk_files

PATTERNS = (b"\0" * 4, b"\xff" * 4, b"\n" * 4)


def scan(data: bytes, least: int, most: int) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        rest = data[at:]
        cut = len(rest)
        if len(rest) >= least:
            cut = next((i for i in range(least, min(most, len(rest))) if i >= 4 and rest[i - 4 : i] in PATTERNS), min(most, len(rest)))
        out.append(rest[:cut])
        at += cut
    return out


def run(spark, blobs, config):
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(blobs)], "id int, content binary")
    found = {i: [] for i in range(len(blobs))}
    for r in sorted(chunk_files(df, config=config, with_data=True).collect(), key=lambda r: (r["id"], r["chunk_index"])):
        found[r["id"]].append(r)
    return found


@pytest.mark.parametrize("least,most", [(64, 256), (4, 8), (1, 16), (64, 64), (5, 9), (64, 66), (64, 8192)])
def test_equals_byte_scan(spark, least, most):
    rng = random.Random(least * most)
    blobs = [b"", b"a", None]
    for n in (3, 4, least - 1, least, least + 1, most - 1, most, most + 1, most + 4, 2 * most, 3 * most + 7):
        for alphabet in (b"\n", b"\n\xff\0a", b"ab", b"\n\n\n\n\na", bytes(range(256))):
            blobs.append(bytes(rng.choice(alphabet) for _ in range(max(n, 0))))
    config = EngineConfig(min_size=least, max_size=most)
    for i, got in run(spark, blobs, config).items():
        expected = scan(blobs[i] or b"", least, most)
        assert [bytes(r["data"]) for r in got] == expected
        assert [r["offset"] for r in got] == [sum(map(len, expected[:k])) for k in range(len(expected))]
        assert [r["fingerprint"] for r in got] == [hashlib.sha256(x).hexdigest() for x in expected]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"\n" * 4, b"\0" * 3, b"\xff" * 5, b"x", b"\n", b"long filler "]), max_size=60).map(b"".join), min_size=1, max_size=8))
def test_property(spark, blobs):
    for i, got in run(spark, blobs, EngineConfig(min_size=8, max_size=32)).items():
        assert [bytes(r["data"]) for r in got] == scan(blobs[i], 8, 32)


def test_block_aligned(spark):
    data = bytes(random.Random(5).choice(b"\nab") for _ in range(5000))
    got = run(spark, [data], EngineConfig(min_size=16, max_size=100, block_aligned=True))[0]
    expected = [c for i in range(0, len(data), 100) for c in scan(data[i : i + 100], 16, 100)]
    assert [bytes(r["data"]) for r in got] == expected and [r["chunk_index"] for r in got] == list(range(len(expected)))


def test_long_repetitive_files(spark):
    df = spark.range(1).select(F.lit(1).alias("id"), F.explode(F.array(F.lit("A"), F.lit("\0"))).alias("c")).select("c", F.encode(F.repeat("c", 10 << 20), "ISO-8859-1").alias("content"))
    got = {r["c"]: r for r in chunk_files(df).groupBy("c").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("u"), F.sum("size").alias("b"), F.max(F.col("offset") + F.col("size")).alias("end")).collect()}
    assert (got["A"]["n"], got["A"]["u"], got["A"]["end"]) == (1280, 1, 10 << 20)
    assert (got["\0"]["n"], got["\0"]["u"], got["\0"]["b"], got["\0"]["end"]) == (163840, 1, 10 << 20, 10 << 20)


def test_clashing_names(spark):
    df = spark.createDataFrame([(9, 7, 5, bytearray(b"abc"))], "chunk_index int, size int, other int, content binary")
    assert chunk_files(df).columns == ["other", "chunk_index", "offset", "size", "fingerprint"]
    assert chunk_files(df).count() == 1


def test_config_rejects():
    for bad in ({"min_size": 0}, {"min_size": 64, "max_size": 63}, {"min_size": 1, "max_size": 3}, {"hash_alg": "md5"}, {"mode": "x"}, {"lru_capacity": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_blake3_published_vectors():
    # Input of length n is the repeated sequence 0..250.
    known = {
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    }
    values = [bytes(i % 251 for i in range(n)) for n in known]
    assert digests(values) == list(known.values())
    assert digests([]) == []


def test_blake3_batch_equals_single(spark):
    values = [random.Random(n).randbytes(n) for n in (0, 5, 64, 65, 1023, 2048, 2049, 5000, 8192, 10000)]
    assert digests(values) == [digests([v])[0] for v in values]
    got = run(spark, values, EngineConfig(hash_alg="blake3", max_size=16384))
    assert [got[i][0]["fingerprint"] for i in range(1, len(values)) if len(got[i]) == 1] == [d for i, d in enumerate(digests(values)) if i and len(got[i]) == 1]
