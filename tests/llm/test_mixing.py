import random

import pytest
from conftest import rows

P = pytest.importorskip("public_tokenizers")

from siltspark.llm.bpe import read_tokenizer  # noqa: E402
from siltspark.llm.mixing import Source, mix_sources, plan, route  # noqa: E402

DOCS, TARGETS = "doc_id long, text string, source string, tokens string", "source string, target_share double, max_repeats int"


def documents(n=400):
    rng = random.Random(3)
    out = []
    for i in range(n):
        source = rng.choice(["Main", " main", "main", "main", "side", "SIDE ", "tiny", "other", None])
        body = "shared text of many documents" if rng.random() < 0.3 else " ".join("word%d" % rng.randrange(500) for _ in range(rng.randrange(1, 30)))
        out.append((i, rng.choice([body] * 9 + [None, ""]), source if source != "tiny" or rng.random() < 0.3 else "main", "clash"))
    return out


def test_shares_caps_and_seed(spark):
    docs = documents()
    targets = [("main", 0.5, 1), ("side", 0.3, 2), ("Tiny ", 0.2, 3), ("absent", 0.1, 5), (None, 0.4, 1)]
    tok = read_tokenizer(spark, P.path("byte_bpe_50k.tiktoken"))
    args = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), tok
    chosen, shares = mix_sources(*args, seed=1)
    picked = chosen.collect()
    label = {d: (s or "").strip().lower() for d, _, s, _ in docs}
    repeats = {"main": 1, "side": 2, "tiny": 3}
    assert len({r["doc_id"] for r in picked}) == len(picked)
    for r in picked:
        assert label[r["doc_id"]] == r["source"] and 1 <= r["uses"] <= repeats[r["source"]]
    report = {r["source"]: r for r in shares.collect()}
    total = sum(r["uses"] * r["tokens"] for r in picked)
    assert sum(r["tokens"] for r in report.values()) == total
    longest = max(r["tokens"] for r in picked)
    for s, r in report.items():
        assert abs(r["actual_share"] - r["quota_share"]) * total <= 8 * longest * 2
    assert report["absent"]["tokens"] == 0 and report["absent"]["quota_share"] == 0 and abs(report["absent"]["target_share"] - 1 / 11) < 1e-9
    assert rows(mix_sources(*args, seed=1)[0]) == rows(chosen) != rows(mix_sources(*args, seed=2)[0])


def test_empty(spark):
    tok = read_tokenizer(spark, P.path("byte_bpe_50k.tiktoken"))
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    chosen, shares = mix_sources(none, targets, tok)
    assert chosen.count() == 0 and shares.first()["actual_share"] == 0.0
    chosen, shares = mix_sources(spark.createDataFrame(documents(5), DOCS), targets.limit(0), tok)
    assert chosen.count() == 0 and shares.count() == 0


def test_overlap_goes_where_it_is_needed():
    sources = [Source("a", 1, 1), Source("b", 1, 1)]
    # Texts in both sources serve the one that has nothing of its own.
    flows, quotas = plan({0b01: 100, 0b11: 100}, sources)
    assert quotas == [100, 100] and flows == {(0b01, 0): 100, (0b11, 1): 100}


def test_repetition_is_the_last_resort():
    sources = [Source("a", 1, 3)]
    flows = route({0b1: 50}, sources, [120])
    assert flows == {(0b1, 0): 120}
    sources = [Source("a", 1, 3), Source("b", 1, 1)]
    # a's own texts would be repeated, so those shared with b serve a as far as b can spare them.
    flows = route({0b01: 50, 0b11: 100, 0b10: 100}, sources, [120, 100])
    assert flows[0b01, 0] == 50 and flows[0b11, 0] == 70 and flows[0b10, 1] + flows.get((0b11, 1), 0) == 100
    assert route({0b1: 10}, [Source("a", 1, 2)], [100]) == {(0b1, 0): 20}
