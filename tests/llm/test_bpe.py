import base64
import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from siltspark.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    raw = Path(PATH).read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.load_vocabulary(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(pair, texts):
    ends, ids = pair[0].encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [pair[1].encode_ordinary(t or "") for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="aab e'll\n\t1 ", max_size=200)), max_size=12))
def test_equals_public_library(pair, texts):
    same(pair, texts)


def test_long_parts_and_lanes(pair):
    rng = random.Random(1)
    texts = ["<|endoftext|>", "", None, " " * 3000]
    for n in (1, 2, 3, 63, 64, 65, 127, 129, 3000):
        for alphabet in ("ab", "etaoin shrdlu", "aé漢", "=-", "😀👩"):
            texts.append("".join(rng.choice(alphabet) for _ in range(n)))
    same(pair, texts)


def test_cache_bound_changes_nothing(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PARTS", 3)
    for n in range(5):
        same(pair, [f"some words {n}", "again some words"])


def test_column(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    tok = bpe.read_tokenizer(spark, PATH)
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_column(df, "doc_id", "text", tok).collect())
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, [])]
    assert sorted(r["tokens"] for r in bpe.encode_column(df, "doc_id", "text", tok, counts_only=True).collect()) == [0, 0, 0, 2]
    assert bpe.encode_column(df.limit(0), "doc_id", "text", tok).count() == 0
