import json
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from siltspark.functions.json_index import JsonIndex
from siltspark.operators.nested import flatten_listings, listed_chunks

A, B, C = "a" * 64, "b" * 64, "c" * 64


def valid(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except ValueError:
        return False


BASE = ['{"a":[1,2,{"b":"c\\\\"}]}', '"x\\"y"', "[]", " 1 ", "-0.5e3", "[1,]", '{"a":1,}', '{"a" 1}', "nul", '"\\u12G4"', '"a\\', '\\"', "[[],{}]", "1 2", "{,}", "]", "}{", '"\t"', "01", "1.", "", "   "]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet='{}[],:"\\ 1ae.-\nu', max_size=14), st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8).map(json.dumps)), max_size=30))
def test_validity_equals_json(texts):
    texts = texts + BASE
    assert (~JsonIndex(pa.array(texts, pa.large_string())).bad).tolist() == [valid(t) for t in texts]


def test_mutations():
    rng = random.Random(2)
    texts = []
    for _ in range(3000):
        s = list(rng.choice(BASE))
        for _ in range(rng.randint(0, 2)):
            if s:
                i = rng.randrange(len(s))
                s[i : i + rng.randint(0, 2)] = rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "1", "a", " "])
        texts.append("".join(s))
    assert (~JsonIndex(pa.array(texts)).bad == np.array([valid(t) for t in texts])).all()


FORMS = [
    ("list", {"files": [{"path": "p", "chunks": [{"fingerprint": A, "offset": 0}, None, {"fp": B.upper()}, C, {"fingerprint": None, "fp": A}, {"size": 1}, 7]}], "note": A}),
    ("keyed", {"files": {'k"1/é': {"chunks": [A]}, "k2": {"chunks": None}}}),
    ("bare", [{"path": "x", "chunks": ["sha256:" + A + "!", A + "0", A + " " + B]}]),
    ("tree", {"tree": {"name": "/r", "files": [{"name": "f", "chunks": [A]}], "folders": [{"name": "s", "folders": [{"name": "t", "files": [{"name": "g", "chunks": [B]}]}]}]}}),
    ("elsewhere", {"files": [{"path": "p", "previous": {"chunks": [A], "fingerprint": B}, "attrs": {"x": [{"name": "n", "value": 66}]}, "acl": [{"who": "me", "perms": ["r", "w"]}]}]}),
]
EXPECTED = [
    ("bare", "x", 0, A), ("keyed", 'k"1/é', 0, A), ("list", "p", 0, A), ("list", "p", 2, B), ("list", "p", 3, C), ("list", "p", 4, A), ("tree", "/r/f", 0, A), ("tree", "/r/s/t/g", 0, B),
]


@pytest.mark.parametrize("dump", [json.dumps, lambda o: json.dumps(o, ensure_ascii=False, indent=1), lambda o: json.dumps(json.dumps(o)), lambda o: json.dumps(json.dumps(json.dumps(o)))])
def test_forms(spark, dump):
    table = [(n, dump(o)) for n, o in FORMS] + [("null", None), ("empty", ""), ("cut", dump(FORMS[0][1])[:-3]), ("word", '"plain"'), ("number", "3")]
    df = spark.createDataFrame(table, "job_id string, files_metadata string")
    assert rows(listed_chunks(df, ["job_id"])) == sorted(EXPECTED, key=repr)


def test_tables_keep_every_field(spark):
    df = spark.createDataFrame([(n, json.dumps(o)) for n, o in FORMS], "job_id string, files_metadata string")
    assert ("elsewhere", "p", "me", '["r", "w"]') in rows(flatten_listings(df, "access", ["job_id"]), "job_id", "file_path", "who", "perms")
    attributes = rows(flatten_listings(df, "attributes", ["job_id"]), "job_id", "owner", "name", "value")
    assert ("elsewhere", "file", "attrs.x[0].value", "66") in attributes and ("elsewhere", "file", "previous.chunks[0]", json.dumps(A)) in attributes
    assert ("list", "root", "note", json.dumps(A)) in attributes and ("keyed", "file", "chunks", "null") in attributes
    assert rows(flatten_listings(df, "files", ["job_id"]), "job_id", "file_path", "n_chunks").count(("list", "p", 7)) == 1


def test_repeated_names_and_empty_table(spark):
    text = '{"files": {"a": {"chunks": ["%s"]}, "a": {"chunks": ["%s"]}}}' % (A, B)
    df = spark.createDataFrame([("j", "clash", text), ("j", "clash", text)], "job_id string, file_path string, files_metadata string")
    assert rows(listed_chunks(df.drop("file_path"), ["job_id"])) == [("j", "a", 0, B)] * 2
    assert listed_chunks(df.limit(0), ["job_id"]).count() == 0


def test_very_long_text(spark):
    listing = {"files": [{"path": f"p{i}", "chunks": [A] * 20} for i in range(5000)]}
    df = spark.createDataFrame([("j", json.dumps(listing)), ("k", "[" * 50000)], "job_id string, files_metadata string")
    assert listed_chunks(df, ["job_id"]).count() == 100000
