import random

import numpy as np
import pytest

from siltspark.llm.splitting import Boundaries, SplitRule, oversized, rolling_hash, split_files

SCHEMA = "segment_no long, job_id string, file_path string, file_size long, data binary, offset long, extra string, size int"


def frame(spark, items):
    return spark.createDataFrame([(n, j, p, 0, bytearray(d) if d is not None else None, o, "x", 1) for n, (j, p, o, d) in enumerate(items)], SCHEMA)


def text(n, seed=1, alphabet="abcdefgh   .\n"):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n)).encode()


def check(spark, items, rule=SplitRule()):
    """Every covered byte once, sizes, overlaps, characters. Pieces by file."""
    files = {}
    for j, p, o, d in items:
        if None not in (j, p, o, d) and o >= 0:
            at = files.setdefault((j, p), {})
            for i, b in enumerate(d):
                at.setdefault(o + i, b)
    files = {k: v for k, v in files.items() if v}
    out = {}
    for r in split_files(frame(spark, items), rule).collect():
        out.setdefault((r["job_id"], r["file_path"]), []).append(r)
    assert set(out) == set(files)
    for k, pieces in out.items():
        pieces.sort(key=lambda r: r["offset"])
        got, last = {}, None
        for r in pieces:
            data = bytes(r["data"])
            assert len(data) == r["size"] <= rule.limit and r["size"] > r["repeated"]
            for i, b in enumerate(data):
                assert files[k][r["offset"] + i] == b
                if i >= r["repeated"]:
                    assert r["offset"] + i not in got
                    got[r["offset"] + i] = b
            if r["repeated"]:
                assert last["offset"] + last["size"] == r["offset"] + r["repeated"] and rule.overlap <= r["repeated"] <= rule.overlap + 3
            last = r
        assert got == files[k]
    return out


def test_segments_in_any_state(spark):
    body = text(30000)
    cut = [("j", "a", o, body[o : o + 7000]) for o in range(0, 30000, 7000)]
    items = cut[::-1] + cut[:2] + [("j", "a", 5000, body[5000:9000]), ("j", "lost", 0, body[:9000]), ("j", "lost", 12000, body[12000:22000]), ("j", "small", 0, b"x" * 8192), ("j", "over", 0, b"x" * 8193)]
    items += [("j", "none", 0, None), (None, "p", 0, b"x"), ("j", None, 0, b"x"), ("j", "empty", 0, b""), ("j", "altered", 0, b"first"), ("j", "altered", 2, b"SECOND"), ("k", "a", 3, b"other job")]
    out = check(spark, items)
    assert {r["file_path"] for r in oversized(split_files(frame(spark, items), with_data=False)).collect()} == {"a", "lost", "over"}
    assert len(out["j", "small"]) == 1 and len(out["j", "over"]) == 2
    assert b"".join(bytes(r["data"]) for r in out["j", "altered"]) == b"firstOND"
    assert split_files(frame(spark, [])).count() == 0


@pytest.mark.parametrize("body", ["漢字" * 9000, "é" * 20000, "👩‍💻" * 4000, "é" * 9000, "\r\n" * 12000, "=" * 30000])
def test_hardly_a_place_to_cut(spark, body):
    data = body.encode()
    half = len(data) // 2 + 1  # a segment begins inside a character
    out = check(spark, [("j", "a", 0, data[:half]), ("j", "a", half, data[half:])])
    for r in out["j", "a"]:
        bytes(r["data"]).decode()
        if r["offset"] + r["repeated"]:
            first = data[r["offset"] + r["repeated"] :].decode()[0]
            assert first not in "́‍" and not (body.startswith("\r\n") and first == "\n")


def test_bytes_that_are_no_text(spark):
    check(spark, [("j", "a", 0, bytes([0x80] * 20000)), ("j", "b", 0, random.Random(1).randbytes(40000))])


def test_cuts_are_natural(spark):
    paragraphs = "\n\n".join(" ".join("word%d" % (i * j % 97) for j in range(40)) + "." for i in range(200)).encode()
    cuts = [r["cut"] for r in check(spark, [("j", "a", 0, paragraphs)])["j", "a"]]
    assert set(cuts) <= {"paragraph", "end", "sentence", "line"} and cuts.count("paragraph") > len(cuts) / 2
    assert {r["cut"] for r in check(spark, [("j", "a", 0, text(60000, 2, "abcdefghij "))])["j", "a"]} <= {"word", "end"}


def test_edit_changes_neighbours_only(spark):
    body = text(200000, 7)
    edited = body[:90000] + b"inserted text. " + body[90000:]
    pieces = lambda d: {bytes(r["data"]) for r in split_files(frame(spark, [("j", "a", 0, d)])).collect()}
    before, after = pieces(body), pieces(edited)
    assert len(after - before) <= 5 < len(before) // 3


def test_windows_of_a_large_file(spark):
    body = text(2_300_000, 5)
    cut = [("j", "a", o, body[o : o + 65536]) for o in range(0, len(body), 65536)]
    flat = [("j", "b", o, b"=" * 65536) for o in range(0, 1 << 21, 65536)]
    out = check(spark, cut + flat)
    shift = {bytes(r["data"]) for r in split_files(frame(spark, [("j", "a", o, (b"xyz" + body)[o : o + 65536]) for o in range(0, len(body) + 3, 65536)])).collect()}
    same = sum(bytes(r["data"]) in shift for r in out["j", "a"])
    assert same >= len(out["j", "a"]) - 5


def test_edit_of_a_huge_file_stays_local(spark):
    body = text(6 << 20, 11)
    edited = body[:1000] + text(5000, 12) + body[1000:]
    cut = lambda p, d: [("j", p, o, d[o : o + 65536]) for o in range(0, len(d), 65536)]
    rows = split_files(frame(spark, cut("a", body) + cut("b", edited))).collect()
    a, b = ({bytes(r["data"]) for r in rows if r["file_path"] == p} for p in "ab")
    assert len(b - a) <= 5 and len(a - b) <= 5, (len(b - a), len(a - b))
    fresh = [r["size"] - r["repeated"] for r in rows if r["cut"] != "end"]
    assert min(fresh) >= SplitRule().least and max(r["size"] for r in rows) <= SplitRule().limit
    for p, d in (("a", body), ("b", edited)):
        assert b"".join(bytes(r["data"])[r["repeated"] :] for r in sorted((r for r in rows if r["file_path"] == p), key=lambda r: r["offset"])) == d


def test_rolling_hash_is_local():
    a, b = np.frombuffer(text(500, 1), np.uint8), np.frombuffer(text(400, 2), np.uint8)
    joined = np.concatenate([b, a])
    assert (rolling_hash(a)[31:] == rolling_hash(joined)[len(b) + 31 :]).all()


def test_rule_rejects():
    for bad in ({"overlap": -1}, {"overlap": 5000}, {"least": 0}, {"least": 5000}, {"limit": 10}):
        with pytest.raises(ValueError):
            SplitRule(**bad)


def test_boundaries():
    b = Boundaries(np.frombuffer("Ab. Cd\n\nEf。gh".encode(), np.uint8))
    assert b.name(8) == "paragraph" and b.name(7) == "line" and b.name(4) == "sentence" and b.name(13) == "sentence" and b.name(11) == "byte"
