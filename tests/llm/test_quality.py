import numpy as np
import pytest

from siltspark.llm.quality import KINDS, PROFILES, LineCounter, Quality, class_counts, divergence, text_quality

COMMON = {"en": ["the", "of", "and", "to", "a", "in", "is", "it", "for", "on", "by", "not", "are"], "de": ["der", "die", "und", "in", "den", "das", "ist", "nicht"]}
PROSE = "The window of the cache is not handed to the reader, and it is late.\nIt was read on a disk by the worker, for all of us.\nThey are slow in the end, and that is it."
CODE = "diff --git a/x.js b/x.js\n@@ -1,3 +1,4 @@ func main()\n+    for i in range(n):\n-    self.cache[i] = items[3]\n+    if cursor == nil {\n+        return worker(item, 4)\n+    // the worker of the cache\n }\n"
TEXTS = {
    "list": ["\n".join(f"{m}worker cache alpha" for _ in range(5)) for m in ("- ", "* ", "  • ", "- [ ] ", "1. ", "(a) ", "+ - ", "")] + ["M\tsrc/a.go\nA\tsrc/b.go\nD\tsrc/c.go", "* fix cache (#12)\n* drop worker (#13)\n* add token (#14)"],
    "table": ["| a | 12.5 | - |\n|---|---|---|\n| b | 3% | 7 |", "name,12,3%\nkey,4,-\nzed,9,8.1", '"x";"12.5"\n"b";"3"\n"c";"-"', "alpha\t1\t2\n-\t3%\t7\nbeta\t5\t6", "   a1      12.5     30%\n   beta      -      7.1\n   gam     4.0      9", "worker cache ......  123\ntoken ............   45\nslot .............   6"],
    "junk": ["~~~~~~~~~~~~\n~~~~~~~~~\n~~~~~~~~~~~~~~~~", "00000000  f6 42 a9 5a 3b ec f8 9f\n00000010  b7 1a 5d a6 0b d3 31 59\n00000020  18 39 c9 45 12 46 69 be", "gq83Dglt/iM6v1a93p4L8q8pR4gsGdek1859wG9+Cz1aMt\nf3XKxIwEggoPzAV0qH5xjUDmxbELq+qOETp+TPKW2aTKCo\nl3UhDXEsRF8n6JN4AwhSVWtdPyjltOailgrmmi1zg66nFU", "Ő����É�╫▙Ĵõė╦\n╼�çķ┬�╾�┏�ö�◎\nŎ�����┗◦�Ïŏ┑◊", "q]we;rt[y kl;[jw\n;k[oiu]qw e[rj;a\nfj;sl[d] oq;k[w"],
    None: [PROSE, CODE, "", None, " \n\t\n", "Update generated files", "the cache is late\nand so it is\nfor the rest of the worker\nin the window", "Merge branch 'x' into y\n# Conflicts:\n#\tsrc/a.go\n#\tsrc/b.go\n#\tsrc/c.go"],
}


@pytest.mark.parametrize("kind", list(TEXTS))
def test_kinds(kind):
    q = Quality(COMMON)
    for text in TEXTS[kind]:
        for ends in ("\n", "\r\n", "\r"):
            row = q.rows([text.replace("\n", ends) if text else text])[0]
            assert row[-1] == kind, (text, row)


def test_statistics(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON["en"]] + [(None, "x"), ("en", None)], "lang string, word string")
    df = spark.createDataFrame([(1, PROSE, 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, "Ab 12!", 9)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in text_quality(df, "doc_id", "text", words).collect()}
    assert got[1]["n_lines"] == 3 and got[1]["punctuated_lines"] == 1.0 and got[1]["nearest_lang"] == "en" and got[1]["prose_lines"] == 1.0
    assert 0 <= got[1]["prose_divergence"] < got[4]["prose_divergence"] <= 1
    assert (got[4]["n_words"], got[4]["mean_word_length"], got[4]["symbol_ratio"], got[4]["digit_ratio"], got[4]["upper_ratio"]) == (2, 2.0, 0.2, 0.4, 0.2)
    for i in (2, 3):
        assert got[i]["n_words"] == 0 and got[i]["nearest_lang"] is None and got[i]["prose_divergence"] is None and got[i]["kind"] is None
    assert text_quality(df, "doc_id", "text", words).count() == 5
    assert text_quality(df.limit(0), "doc_id", "text", words.limit(0)).count() == 0


def test_titles_and_short_texts():
    q = Quality(COMMON)
    for text, kind in (("Update generated files", None), ("✨ Merge pull request #6202 from a/b-c\n", None), ("gq83Dglt/iM6v1a93p4L8q8pR4gsGdek1859wG9+Cz1aMt\nf3XKxIwEggoPzAV0qH5xjUDmxbELq+qOETp+TPKW2aTKCo", "junk"), ("worker cache\nalpha token", "list")):
        assert q.rows([text])[0][-1] == kind, text


def test_kinds_come_from_the_divergences(monkeypatch):
    """Without the divergences no kind is right; without those of characters and words some lines of tables are lists."""
    from siltspark.llm import quality

    texts = [(k, t) for k in ("list", "table", "junk") for t in TEXTS[k]]
    right = lambda: sum(Quality(COMMON).rows([t])[0][-1] == k for k, t in texts)
    assert right() == len(texts)
    monkeypatch.setattr(quality, "divergence", lambda p, q: np.zeros((len(p), len(q))))
    assert right() == 0


def test_character_classes():
    assert class_counts(["aB1 .(|é漢☃", ""]).astype(int).tolist() == [[3, 1, 1, 1, 1, 1, 1, 1], [0] * 8]
    assert class_counts([]).shape == (0, 8)


def test_divergence():
    assert np.allclose(np.diag(divergence(PROFILES, PROFILES)), 0) and (divergence(np.eye(2), np.eye(2)) == [[0, 1], [1, 0]]).all()
    counter = LineCounter(COMMON)
    line = np.array([counter.count("the cache is not in the window, and it is late.", False)], float)
    assert KINDS[divergence(line / line.sum(), PROFILES).argmin()] == "prose"


def test_very_long_line():
    assert Quality(COMMON).rows(["x" * 200_000 + " " + "ab c " * 50_000])[0][1] == 100_001
