from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from loomgraph.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, part int, at string, short string"


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, n, buckets, seed, least, percent):
    """The rows that resample() gives, put together run by run."""

    def runs(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(x for _, d in docs for x in runs(d)), Counter(x for d in target for x in runs(d))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, d in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, runs(d)))
        out.append((i, len(words(d)), len(runs(d)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0, k) for k, r in enumerate(out) if r[1] >= least)
    rank = {x[3]: i for i, x in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r, rank.get(k)) for k, r in enumerate(out)]


@pytest.mark.parametrize("n", [1, 3])
def test_equals_a_plain_version(spark, n):
    texts = [None, "", "one", "A b ` { c-d É é 東京 東京 x9 " * 9, "of the " * 30000, "the of a " * 7, "the of a " * 7, "?! \n", "tail Word\n" * 40]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "null id of a text " * 6), (3, "again the third " * 5), (-5, "of a " * 20)]
    target = ["the of a", None, "東京 word", ""]
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in docs], DOCS)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=50, percent=40, min_words=5)
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target, n, 50, importance.SEED, 5, 40), key=key)


def test_ties_and_repeated_rows(spark):
    """Rows that are equal in everything get ranks of their own; every row stays."""
    df = spark.createDataFrame([(1, "a b c d e f")] * 500 + [(None, "a b c d e f")] * 500, "doc_id long, text string").repartition(7)
    rows = importance.resample(df, spark.createDataFrame([("a",)], "text string"), min_words=6, percent=60).collect()
    assert len(rows) == 1000 and sorted(r.rank for r in rows if r.rank) == list(range(1, 601))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    rows = importance.resample(spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), none, percent=100).collect()
    assert [(r.n_features, r.rank) for r in rows] == [(30, 1)]


def test_ring_over_parts(monkeypatch):
    """Features that are counted in parts are those of the whole text."""
    monkeypatch.setattr(importance, "HELD", 7)
    w = [b"a", b"bc", b"d"] * 50
    parts = list(importance._parts(w, 3, 1000))
    assert max(map(len, parts)) <= 7
    assert [x for p in parts for x in p.tolist()] == [x % 1000 for x in importance.features(w, 3)]
    assert Counter(importance.features(w, 3)) == Counter(zlib.crc32(b" ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
