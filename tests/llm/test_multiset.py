from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import multiset
from loomgraph.llm.multiset import EQUAL, LANES, LIKE

DOCS = "doc_id long, text string, key string, lanes string, part int"


def lanes(text):
    out = [0] * LANES
    for line in (text or "").split("\n"):
        own = hashlib.sha256(line.encode()).hexdigest()
        for i in range(EQUAL):
            out[i] += int(own[8 * i : 8 * i + 8], 16)
        for piece in filter(None, re.split(multiset.CUT, line)):
            part = hashlib.md5(piece.encode()).hexdigest()
            for k in range(LIKE):
                out[EQUAL + k] += int(part[8 * (k // 32) : 8 * (k // 32) + 8], 16) >> (k % 32) & 1
            out[-1] += 1
    return [x % 2**32 for x in out]


def digits(v):
    return "".join(f"{x:08x}" for x in v)


def likeness(a, b):
    x, y = ([2.0 * c - v[-1] for c in v[EQUAL : EQUAL + LIKE]] for v in (a, b))
    both = sum(p * p for p in x) * sum(p * p for p in y)
    return 1.0 if a == b else 0.0 if not both else max(0.0, min(1.0, sum(p * q for p, q in zip(x, y)) / both**0.5))


def plain(docs):
    """docs in the order of the operator."""
    out = []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = lanes(text), lanes(edited), lanes(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(a), digits(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return out


def run(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in multiset.edited_fingerprints(df).collect()), key=repr)


def test_equals_a_plain_version(spark):
    long = "Słowo and more words. " * 4000 + "\n" + "x" * 50000 + "\n" * 500
    texts = [None, "", "a", "\n", "one line. Two parts\nand a second, line", "東京は。\n漢字", long, "tail 😀😀 end\n\n", "a"]
    docs = [*enumerate(texts), (11, "same text"), (13, "same text")]
    df = spark.createDataFrame([(i, t, "k", "l", 1) for i, t in docs], DOCS).repartition(5)
    assert run(df) == sorted(plain(docs), key=repr)


def test_repeated_rows_and_null_ids(spark):
    """Copies follow each other, the last one is followed by what comes next; null ids come last."""
    docs = [(1, "first of all\nthings")] * 3 + [(2, "second and last\nthings, all")] + [(None, "no id at all")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert run(df) == sorted(plain(docs), key=repr)


def test_many_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(multiset, "SPREAD", 7)
    docs = [(1, "first of all")] * 50 + [(2, "the last")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert run(df) == sorted(plain(docs), key=repr)


def test_different_texts_under_one_id(spark):
    rows = run(spark.createDataFrame([(1, "one"), (1, "other text"), (2, "two")], "doc_id long, text string"))
    assert sorted((r[0], r[1]) for r in rows) == [(1, 3), (1, 10), (2, 3)]
    assert {r[3] for r in rows} == {digits(lanes(t)) for t in ("one", "other text", "two")}


def test_small_tables(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
    assert run(spark.createDataFrame([(5, "alone here")], "doc_id long, text string")) == plain([(5, "alone here")])


def test_homomorphic(spark):
    """The order of lines doesn't matter; a line is put in and taken out by its own vector."""
    texts = {1: "a line\nanother one, longer\na line", 2: "another one, longer\na line\na line", 3: "a line", 4: "a line\nanother one, longer"}
    found = multiset.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    own = {r.doc_id: r.lanes for r in found.collect()}
    assert own[1] == own[2] != own[4]
    pair = found.where("doc_id = 4").select(F.col("lanes").alias("x")).crossJoin(found.where("doc_id = 3").select(F.col("lanes").alias("y")))
    assert pair.select(multiset.inserted("x", "y")).first()[0] == own[1]
    back = pair.select(multiset.deleted(multiset.inserted("x", "y"), "y"), multiset.likeness("x", "x")).first()
    assert list(back) == [own[4], 1.0]


def test_likeness_tells_edits_from_others(spark):
    rows = multiset.op12_fingerprints(spark, "/root/testdata/sf0.01").where("n_chars > 500").select("near_edited", "near_next").collect()
    assert len(rows) > 500
    assert sum(r.near_edited > r.near_next for r in rows) > 0.97 * len(rows)
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("near_edited") > 0.45 and mean("near_next") < 0.15


def test_native(spark):
    df = multiset.op12_fingerprints(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(multiset.ORACLE)
    df = multiset.op12_fingerprints(spark, "/root/testdata/sf0.001")
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*(c[0] for c in cursor.description)).collect())
