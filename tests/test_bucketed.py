from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import merge
from loomgraph.operators.graph import Graph
from loomgraph.sources import bucketed
from loomgraph.sources.bucketed import Bucketed, BucketedGraph, made_filter, may_hold

SCHEMA = "a string, b string, more long"


def rows(spark, *keys):
    return spark.createDataFrame([(a, b, 1) for a, b in keys], SCHEMA)


@pytest.fixture
def opened(monkeypatch):
    """Which buckets' rows are opened, with which columns."""
    seen = []
    inner = Bucketed._rows

    def noted(self, manifest, buckets=None):
        if buckets is not None:
            seen.append(list(buckets))
        return inner(self, manifest, buckets)

    monkeypatch.setattr(Bucketed, "_rows", noted)
    return seen


def test_filters():
    rng = np.random.default_rng(1)
    own, others = (rng.integers(-(1 << 63), (1 << 63) - 1, 20_000) for _ in range(2))
    image = made_filter(own)
    assert may_hold(image, own).all() and may_hold(image, others).mean() < 0.02
    assert not may_hold(made_filter(own[:0]), others).any()


def test_rows_are_added_once(spark, tmp_path):
    t = Bucketed(spark, f"file://{tmp_path}", SCHEMA, ("a", "b"), buckets=4)
    assert t.merge(rows(spark)) is None and t.read().collect() == []
    keys = [(f"k{i}", "x") for i in range(30)] + [(None, "x"), ("k0", None), (None, None)]
    assert t.merge(rows(spark, *keys, *keys[:9])).version == 1
    assert t.merge(rows(spark, *keys)).version == 1  # nothing is new
    assert t.merge(rows(spark, *keys, ("new", "y"))).version == 2
    found = sorted(((r.a, r.b) for r in t.read().collect()), key=repr)
    assert found == sorted([*keys, ("new", "y")], key=repr)


def test_only_touched_buckets_are_read(spark, tmp_path, opened):
    t = Bucketed(spark, f"file://{tmp_path}", SCHEMA, ("a", "b"), buckets=16)
    keys = [(f"k{i}", "x") for i in range(400)]
    t.merge(rows(spark, *keys))
    buckets = {r.a: r.bucket for r in t.bucket_of(rows(spark, *keys)).collect()}
    del opened[:]
    t.merge(rows(spark, keys[0], keys[1]))
    assert opened == [sorted({buckets["k0"], buckets["k1"]})]  # known keys: their buckets are compared, and nothing is written
    files = t.read([buckets["k0"]]).inputFiles()
    assert files and all(f"bucket={buckets['k0']}/" in f for f in files)
    del opened[:]
    new = ("a key that no filter knows", "x")
    t.merge(rows(spark, new))
    own = t.bucket_of(rows(spark, new)).first().bucket
    assert opened == [[], [own]]  # no key is compared; the filter of its bucket is made anew
    assert t.read().count() == 401


def test_folders_of_a_bucket_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucketed, "FOLDERS", 2)
    t = Bucketed(spark, f"file://{tmp_path}", SCHEMA, ("a", "b"), buckets=1)
    for i in range(5):
        t.merge(rows(spark, (f"k{i}", "x"), ("k0", "x")))
    assert sorted(r.a for r in t.read().collect()) == [f"k{i}" for i in range(5)]
    assert len(t.log.latest().content["buckets"]["0"]) <= 2


def test_two_writers(spark, tmp_path, monkeypatch):
    t, other = (Bucketed(spark, f"file://{tmp_path}", SCHEMA, ("a", "b"), buckets=2) for _ in range(2))
    inner, raced = t._added, []

    def late(*args):
        out = inner(*args)
        if not raced:
            raced.append(other.merge(rows(spark, ("both", "x"), ("other", "x"))))
        return out

    t._added = late
    t.merge(rows(spark, ("both", "x"), ("own", "x")))
    assert sorted(r.a for r in t.read().collect()) == ["both", "other", "own"]


def test_equals_merges_of_whole_tables(spark, tmp_path):
    g, want = BucketedGraph(spark, f"file://{tmp_path}/graph", buckets=4), Graph()
    for part in range(3):
        batch = spark.createDataFrame([(f"t{i % 7}", None if i % 3 else f"c{part}") for i in range(20)], "title string, context string")
        links = spark.createDataFrame([(f"a{i % 4}", f"b{i % (part + 2)}") for i in range(9)] + [(None, "b")], "src string, dst string")
        g.merge_nodes("T", batch)
        g.merge_edges("L", links)
        want = merge.merge_edges(merge.merge_nodes(want, "T", batch), "L", links)
    own = g.graph()
    for a, b in ((own.all_nodes().drop("props"), want.all_nodes().drop("props")), (own.all_edges(), want.all_edges())):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert own.match("n", "T").where_contains("n", "title", "T3").count().first().n == want.match("n", "T").where_contains("n", "title", "T3").count().first().n
    assert own.nodes["T"].select(F.countDistinct("id")).first()[0] == own.nodes["T"].count()


def test_filters_and_lots_are_bounded(spark, tmp_path, monkeypatch):
    """A bucket of many keys has a filter for each part of them, and a large batch meets them in lots."""
    monkeypatch.setattr(bucketed, "FILTER_KEYS", 2000, raising=False)
    monkeypatch.setattr(bucketed, "LOT", 500, raising=False)
    t = Bucketed(spark, f"file://{tmp_path}", SCHEMA, ("a", "b"), buckets=2)
    keys = spark.range(20_000).selectExpr("concat('k', id) AS a", "'x' AS b", "id AS more")
    t.merge(keys)
    last = t.log.latest()
    images = spark.read.parquet(*(f"{folder}/filters/bucket={b}" for b, folder in last.content["filters"].items()))
    assert images.count() >= 10 and images.selectExpr("max(length(image))").first()[0] <= 1 << 13  # not 16 KB and more, for 10,000 keys
    batch = t.bucket_of(keys)
    asked = t._asked({0: 10_000, 1: 10_000}, {int(b): n for b, n in last.content["parts"].items()})
    lots = t._lots(batch, asked).groupBy("bucket", "part", "lot").count()
    assert lots.selectExpr("sum(count)", "max(count) <= 1000").first() == (20_000, True)
    more = spark.range(15_000, 26_000).selectExpr("concat('k', id) AS a", "'x' AS b", "id AS more")
    t.merge(more)
    assert t.read().count() == t.read().select("a").distinct().count() == 26_000
    assert sum(t.log.latest().content["rows"].values()) == 26_000
    assert t.merge(more).version == 2


def test_versions_without_parts_are_read(spark, tmp_path):
    """Manifests and filters that were made when a bucket had one filter."""
    t = Bucketed(spark, f"file://{tmp_path}", SCHEMA, ("a", "b"), buckets=2)
    keys = [(f"k{i}", "x") for i in range(50)]
    t.merge(rows(spark, *keys))
    inner = t.log.latest

    def older():
        last = inner()
        for name in ("parts", "rows"):
            last.content.pop(name, None)
        return last

    t.log.latest = older
    t.merge(rows(spark, *keys, ("new", "y")))
    assert t.read().count() == 51
