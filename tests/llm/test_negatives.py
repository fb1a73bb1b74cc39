from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import negatives
from loomgraph.llm.negatives import Tree, interval, node_pairs, packed, products, unpacked

ROWS = "vec_id long, label long, q array<long>, id string, leaf int"


def plain(rows, every, k=5, m=5, band=(80, 100, 100)):
    named = {}
    for i, label, q in rows:
        if i is not None and label is not None and q is not None and None not in q and (i not in named or (label, q) < named[i]):
            named[i] = (label, q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in named.items():
        if a % every == 0:
            scores = sorted((-dot(q, v), i, other == label) for i, (other, v) in named.items() if i != a)
            for s, i, _ in [x for x in scores if x[2]][:k]:
                good = [(n, -t) for t, n, same in scores if not same and band[0] * -s <= band[2] * -t <= band[1] * -s][:m]
                out += [(a, i, r, n, -s, t) for r, (n, t) in enumerate(good, 1)]
    return sorted(out)


def run(spark, rows, every, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(5)
    found = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **how)
    assert found.dtypes == [tuple(c.replace("long", "bigint").split()) for c in negatives.RESULT.split(", ")]
    return sorted(map(tuple, found.collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAF_ROWS", 20), ("CELL_ROWS", 15), ("ANCHORS", 6), ("SAMPLE", 200)):
        monkeypatch.setattr(negatives, name, value)


def test_equals_a_plain_version(spark, small):
    """Many leaves, parts of leaves and slots of anchors; ties, copies, nulls, shorter vectors, repeated ids."""
    r = random.Random(5)
    middle = [[r.randint(-60, 60) for _ in range(6)] for _ in range(5)]
    rows = [(i, r.randrange(3), [c + r.randint(-9, 9) for c in middle[r.randrange(5)]]) for i in range(400)]
    rows += [(1000 + i, i % 3, [50, 50, 50, 50, 50, 50]) for i in range(150)]  # many copies of a vector
    rows += [(2000, 1, None), (2010, None, [1]), (None, 1, [1, 2]), (2020, 1, [1, None]), (2030, 1, []), (2040, 2, [40, 40]), (2050, 0, [0] * 6), (20, 2, [9, 9]), (20, 0, [9, 9]), (30, 9, [5] * 6)]
    rows += [(i, label, q) for i, label, q in rows[:40]]
    want = plain(rows, 10)
    assert len(want) > 500
    assert run(spark, rows, 10) == want


def test_few_rows(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(1, 1, [1])], 10) == []  # no anchor
    assert run(spark, [(10, 1, [1])], 10) == []
    assert run(spark, [(10, 1, [3]), (11, 1, [3]), (12, 2, [3])], 10) == [(10, 11, 1, 12, 9, 9)]


def test_bands_and_large_numbers(spark):
    big = 1 << 30
    rows = [(i, i % 2, [big - i * 7, -big + i]) for i in range(40)]
    assert run(spark, rows, 4, positives=3, negatives=2, band=(99, 100, 100)) == plain(rows, 4, 3, 2, (99, 100, 100))


def test_matches_sql(spark, small):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    cursor = con.execute(negatives.ORACLE)
    rows = negatives.op13_hard_negatives(spark, "/root/testdata/sf0.1").select(*(c[0] for c in cursor.description)).collect()
    assert len(rows) > 200
    assert sorted(map(tuple, rows)) == sorted(cursor.fetchall())


def test_rows_that_take_no_part(spark, tmp_path):
    rows = [(100, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [float("nan"), 1.0], 2), (3, [float("inf"), 1.0], 2), (4, None, 2), (5, [1.0, None], 2), (6, [0.99, 0.5], None), (7, [0.9, 0.5], 1), (8, [0.9, 0.4], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    # 7 is divisible by 7, so its label becomes 2
    got = [tuple(r) for r in negatives.op13_hard_negatives(spark, str(tmp_path)).collect()]
    assert sorted(r[:4] for r in got) == [(100, 1, 1, 7), (100, 1, 2, 8)]


def test_pruning_is_safe_and_prunes():
    rng = np.random.default_rng(3)
    x, y = (np.concatenate([rng.integers(-20, 20, (200, 8)) + c for c in rng.integers(-300, 300, (6, 1, 8))]) for _ in range(2))
    a, b = Tree(x.astype(float), 16), Tree(y.astype(float), 16)
    s = products(x, y)
    low = np.partition(s, -5, 1)[:, -5].astype(float)
    of, to = node_pairs(a, b, low, np.full(len(x), np.inf))
    assert len(of) < 0.5 * len(a.leaves) * len(b.leaves)
    seen = np.zeros(s.shape, bool)
    for i, j in zip(of, to):
        seen[np.ix_(a.order[a.start[i] : a.end[i]], b.order[b.start[j] : b.end[j]])] = True
    assert not (~seen & (s >= low[:, None])).any()
    for i, j in rng.integers(0, [len(a.start), len(b.start)], (50, 2)):
        own = s[np.ix_(a.order[a.start[i] : a.end[i]], b.order[b.start[j] : b.end[j]])]
        down, up = interval(a.centre[i] @ b.centre[j], a.norm[i], a.radius[i], b.norm[j], b.radius[j])
        assert down <= own.min() and own.max() <= up


def test_packing_and_exact_products():
    rows = [[], [0], [127, -128], [128], [-40000, 7], [1 << 40], [-(1 << 63), (1 << 63) - 1]]
    assert [r[: len(q)] for r, q in zip(unpacked(packed(rows), 2).tolist(), rows)] == rows
    big = np.array([[3037000499, 1], [1, 1]])
    assert products(big, big).tolist() == [[3037000499**2 + 1, 3037000500], [3037000500, 2]]
    with pytest.raises(OverflowError):
        products(np.array([[1 << 40]]), np.array([[1 << 40]]))
