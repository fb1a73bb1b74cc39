from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ingest, titles
from loomgraph.operators.graph import Graph
from loomgraph.sources.star import star_graph, table

SF = "/root/testdata/sf0.001"


def plain_split(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """Recursive splitting and merging of texts, step by step."""
    sign = next((s for s in separators if s == "" or s in text), separators[-1])
    left = separators[separators.index(sign) + 1 :]
    if sign == "":
        parts = list(text)
    else:
        head, *tail = text.split(sign)
        parts = [p for p in [head, *(sign + t for t in tail)] if p]
    out, good = [], []

    def flush():
        row, total = [], 0
        for p in good:
            if total + len(p) > size and row:
                out.append("".join(row).strip())
                while row and (total > overlap or total + len(p) > size):
                    total -= len(row.pop(0))
            row.append(p)
            total += len(p)
        if row:
            out.append("".join(row).strip())
        good.clear()

    for p in parts:
        if len(p) < size:
            good.append(p)
        else:
            flush()
            out += plain_split(p, size, overlap, left) if left else [p.strip()]
    flush()
    return [c for c in out if c]


def test_recursive_parts_equal_a_plain_version(spark):
    rnd = random.Random(4)
    texts = [r.text or "" for r in table(spark, SF, "documents").collect()]
    texts += ["".join(rnd.choice(["a", "bc", " ", "\n", "\n\n", "word ", "long" * 9]) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    texts += ["", " " * 50, "x" * 97, "\n\n" * 30, "é" * 41 + "\n\n" + "ü " * 40]
    for t in texts:
        for size, overlap in ((1000, 100), (20, 6), (7, 0)):
            spans = ingest.recursive_spans(t, size, overlap)
            assert [t[a:b] for a, b in spans] == plain_split(t, size, overlap), (t[:100], size)
            assert all(b - a <= size for a, b in spans)


def test_chunk_recursively(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, None), (3, ""), (4, " " * 20), (5, "short")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in ingest.chunk_recursively(docs, size=9, overlap=4).collect())
    assert [r[3] for r in rows if r[0] == 1] == plain_split("one two three four", 9, 4) == ["one two", "three", "four"]
    assert [r for r in rows if r[0] != 1] == [(2, 1, 1, ""), (3, 1, 1, ""), (5, 1, 1, "short")]
    with pytest.raises(ValueError):
        ingest.chunk_recursively(docs, size=5, overlap=5)


def test_trigrams_equal_the_scan(spark, tmp_path):
    own = [("a", "Żółw Nowak"), ("b", "NOWAK"), ("c", "now"), ("d", ""), ("e", None), ("f", "aaaa"), ("g", "aaa"), ("h", "a%b_c"), ("i", "東京大学"), ("j", "Nowak nowak")]
    rows = spark.createDataFrame(own, "id string, title string").unionByName(star_graph(spark, SF).all_nodes().select("id", "title"))
    index = titles.Trigrams(spark, f"file://{tmp_path}/index", buckets=8)
    index.build(rows)
    all_rows = [(r.id, r.title) for r in rows.collect() if r.title is not None]
    for pattern in ("nowak", "NOW", "aaaa", "aaaaa", "a%b", "東京大", "w n", "customer#0000000", "zz", "", "ż", "%"):
        found = sorted((r.id, r.title) for r in index.contains(pattern).collect())
        assert found == sorted((i, t) for i, t in all_rows if pattern.lower() in t.lower()), pattern


def test_a_pattern_reads_its_buckets_only(spark, tmp_path):
    index = titles.Trigrams(spark, f"file://{tmp_path}/index", buckets=32)
    index.build(star_graph(spark, SF).nodes["Customer"].select("id", "title"))
    plan = index.postings(["cus", "ust"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan
    wanted = index.postings(["cus", "ust"]).select(F.input_file_name()).distinct().collect()
    assert 0 < len({r[0].split("bucket=")[1].split("/")[0] for r in wanted}) <= 2


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_links_equal_all_pairs(spark, most):
    rnd, graph = random.Random(most), star_graph(spark, SF)
    nodes = [(r.id, r.title) for label in ("Nation", "Region", "Supplier") for r in graph.nodes[label].collect()]
    nodes += [("x1", "Kraków"), ("x2", "krakow "), ("x3", "ab"), ("x4", "a"), ("x5", ""), ("x6", None), ("x7", "ba")]
    mentions = [(i, t) for i, (_, t) in enumerate(nodes)]
    for i in range(60):
        t = list(rnd.choice([n for n in nodes if n[1]])[1])
        for _ in range(rnd.randint(0, most + 1)):
            k = rnd.randrange(len(t) + 1)
            t[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "1", "ż"])
        mentions.append((1000 + i, "".join(t)))
    fold = lambda t: "".join(c for c in (t or "").translate(str.maketrans("ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ")) if c.isascii()).strip().lower()
    want = []
    for key, m in mentions:
        near = sorted((d, t, i) for i, t in nodes if fold(m) and fold(t) and (d := edits(fold(m), fold(t))) <= most)
        want += [(key, i, t, d, k) for k, (d, t, i) in enumerate(near, 1)]
    df = spark.createDataFrame(nodes, "id string, title string")
    got = titles.linked(spark.createDataFrame(mentions, "mention_id long, mention string"), df, most)
    assert sorted(map(tuple, got.select("mention_id", "id", "title", "distance", "rank").collect())) == sorted(want)
    assert titles.linked_in(Graph(), spark.createDataFrame([(1, "x")], "mention_id long, mention string"), "No").collect() == []
