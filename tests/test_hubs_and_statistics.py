from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import introspect, merge, skew
from loomgraph.operators.graph import Graph
from loomgraph.operators.introspect import Statistics
from loomgraph.sources.scratch import written


def star(spark, n=3000, hub=0.3):
    """Nodes a0.. to b0.., of which b0 has a good part of all edges, and one edge into nothing."""
    nodes = lambda kind, m: spark.range(m).select(F.concat(F.lit(kind), "id").alias("id"), F.concat(F.lit(kind), "id").alias("title"), F.lit("c").alias("context"), F.create_map(F.lit("title"), F.concat(F.lit(kind), "id")).alias("props"))
    far = F.when(F.col("id") < int(n * hub), F.lit(0)).otherwise(F.col("id") % 300)
    edges = spark.range(n).select(F.concat(F.lit("a"), "id").alias("src"), F.concat(F.lit("b"), far).alias("dst")).union(spark.createDataFrame([("a1", "nowhere"), (None, "b0")], "src string, dst string"))
    return Graph({"A": nodes("a", n), "B": nodes("b", 300)}, {"E": edges})


def test_frequent_keys(spark):
    df = spark.createDataFrame([("x",)] * 50 + [(f"k{i}",) for i in range(50)] + [(None,)] * 99, "k string")
    assert [(r.hub, r.salts) for r in skew.frequent(df, "k", 20).collect()] == [("x", 3)]
    assert skew.frequent(df, "k", 50) is None and skew.frequent(df.limit(0), "k", 1) is None


def test_both_ends_are_counted_in_one_pass(spark):
    passed = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([("a", f"b{i}") for i in range(30)] + [(f"a{i}", "b0") for i in range(60)] + [(None, "b0")] * 5, "src string, dst string")
    hubs = Graph({}, {"E": edges.mapInArrow(noted, "src string, dst string")}).with_hubs("E", rows=20).hubs
    assert {k[1]: [tuple(r) for r in v.collect()] for k, v in hubs.items()} == {"src": [("a", 2)], "dst": [("b0", 4)]}
    assert passed.value == 95


@pytest.mark.parametrize("reverse", [False, True])
def test_hub_patterns_give_the_same_rows(spark, reverse):
    g = star(spark)
    start, end = ("B", "A") if reverse else ("A", "B")
    ways = []
    for graph in (g, g.with_hubs("E", rows=200), g.with_hubs(rows=200)):
        m = graph.match("x", start).to("E", "y", end, reverse=reverse)
        again = m.carry("x", "y").to("E", "z", start, reverse=not reverse) if not reverse else m
        rows = again.returns(("x", "title", "x"), ("y", "title", "y"))
        ways.append(rows.groupBy("x", "y").count().agg(F.count(F.lit(1)), F.sum("count"), F.sum(F.xxhash64("x", "y", "count") % 1000003)).first())
    assert ways[0] == ways[1] == ways[2] and ways[0][1] > 2000


def test_no_task_has_the_hub_s_edges(spark):
    g, conf = star(spark, 20000), {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:

        def most(graph):
            rows = graph.match("b", "B").back("E", "a", "A").df
            edges = skew.spread(g.edges["E"], F.col("dst"), g.nodes["B"], F.col("id"), graph.hubs.get(("E", "dst")))
            counts = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
            assert rows.count() == 20000
            return max(counts) / statistics.median(counts)

        assert most(g) > 5 > 3 > most(g.with_hubs("E", rows=300))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def figures(s):
    return [sorted(map(tuple, df.select(*sorted(df.columns)).collect())) for df in (s.labels, s.triples, s.least)]


def cut(graph):
    """As a version that has been written: the plan doesn't grow with the writes."""
    return Graph({k: written(graph.nodes[k], "t") for k in graph.nodes}, {k: written(graph.edges[k], "t") for k in graph.edges})


def test_statistics_equal_a_full_count(spark):
    """After merges of nodes and edges, new and old, and deletes that take the least values, all of a label, and none."""
    frame = lambda *rows: spark.createDataFrame(rows, "title string, context string")
    g = merge.merge_nodes(Graph(), "A", frame(*((f"t{i:02}", f"c{i % 3}") for i in range(20))))
    g = merge.merge_nodes(g, "B", frame(("x", "y"), ("z", "y")))
    link = lambda g, a, b: g.nodes[a].select(F.col("id").alias("src")).crossJoin(g.nodes[b].select(F.col("id").alias("dst")))
    g = cut(merge.merge_edges(cut(g), "E", link(g, "A", "B")))
    now = Statistics.of(g, 3)
    assert figures(now) == figures(Statistics.of(g, 3))
    for batch in (frame(("a0", "c1"), ("t01", "c1"), ("zz", "c9")), frame(("t01", "c1"))):
        more = merge.new_nodes(g, "A", batch)
        after = cut(merge.merge_nodes(g, "A", batch))
        edges = merge.new_edges(after, "E", link(after, "A", "B"))
        after = merge.merge_edges(after, "E", link(after, "A", "B"))
        now, g = now.changed(after, added=Graph({"A": more}, {"E": edges})), cut(after)
        assert figures(now) == figures(Statistics.of(g, 3))
    new = frame(("n", "1"))
    after = cut(merge.merge_nodes(g, "New", new))
    now, g = now.changed(after, added=Graph({"New": merge.new_nodes(g, "New", new)})), after
    assert figures(now) == figures(Statistics.of(g, 3))
    for label, which in (("A", "title in ('a0', 't00', 't05')"), ("B", "true"), ("New", "false")):
        gone = g.nodes[label].where(which)
        after = cut(merge.detach_delete(g, gone))
        now, g = now.changed(after, removed=merge.removed(g, gone), before=g), after
        assert figures(now) == figures(Statistics.of(g, 3)), (label, which)
    assert sorted(r.label for r in introspect.labels(g).collect()) == ["A", "New"]
