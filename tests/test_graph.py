from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import introspect, merge
from loomgraph.operators.graph import Graph, limited, reachable
from loomgraph.sources.snapshots import names, read_snapshot, write_snapshot

BATCH = (
    "MERGE (c1:Course {title: 'Analysis', context: 'first year'})|MERGE (c2:Course {title: 'Numerical Methods', context: ''})|"
    "MERGE (c3:Course {title: 'Robotics', context: 'it\\'s hard'})|MERGE (p1:Professor {title: 'Prof. Wiśniewska', context: 'a|b'})|"
    "MERGE (c1)-[:NEEDED_FOR]->(c2)|MERGE (c2)-[:NEEDED_FOR]->(c3)|MERGE (p1)-[:TEACHES]->(c1)|MERGE (p1)-[:TEACHES]->(c2)"
)


def seeded(spark, *batches):
    rows = merge.statement_rows(spark.createDataFrame([(i, b) for i, b in enumerate(batches or (BATCH,))], "batch int, text string"))
    return merge.merge_batches(Graph(), rows)


def sizes(g):
    return g.all_nodes().count(), g.all_edges().count()


def test_batch_gives_nodes_and_edges_by_variables(spark):
    g = seeded(spark)
    assert sizes(g) == (4, 4)
    assert {r.title for r in g.nodes["Professor"].collect()} == {"Prof. Wiśniewska"}
    assert {r.context for r in g.nodes["Course"].collect()} == {"first year", "", "it's hard"}


def test_merge_is_idempotent(spark):
    assert sizes(seeded(spark, BATCH, BATCH)) == (4, 4)
    g = seeded(spark)
    rows = merge.statement_rows(spark.createDataFrame([(7, BATCH)], "batch int, text string"))
    assert sizes(merge.merge_batches(g, rows)) == (4, 4)


def test_rejects(spark):
    texts = ["CREATE (a:B {title: 'x', context: 'y'})", "MERGE (a)-[:bad_type]->(b)", "MERGE (a)-[:OK]->(b)", "  ", None]
    rows = merge.statement_rows(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "batch int, text string")).collect()
    assert [(r.batch, r.kind) for r in sorted(rows)] == [(0, "rejected"), (1, "rejected"), (2, "edge")]


def test_reused_variables_and_unbound_edges(spark):
    rows = merge.statement_rows(spark.createDataFrame([(0, "MERGE (a:X {title: 'x', context: ''})|MERGE (a:Y {title: 'y', context: ''})|MERGE (a)-[:R]->(zz)")], "batch int, text string"))
    assert [(r.var, r.n) for r in merge.reused_variables(rows).collect()] == [("a", 2)]
    assert merge.batch_rows(rows)[1].count() == 0


def test_patterns(spark):
    g = seeded(spark)
    who = g.match("p", "Professor").to("TEACHES", "c", "Course").where_contains("c", "title", "ANALYSIS")
    assert [r.p for r in who.returns(("p", "title", "p")).collect()] == ["Prof. Wiśniewska"]
    both = g.match("a", "Course").back("TEACHES", "p", "Professor").to("TEACHES", "b", "Course")
    assert both.df.count() == 2  # an edge is passed once
    again = g.match("a", "Course").back("TEACHES", "p", "Professor").carry("p").to("TEACHES", "b", "Course")
    assert again.df.count() == 4  # a new clause may pass it again
    assert g.match("a").where_equal("a", "title", None).df.count() == 0
    lone = g.match("c", "Course").back("TEACHES", "p", "Professor", optional=True)
    assert lone.df.where("p__id is null").count() == 1
    assert g.match("c", "Course").also(g.match("p", "Professor")).df.count() == 3
    assert limited(g.match("c", "Course").df, 2).count() == 2


def test_commas_share_variables_and_edges(spark):
    g = seeded(spark)
    teaches = lambda p, c: g.match(p, "Professor").to("TEACHES", c, "Course")
    both = teaches("p", "c").also(teaches("q", "d"))
    assert both.df.count() == 2 and both.vars == ("p", "c", "q", "d")  # never the same edge twice
    same = teaches("p", "c").also(teaches("p", "d"))
    assert same.df.count() == 2 and same.vars == ("p", "c", "d")
    assert same.to("NEEDED_FOR", "e", "Course").df.count() == 2
    assert g.match("x", "Nothing").df.count() == 0 and g.match("c", "Course").to("NO_TYPE", "d").df.count() == 0


def test_a_filtered_start_meets_the_edges_first(spark, tmp_path):
    write_snapshot(seeded(spark), f"{tmp_path}/v")
    g = read_snapshot(spark, f"{tmp_path}/v")
    m = g.match("a", "Professor").where_equal("a", "title", "x").to("TEACHES", "b", "Course").to("NEEDED_FOR", "c", "Course")
    plan = m.returns(("c", "title", "t"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {name: next(len(line) - len(line.lstrip(" :+-|")) for line in plan if name in line) for name in ("e0__b_a", "e1__c_a")}
    joins = [len(line) - len(line.lstrip(" :+-|")) for line in plan if "Join" in line]
    assert len(joins) == 4 and joins == sorted(joins)  # each join is the left side of the one above it
    assert any("(title" in line and "= x" in line for line in plan[plan.index(next(x for x in plan if "Join" in x)) :]) and depth


def test_empty_graphs(spark, tmp_path):
    g = Graph()
    assert sizes(g) == (0, 0) and introspect.labels(g).count() == 0 and introspect.triples(g).count() == 0 and introspect.samples(g).count() == 0
    assert introspect.summary_text(g).startswith("NODE TYPES: \n") and introspect.is_empty_schema(introspect.schema_text(g))
    write_snapshot(g, f"{tmp_path}/none")
    assert sizes(read_snapshot(spark, f"{tmp_path}/none")) == (0, 0)
    lone = merge.merge_nodes(g, "X", spark.createDataFrame([("a", "b")], "title string, context string"))
    write_snapshot(lone, f"{tmp_path}/lone")
    assert sizes(read_snapshot(spark, f"{tmp_path}/lone")) == (1, 0)


def test_a_snapshot_without_its_marker_is_none(spark, tmp_path):
    path = f"{tmp_path}/v"
    seeded(spark).all_nodes().write.partitionBy("label").parquet(f"{path}/nodes")  # as if the writer had ended there
    with pytest.raises(ValueError, match="no finished version"):
        read_snapshot(spark, path)
    write_snapshot(seeded(spark), path)
    assert sizes(read_snapshot(spark, path)) == (4, 4)


def test_very_long_statements(spark):
    from loomgraph.functions.text import with_limit

    for n in (30_000, 1_000_000):
        long = "|\\'x" * (n // 4)
        text = f"MERGE (a:X {{title: 't', context: '{long}'}})|MERGE (b:X {{title: '{long}', context: ''}})|MERGE (a)-[:R]->(b)|MERGE (c:X {{title: 'open"
        rows = merge.statement_rows(spark.createDataFrame([(0, text + "|" * n)], "batch int, text string")).orderBy("pos").collect()
        assert [r.kind for r in rows] == ["node", "node", "edge", "rejected"]
        assert rows[0].context == rows[1].title == "|'x" * (n // 4)
        query = spark.createDataFrame([(f"MATCH (n {{title: '{long}'}}) WHERE n.x = \"{long} limit 4\" RETURN n;",)], "q string").select(with_limit("q").alias("q")).first().q
        assert query.endswith("RETURN n LIMIT 5")


def test_samples_of_many_values(spark):
    rows = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 1000).alias("title"), (F.col("id") % 3).cast("string").alias("context"))
    got = {r.property: r.samples for r in introspect.samples(merge.merge_nodes(Graph(), "X", rows), 7).collect()}
    assert got == {"title": sorted(f"v{i}" for i in range(1000))[:7], "context": ["0", "1", "2"]}


def test_unmatched_match_merge_writes_nothing(spark):
    g = seeded(spark)
    m = g.match("p", "Professor").where_equal("p", "title", "nobody").also(g.match("c", "Course"))
    assert merge.match_merge(g, m, "p", "LIKES", "c").edges["LIKES"].count() == 0


def test_delete(spark):
    g = seeded(spark)
    gone = merge.detach_delete(g, g.nodes["Course"].where("title = 'Numerical Methods'"))
    assert sizes(gone) == (3, 1)
    assert sizes(merge.detach_delete(g)) == (0, 0)


def test_reachable(spark):
    found = {(r.a, r.b): r.steps for r in reachable(seeded(spark).edges["NEEDED_FOR"], 3).collect()}
    assert sorted(found.values()) == [1, 1, 2]


def test_schema(spark):
    g = seeded(spark)
    text = introspect.schema_text(g)
    assert "(:Professor)-[:TEACHES]->(:Course)" in text and "Course.title: Analysis, Numerical Methods, Robotics" in text
    assert introspect.is_empty_schema("\n".join(introspect.HEADINGS)) and introspect.is_empty_schema("  ") and introspect.is_empty_schema(None)
    assert not introspect.is_empty_schema(text)
    assert introspect.summary_text(g).startswith("NODE TYPES: Course (3), Professor (1)\nRELATIONSHIP TYPES: NEEDED_FOR, TEACHES")
    cache = introspect.SchemaCache()
    assert cache.get("1", g) == text and cache.get("1", None) == text
    with pytest.raises(AttributeError):
        cache.get("2", None)
    assert introspect.SchemaCache().get("1", Graph()) == ""


def test_snapshots(spark, tmp_path):
    g, path = seeded(spark), f"file://{tmp_path}/v1"
    write_snapshot(g, path)
    assert {r.label for r in names(spark, path)[0].collect()} == {"Course", "Professor"}
    back = read_snapshot(spark, path, ["Course", "Professor"], ["TEACHES"])
    assert back.nodes["Course"].count() == 3 and back.edges["TEACHES"].count() == 2
    plan = back.nodes["Course"]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(label" in plan
    with pytest.raises(Exception, match="(?i)exists"):
        write_snapshot(g, path)


def test_pushdown_and_pruning(spark):
    from loomgraph.sources.star import star_graph

    g = star_graph(spark, "/root/testdata/sf0.001")
    plan = g.match("r", "Region").where_equal("r", "title", "ASIA").returns(("r", "title", "t"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(r_name), EqualTo(r_name,ASIA)]" in plan
    plan = g.match("c", "Customer").returns(("c", "title", "t"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_name:string>" in plan


def test_node_identity_has_all_properties(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "b"), (None, "b"), ("a", None)], "title string, context string")
    assert merge.merge_nodes(Graph(), "X", rows).nodes["X"].select(F.countDistinct("id")).first()[0] == 4
