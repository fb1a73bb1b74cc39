"""Queries over the test tables, one or more for each operator, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import ingest, introspect, merge, sessions, titles
from loomgraph.operators.graph import Graph, limited, node_id, reachable
from loomgraph.plans import extraction, retrieval
from loomgraph.plans.chat import chat
from loomgraph.plans.linking import SchemaPlan
from loomgraph.plans.replies import Model, Replies
from loomgraph.sources import seed
from loomgraph.sources.bucketed import BucketedGraph
from loomgraph.sources.history import History
from loomgraph.sources.files import as_json, read_directory, read_text
from loomgraph.sources.scratch import work_path, written
from loomgraph.sources.session_log import SessionLog
from loomgraph.sources.snapshots import read_snapshot, read_store, write_snapshot, write_store
from loomgraph.sources.star import star_graph, table
from loomgraph.streaming import live
from loomgraph.streaming import sessions as live_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# patterns


@query("SELECT n_name AS title FROM nation")
def match_label_scan(spark, d):
    return star_graph(spark, d).match("n", "Nation").returns(("n", "title", "title"))


@query("SELECT 'Region:' || r_regionkey AS id, r_name AS title FROM region WHERE r_name = 'ASIA'")
def match_prop_eq(spark, d):
    return star_graph(spark, d).match("r", "Region").where_equal("r", "title", "ASIA").returns(("r", "id", "id"), ("r", "title", "title"))


@query("SELECT p_name AS title, p_type AS context FROM part WHERE contains(lower(p_name), lower('WIDGET'))")
def match_fuzzy_contains(spark, d):
    return star_graph(spark, d).match("p", "Part").where_contains("p", "title", "WIDGET").returns(("p", "title", "title"), ("p", "context", "context"))


@query("SELECT label, count(*) AS n FROM (SELECT 'Region' AS label FROM region UNION ALL SELECT 'Nation' FROM nation UNION ALL SELECT 'Customer' FROM customer UNION ALL SELECT 'Supplier' FROM supplier UNION ALL SELECT 'Part' FROM part UNION ALL SELECT 'Order' FROM orders) GROUP BY label")
def schema_labels(spark, d):
    return introspect.labels(star_graph(spark, d))


@query("SELECT count(*) AS n FROM (SELECT c_name AS t FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders) WHERE contains(lower(t), '7')")
def match_any_label(spark, d):
    return star_graph(spark, d).match("x").where_contains("x", "title", "7").count()


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def expand_one_hop(spark, d):
    return star_graph(spark, d).match("c", "Customer").to("CUSTOMER_IN", "n", "Nation").returns(("c", "title", "customer"), ("n", "title", "nation"))


@query("SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def expand_two_hop(spark, d):
    m = star_graph(spark, d).match("c", "Customer").to("CUSTOMER_IN", "n", "Nation").to("IN_REGION", "r", "Region").where_equal("r", "title", "EUROPE")
    return m.returns(("c", "title", "customer"), ("n", "title", "nation"), ("r", "title", "region"))


@query("SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1')")
def expand_reverse(spark, d):
    m = star_graph(spark, d).match("n", "Nation").where_contains("n", "title", "nation_1").back("SUPPLIER_IN", "s", "Supplier")
    return m.returns(("n", "title", "nation"), ("s", "title", "supplier"))


@query("SELECT s_name AS supplier, p_name AS part FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey")
def expand_many_to_many(spark, d):
    return star_graph(spark, d).match("s", "Supplier").to("SUPPLIES", "p", "Part").returns(("s", "title", "supplier"), ("p", "title", "part"))


@query("WITH e AS (SELECT DISTINCT l_orderkey AS o, CASE WHEN l_linenumber = 1 THEN 1 ELSE l_partkey END AS p FROM lineitem) SELECT p_name AS part, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customers FROM e JOIN part ON p = p_partkey JOIN orders ON o = o_orderkey GROUP BY p_partkey, p_name")
def expand_hub(spark, d):
    """A part that a fifth of all edges lead to: its edges are dealt over many tasks, on the way to it and from it."""
    g = star_graph(spark, d)
    lines = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, F.lit(1)).otherwise(F.col("l_partkey")).alias("p")).distinct()
    lines = lines.select(F.concat(F.lit("Order:"), "l_orderkey").alias("src"), F.concat(F.lit("Part:"), "p").alias("dst"))
    lines = written(lines, "holds")  # made distinct once, for the count of hubs and for the pattern
    g = Graph(g.nodes, {"HOLDS": lines, "PLACED": g.edges["PLACED"]}).with_hubs("HOLDS", rows=2000)
    m = g.match("p", "Part").back("HOLDS", "o", "Order").back("PLACED", "c", "Customer")
    rows = m.returns(("p", "id", "id"), ("p", "title", "part"), ("c", "id", "customer"))
    return rows.groupBy("id", "part").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.split("customer", ":")[1].cast("long")).alias("customers")).drop("id")


@query("SELECT n_name AS nation, s_name AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def expand_optional(spark, d):
    return star_graph(spark, d).match("n", "Nation").back("SUPPLIER_IN", "s", "Supplier", optional=True).returns(("n", "title", "nation"), ("s", "title", "supplier"))


@query("SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation WHERE r_name = 'ASIA' AND contains(lower(n_name), '2')")
def pattern_cartesian(spark, d):
    g = star_graph(spark, d)
    m = g.match("r", "Region").where_equal("r", "title", "ASIA").also(g.match("n", "Nation").where_contains("n", "title", "2"))
    return m.returns(("r", "title", "region"), ("n", "title", "nation"))


@query("SELECT a.n_name AS one, r_name AS region, b.n_name AS other FROM nation a JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey WHERE a.n_nationkey <> b.n_nationkey")
def same_type_rel_uniqueness(spark, d):
    m = star_graph(spark, d).match("a", "Nation").to("IN_REGION", "r", "Region").back("IN_REGION", "b", "Nation")
    return m.returns(("a", "title", "one"), ("r", "title", "region"), ("b", "title", "other"))


@query("SELECT a.n_name AS one, x.r_name AS its, b.n_name AS other, y.r_name AS theirs FROM nation a JOIN region x ON a.n_regionkey = x.r_regionkey, nation b JOIN region y ON b.n_regionkey = y.r_regionkey WHERE contains(a.n_name, '1') AND contains(b.n_name, '2') AND a.n_nationkey <> b.n_nationkey")
def comma_rel_uniqueness(spark, d):
    g = star_graph(spark, d)
    one = g.match("a", "Nation").where_contains("a", "title", "1").to("IN_REGION", "r", "Region")
    other = g.match("b", "Nation").where_contains("b", "title", "2").to("IN_REGION", "s", "Region")
    return one.also(other).returns(("a", "title", "one"), ("r", "title", "its"), ("b", "title", "other"), ("s", "title", "theirs"))


@query("SELECT n_name AS nation, c_name AS customer, s_name AS supplier FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' AND contains(c_name, '9')")
def comma_common_variable(spark, d):
    g = star_graph(spark, d)
    buys = g.match("n", "Nation").where_equal("n", "title", "NATION_7").back("CUSTOMER_IN", "c", "Customer").where_contains("c", "title", "9")
    both = buys.also(g.match("n", "Nation").back("SUPPLIER_IN", "s", "Supplier"))
    return both.returns(("n", "title", "nation"), ("c", "title", "customer"), ("s", "title", "supplier"))


@query("WITH w AS (SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA') SELECT n_name AS nation, c_name AS customer FROM w JOIN customer ON c_nationkey = n_nationkey")
def with_pipeline(spark, d):
    m = star_graph(spark, d).match("r", "Region").where_equal("r", "title", "AFRICA").back("IN_REGION", "n", "Nation").carry("n").back("CUSTOMER_IN", "c", "Customer")
    return m.returns(("n", "title", "nation"), ("c", "title", "customer"))


@query("SELECT c_name AS title FROM customer ORDER BY c_name LIMIT 5")
def limit_default_5(spark, d):
    return limited(star_graph(spark, d).match("c", "Customer").returns(("c", "title", "title")), order=[F.col("title")])


@query("SELECT c_name AS title FROM customer ORDER BY c_name LIMIT 10")
def limit_explicit_10(spark, d):
    return limited(star_graph(spark, d).match("c", "Customer").returns(("c", "title", "title")), 10, [F.col("title")])


@query("SELECT DISTINCT c_mktsegment AS segment, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def returns_distinct(spark, d):
    m = star_graph(spark, d).match("c", "Customer").to("CUSTOMER_IN", "n", "Nation").to("IN_REGION", "r", "Region")
    return m.returns(("c", "context", "segment"), ("r", "title", "region"), distinct=True)


@query("SELECT doc_id, CASE WHEN contains(upper(text), 'LIMIT') THEN text ELSE regexp_replace(text, ';+$', '') || ' LIMIT 5' END AS query FROM documents")
def limit_injection_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.with_limit_by_substring("text").alias("query"))


@query("""SELECT n_nationkey AS k, CASE n_nationkey % 6 WHEN 0 THEN 'MATCH (n) RETURN n.title LIMIT 5' WHEN 1 THEN 'MATCH (n) RETURN n LIMIT 5' WHEN 2 THEN 'MATCH (n) RETURN n limit 3;' WHEN 3 THEN 'MATCH (n {title: ''limit 3''}) RETURN n LIMIT 5'
WHEN 4 THEN 'MATCH (n {title: "it''s limit 3", context: ' || chr(39) || repeat('a' || chr(92) || chr(39) || ' limit 7 ', 2000) || chr(39) || '}) RETURN n LIMIT 5' ELSE 'MATCH (n:' || n_name || ') RETURN n.limited LIMIT 5' END AS query FROM nation""")
def limit_injection_quoted(spark, d):
    kinds = ("MATCH (n) RETURN n.title", "MATCH (n) RETURN n; \n;", "MATCH (n) RETURN n limit 3;", "MATCH (n {title: 'limit 3'}) RETURN n", "MATCH (n {title: \"it's limit 3\", context: '" + "a\\' limit 7 " * 2000 + "'}) RETURN n")
    text = F.concat(F.lit("MATCH (n:"), "n_name", F.lit(") RETURN n.limited"))
    for i, kind in enumerate(kinds):
        text = F.when(F.col("n_nationkey") % 6 == i, kind).otherwise(text)
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), T.with_limit(text).alias("query"))


@query("SELECT 1 AS test")
def literal_projection(spark, d):
    return spark.range(1).select(F.lit(1).alias("test"))


@query("""WITH RECURSIVE e AS (SELECT 'Customer:' || c_custkey AS a, 'Nation:' || c_nationkey AS b FROM customer UNION ALL SELECT 'Nation:' || n_nationkey, 'Region:' || n_regionkey FROM nation),
w AS (SELECT a, b, 1 AS steps FROM e UNION SELECT w.a, e.b, steps + 1 FROM w JOIN e ON w.b = e.a WHERE steps < 3) SELECT a, b, CAST(min(steps) AS INT) AS steps FROM w GROUP BY a, b""")
def reachable_pairs(spark, d):
    g = star_graph(spark, d)
    return reachable(g.edges["CUSTOMER_IN"].union(g.edges["IN_REGION"]), 3)


_PATTERNS = ("widget", "R#0000", "omer#00000000", "7", "GADGET", "no such title", "")


@query("WITH t AS (SELECT 'Customer' AS label, c_name AS t FROM customer UNION ALL SELECT 'Part', p_name FROM part UNION ALL SELECT 'Supplier', s_name FROM supplier) SELECT pattern, count(*) FILTER (contains(lower(t), lower(pattern))) AS n FROM t, (VALUES " + ", ".join(f"('{p}')" for p in _PATTERNS) + ") AS p(pattern) GROUP BY pattern")
def contains_by_trigrams(spark, d):
    """Parts of the titles of all customers, parts and suppliers, by an index of trigrams; short patterns by a scan."""
    g, index = star_graph(spark, d), titles.Trigrams(spark, work_path(spark, "trigrams"), buckets=16)
    index.build(reduce(DataFrame.unionByName, [g.nodes[k].select("id", "title") for k in ("Customer", "Part", "Supplier")]))
    found = [index.contains(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("pattern"), "n") for p in _PATTERNS]
    return reduce(DataFrame.union, found)


_TYPED = "CASE s_suppkey % 4 WHEN 0 THEN lower(s_name) WHEN 1 THEN substring(s_name, 1, 3) || substring(s_name, 5) WHEN 2 THEN 'x' || s_name ELSE substring(s_name, 1, length(s_name) - 1) || '0' END"


@query(f"""WITH m AS (SELECT s_suppkey AS mention_id, lower({_TYPED}) AS asked FROM supplier), n AS (SELECT 'Supplier:' || s_suppkey AS id, s_name AS title, lower(s_name) AS name FROM supplier)
SELECT mention_id, id, title, CAST(levenshtein(asked, name) AS INT) AS distance, CAST(row_number() OVER (PARTITION BY mention_id ORDER BY levenshtein(asked, name), title, id) AS INT) AS rank FROM m, n WHERE levenshtein(asked, name) <= 1""")
def entities_within_one_edit(spark, d):
    """Suppliers' names with a letter lost, added or changed, linked to all suppliers within one edit."""
    mentions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mention_id"), F.expr(_TYPED).alias("mention"))
    return titles.linked_in(star_graph(spark, d), mentions, "Supplier")


# writes


@query("SELECT sha256('Part' || chr(31) || p_brand || chr(31) || p_type) AS id, p_brand AS title, p_type AS context FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def merge_nodes_idempotent(spark, d):
    batch = table(spark, d, "part").select(F.col("p_brand").alias("title"), F.col("p_type").alias("context"))
    g = merge.merge_nodes(Graph(), "Part", batch)
    return merge.merge_nodes(g, "Part", batch).nodes["Part"].select("id", "title", "context")


@query("SELECT CAST(4 * count(*) AS BIGINT) AS nodes, CAST(4 * count(*) AS BIGINT) AS ids FROM nation")
def merge_nodes_separators(spark, d):
    """Titles and contexts that hold separators, and nulls beside the sign of a null: all are nodes of their own."""
    s = table(spark, d, "nation").select(F.col("n_name").alias("n"))
    sign, null = F.lit("\x1f"), F.lit(None).cast("string")
    kinds = [(F.concat("n", sign, F.lit("b")), F.lit("c")), (F.col("n"), F.concat(F.lit("b"), sign, F.lit("c"))), (F.col("n"), null), (F.col("n"), F.lit("\x00"))]
    batch = reduce(DataFrame.union, [s.select(t.alias("title"), c.alias("context")) for t, c in kinds])
    g = merge.merge_nodes(merge.merge_nodes(Graph(), "Odd", batch), "Odd", batch)
    return g.nodes["Odd"].agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("id").alias("ids"))


@query("""SELECT 'Part' AS name, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part) UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def merge_into_buckets(spark, d):
    """Nodes and edges in three batches that overlap, into buckets; the last batch holds nothing new."""
    g = BucketedGraph(spark, work_path(spark, "bucketed"), buckets=8)
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("title"), F.col("p_type").alias("context"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("Supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("Part:"), "l_partkey").alias("dst"))
    for some in ("{} % 3 < 2", "{} % 3 > 0", "true"):
        g.merge_nodes("Part", parts.where(some.format("p_partkey")))
        g.merge_edges("SUPPLIES", lines.where(some.format("l_orderkey")))
    own = g.graph()
    return own.all_nodes().select(F.col("label").alias("name")).union(own.all_edges().select("type")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'Supplier:' || l_suppkey AS src, 'Part:' || l_partkey AS dst FROM lineitem")
def merge_rels_idempotent(spark, d):
    batch = table(spark, d, "lineitem").select(F.concat(F.lit("Supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("Part:"), "l_partkey").alias("dst"))
    return merge.merge_edges(merge.merge_edges(Graph(), "SUPPLIES", batch), "SUPPLIES", batch).edges["SUPPLIES"]


@query("SELECT title, count(*) AS n FROM (SELECT n_name AS title FROM nation WHERE n_nationkey < 10 UNION SELECT n_name FROM nation WHERE n_nationkey >= 5) GROUP BY title")
def merge_against_existing(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("title"), F.lit("").alias("context"))
    g = merge.merge_nodes(Graph(), "Nation", rows.where("n_nationkey < 10"))
    g = merge.merge_nodes(g, "Nation", rows.where("n_nationkey >= 5"))
    return g.nodes["Nation"].groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'Customer:' || c_custkey AS src, 'Region:' || n_regionkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey")
def match_merge_edges(spark, d):
    g = star_graph(spark, d)
    m = g.match("c", "Customer").to("CUSTOMER_IN", "n", "Nation").to("IN_REGION", "r", "Region")
    return merge.match_merge(g, m, "c", "LIVES_IN", "r").edges["LIVES_IN"]


@query("""WITH gone AS (SELECT n_nationkey AS k FROM nation WHERE contains(n_name, '3')) SELECT 'CUSTOMER_IN' AS type, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'SUPPLIER_IN', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'IN_REGION', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'PLACED', count(*) FROM orders
UNION ALL SELECT 'CONTAINS_PART', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'SUPPLIES', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def detach_delete_filtered(spark, d):
    g = star_graph(spark, d)
    gone = merge.detach_delete(g, g.nodes["Nation"].where(F.contains("title", F.lit("3"))))
    return gone.all_edges().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Nation' AS label, n_name AS title, CAST(0 AS BIGINT) AS edges FROM nation")
def delete_all(spark, d):
    """All nodes and edges go; then the nations are written again, and nothing else is there."""
    g = merge.detach_delete(star_graph(spark, d))
    g = merge.merge_nodes(g, "Nation", table(spark, d, "nation").select(F.col("n_name").alias("title"), F.lit("").alias("context")))
    return g.all_nodes().select("label", "title").crossJoin(g.all_edges().agg(F.count(F.lit(1)).alias("edges")))


@query("""SELECT label, title, count(*) AS n FROM (SELECT DISTINCT 'Nation' AS label, n_name AS title FROM nation UNION ALL SELECT DISTINCT 'Region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY label, title""")
def statement_batch_nodes(spark, d):
    nodes, _ = merge.batch_rows(merge.statement_rows(_batches(spark, d)))
    return nodes.groupBy("label", "title").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS src, 'IN_REGION' AS type, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey")
def statement_batch_edges(spark, d):
    nodes, edges = merge.batch_rows(merge.statement_rows(_batches(spark, d)))
    named = nodes.select("id", "title")
    rows = edges.join(named.withColumnsRenamed({"id": "src", "title": "s"}), "src").join(named.withColumnsRenamed({"id": "dst", "title": "t"}), "dst")
    return rows.select(F.col("s").alias("src"), "type", F.col("t").alias("dst"))


@query("SELECT n_nationkey AS batch, 3 AS pos, 'DELETE everything' AS statement FROM nation")
def statement_rejects(spark, d):
    return merge.statement_rows(_batches(spark, d)).where("kind = 'rejected'").select("batch", "pos", "statement")


@query("SELECT n_nationkey AS batch, replace(replace('MERGE (~:Nation {title: #N#, context: #Nation#})|MERGE (@:Region {title: #R#, context: #Region#})|MERGE (~)-[:LIES_IN]->(@)', '~', lower(n_name)), '@', lower(r_name)).replace('#N#', chr(39) || n_name || chr(39)).replace('#R#', chr(39) || r_name || chr(39)).replace('#', chr(39)) AS statements FROM (SELECT n_nationkey, n_name, replace(r_name, ' ', '_') AS r_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)")
def extracted_statements(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("r", F.translate("r_name", " ", "_"))
    text = F.format_string("%s is a Nation. And %s is a Region. %s LIES_IN %s. It LIES_IN nowhere.", "n_name", "r", "n_name", "r")
    return extraction.extracted(rows.select(F.col("n_nationkey").alias("batch"), text.alias("text")), "batch")


_LONG = 6000


@query(f"SELECT n_nationkey AS batch, n_name AS title, length(n_name) * {_LONG} + 2 * {_LONG} AS n, md5(repeat('|' || chr(39) || n_name, {_LONG})) AS md5 FROM nation")
def statement_batch_long(spark, d):
    """Contexts of tens of thousands of characters, with guarded quotes and pipes inside."""
    context = F.repeat(F.concat(F.lit("|\\'"), "n_name"), _LONG)
    text = F.concat(F.lit("MERGE (a:Nation {title: '"), "n_name", F.lit("', context: '"), context, F.lit("'})|MERGE (a)-[:NEAR]->(a)"))
    rows = merge.statement_rows(table(spark, d, "nation").select(F.col("n_nationkey").alias("batch"), text.alias("text")))
    return rows.where("kind = 'node'").select("batch", "title", F.length("context").alias("n"), F.md5("context").alias("md5"))


@query("SELECT n_nationkey AS batch, 'a' AS var, CAST(2 AS BIGINT) AS n FROM nation WHERE n_nationkey % 2 = 0")
def reused_variables(spark, d):
    text = F.format_string("MERGE (a:Nation {title: '%s', context: ''})|MERGE (%s:Nation {title: 'other', context: ''})", F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b"))
    return merge.reused_variables(merge.statement_rows(table(spark, d, "nation").select(F.col("n_nationkey").alias("batch"), text.alias("text"))))


def _batches(spark, d):
    """For each nation a batch that names it, its region, and their relationship, and something that isn't allowed."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.format_string("MERGE (a:Nation {title: '%s', context: 'a|b'})|MERGE (b:Region {title: '%s', context: ''})|MERGE (a)-[:IN_REGION]->(b)|DELETE everything", "n_name", "r_name")
    return rows.select(F.col("n_nationkey").alias("batch"), text.alias("text"))


# schema


@query("""SELECT 'Nation' AS src_label, 'IN_REGION' AS type, 'Region' AS dst_label, count(*) AS n FROM nation UNION ALL SELECT 'Customer', 'CUSTOMER_IN', 'Nation', count(*) FROM customer
UNION ALL SELECT 'Supplier', 'SUPPLIER_IN', 'Nation', count(*) FROM supplier UNION ALL SELECT 'Customer', 'PLACED', 'Order', count(*) FROM orders
UNION ALL SELECT 'Order', 'CONTAINS_PART', 'Part', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'Supplier', 'SUPPLIES', 'Part', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""")
def schema_rel_triples(spark, d):
    return introspect.triples(star_graph(spark, d))


@query("""WITH gone AS (SELECT n_nationkey AS k FROM nation WHERE contains(n_name, '3') OR n_name = 'NATION_0'), kept AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT k FROM gone)),
t AS (SELECT n_name AS v FROM kept UNION SELECT 'A ' || n_name FROM nation)
SELECT 'labels' AS kind, label AS a, '' AS b, '' AS c, n FROM (SELECT 'Nation' AS label, (SELECT count(*) FROM t) AS n UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Customer', count(*) FROM customer)
UNION ALL SELECT 'triples', 'Nation', 'IN_REGION', 'Region', count(*) FROM kept UNION ALL SELECT 'triples', 'Customer', 'CUSTOMER_IN', 'Nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT k FROM gone)
UNION ALL SELECT 'triples', 'Region', 'HAS', 'Nation', count(*) FROM nation
UNION ALL SELECT 'least', label, property, v, 1 FROM (SELECT 'Nation' AS label, 'title' AS property, v FROM (SELECT v FROM t ORDER BY v LIMIT 5) UNION ALL SELECT 'Nation', 'context', '' UNION ALL SELECT 'Region', 'title', v FROM (SELECT r_name AS v FROM region ORDER BY v LIMIT 5) UNION ALL SELECT 'Region', 'context', ''
UNION ALL SELECT 'Customer', 'title', v FROM (SELECT c_name AS v FROM customer ORDER BY v LIMIT 5) UNION ALL SELECT 'Customer', 'context', v FROM (SELECT DISTINCT c_mktsegment AS v FROM customer ORDER BY v LIMIT 5))""")
def schema_maintained(spark, d):
    """The schema's figures after nodes and edges were added and nations deleted, by what the writes changed."""
    star = star_graph(spark, d)
    g = Graph({k: star.nodes[k] for k in ("Nation", "Region", "Customer")}, {k: star.edges[k] for k in ("IN_REGION", "CUSTOMER_IN")})
    now = introspect.Statistics.of(g)
    names = table(spark, d, "nation").select(F.concat(F.lit("A "), "n_name").alias("title"), F.lit("").alias("context"), F.concat(F.lit("Region:"), "n_regionkey").alias("src"))
    more = merge.new_nodes(g, "Nation", names)
    links = merge.new_edges(g, "HAS", names.select("src", node_id("Nation", F.col("title"), F.col("context")).alias("dst")))
    after = merge.merge_edges(merge.merge_nodes(g, "Nation", names), "HAS", links)
    now, g = now.changed(after, added=Graph({"Nation": more}, {"HAS": links})), after
    gone = g.nodes["Nation"].where("id like 'Nation:%' and (contains(title, '3') or title = 'NATION_0')")
    now = now.changed(merge.detach_delete(g, gone), removed=merge.removed(g, gone), before=g)
    none = F.lit("")
    parts = [now.labels.select(F.lit("labels").alias("kind"), F.col("label").alias("a"), none.alias("b"), none.alias("c"), "n"), now.triples.select(F.lit("triples"), "src_label", "type", "dst_label", "n"), now.least.select(F.lit("least"), "label", "property", "value", F.lit(1).cast("long"))]
    return reduce(DataFrame.union, parts)


@query("""WITH p AS (SELECT 'Region' AS label, 'title' AS property, r_name AS v FROM region UNION ALL SELECT 'Nation', 'title', n_name FROM nation UNION ALL SELECT 'Customer', 'title', c_name FROM customer UNION ALL SELECT 'Customer', 'context', c_mktsegment FROM customer
UNION ALL SELECT 'Supplier', 'title', s_name FROM supplier UNION ALL SELECT 'Part', 'title', p_name FROM part UNION ALL SELECT 'Part', 'context', p_type FROM part UNION ALL SELECT 'Order', 'title', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'Order', 'context', o_orderpriority FROM orders
UNION ALL SELECT 'Region', 'context', '' FROM region UNION ALL SELECT 'Nation', 'context', '' FROM nation UNION ALL SELECT 'Supplier', 'context', '' FROM supplier)
SELECT label, property, array_to_string(list_slice(list_sort(list(DISTINCT v)), 1, 5), ' / ') AS samples FROM p GROUP BY label, property""")
def schema_samples(spark, d):
    return introspect.samples(star_graph(spark, d)).withColumn("samples", F.array_join("samples", " / "))


@query("""SELECT (SELECT string_agg(t, ', ' ORDER BY t) FROM (SELECT 'Region (' || count(*) || ')' AS t FROM region UNION ALL SELECT 'Nation (' || count(*) || ')' FROM nation UNION ALL SELECT 'Customer (' || count(*) || ')' FROM customer
UNION ALL SELECT 'Supplier (' || count(*) || ')' FROM supplier UNION ALL SELECT 'Part (' || count(*) || ')' FROM part UNION ALL SELECT 'Order (' || count(*) || ')' FROM orders)) AS node_types,
'CONTAINS_PART, CUSTOMER_IN, IN_REGION, PLACED, SUPPLIER_IN, SUPPLIES' AS relationship_types""")
def schema_summary(spark, d):
    return introspect.summary(star_graph(spark, d))


def _nations(spark, d):
    """Nations and regions only, with nations of region 0 cut off."""
    g = star_graph(spark, d)
    return Graph({k: g.nodes[k] for k in ("Nation", "Region")}, {"IN_REGION": g.edges["IN_REGION"].where("dst <> 'Region:0'")})


@query("SELECT 'NODE TYPES: Nation (' || count(*) || '), Region (5)' || chr(10) || 'RELATIONSHIP TYPES: IN_REGION' || chr(10) || 'OBSERVATIONS: ' || (1 + count(*) FILTER (n_regionkey = 0)) || ' nodes have no relationship.' || chr(10) || 'EXTRACTION HINTS: relationships for nodes that have none.' AS text FROM nation")
def schema_summary_text(spark, d):
    return spark.createDataFrame([(introspect.summary_text(_nations(spark, d)),)], "text string")


@query("""SELECT 'Node properties:' || chr(10) || 'Nation.context: ' || chr(10) || 'Nation.title: ' || (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT 5)) || chr(10) || 'Region.context: ' || chr(10) || 'Region.title: '
|| (SELECT string_agg(r_name, ', ' ORDER BY r_name) FROM region) || chr(10) || 'Relationship properties:' || chr(10) || 'The relationships:' || chr(10) || '(:Nation)-[:IN_REGION]->(:Region)' AS text, false AS empty, true AS empty_without_graph""")
def schema_full_text(spark, d):
    text = introspect.SchemaCache().get("1", _nations(spark, d))
    return spark.createDataFrame([(text, introspect.is_empty_schema(text), introspect.is_empty_schema(introspect.schema_text(Graph())))], "text string, empty boolean, empty_without_graph boolean")


@query("SELECT 'Nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'IN_REGION', count(*) FILTER (n_regionkey <> 0) FROM nation")
def snapshot_round_trip(spark, d):
    path = work_path(spark, "snapshot")
    write_snapshot(_nations(spark, d), path)
    g = read_snapshot(spark, path)
    return g.all_nodes().select(F.col("label").alias("name")).union(g.all_edges().select("type")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT title, CAST(1 AS BIGINT) AS n, CAST(7 AS BIGINT) AS version FROM (SELECT n_name AS title FROM nation UNION ALL SELECT r_name FROM region)")
def publish_twice(spark, d):
    """A batch of nations for each region, each published twice, and a writer of regions who starts from the version before another's: every
    row is there once, in seven versions."""
    history = History(spark, work_path(spark, "history"))
    nations = table(spark, d, "nation")
    write = lambda k: lambda g: merge.merge_nodes(g, "Nation", nations.where(F.col("n_regionkey") == k).select(F.col("n_name").alias("title"), F.lit("").alias("context")))
    for k in range(5):
        for _ in range(2):
            history.commit(write(k), batch=("nations", k))
    raced = []

    def regions(g):
        if not raced:  # another writer is faster, once
            raced.append(history.commit(lambda g: merge.merge_edges(g, "NEAR", g.nodes["Nation"].select(F.col("id").alias("src"), F.col("id").alias("dst")))))
        return merge.merge_nodes(g, "Region", table(spark, d, "region").select(F.col("r_name").alias("title"), F.lit("").alias("context")))

    version = history.commit(regions)
    return history.read().all_nodes().groupBy("title").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(version).cast("long"))


# the seed graph


_SEEDED: dict[str, Graph] = {}


def _seeded(spark):
    """The seed graph, all of its blocks run twice; once in a session, as its tables are written."""
    name = spark.sparkContext.applicationId
    if name not in _SEEDED:
        g = Graph()
        for _ in range(2):
            g, report = extraction.load_blocks(g, seed.blocks(spark))
            if any(not line.startswith("OK") for line in report):
                raise ValueError(report)
        _SEEDED.clear()
        _SEEDED[name] = g
    return _SEEDED[name]


@query("SELECT * FROM (VALUES ('Department', 5), ('Professor', 8), ('Course', 10), ('Program', 5), ('Building', 3), ('Room', 4), ('Research', 4), ('BELONGS_TO', 8), ('TEACHES', 10), ('PART_OF', 10), ('OFFERED_BY', 5), ('LOCATED_IN', 4), ('SUPERVISES', 4), ('PREREQUISITE_FOR', 4)) AS t(name, n)")
def seed_graph_loaded_twice(spark, d):
    """39 nodes and 45 edges, however often the blocks run."""
    g = _seeded(spark)
    both = g.all_nodes().select(F.col("label").alias("name")).union(g.all_edges().select("type"))
    return both.groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT 'Prof. Katarzyna Nowak' AS professor, 'Mathematical Analysis' AS course, 'Applied Mathematics BSc' AS program, 'Faculty of Mathematics' AS department")
def seed_graph_question(spark, d):
    m = _seeded(spark).match("c", "Course").where_contains("c", "title", "mathematical analysis").to("PART_OF", "g", "Program").to("OFFERED_BY", "d", "Department")
    m = m.start("c").back("TEACHES", "p", "Professor")
    return m.returns(("p", "title", "professor"), ("c", "title", "course"), ("g", "title", "program"), ("d", "title", "department"))


@query("SELECT 'Algorithms and Data Structures' AS first, 'Introduction to Artificial Intelligence' AS second, 'Machine Learning' AS third")
def seed_graph_chain(spark, d):
    m = _seeded(spark).match("a", "Course").to("PREREQUISITE_FOR", "b", "Course").to("PREREQUISITE_FOR", "c", "Course")
    return m.returns(("a", "title", "first"), ("b", "title", "second"), ("c", "title", "third"))


@query("SELECT * FROM (VALUES (1, 'OK block 1/3'), (2, 'ERROR block 2/3'), (3, 'OK block 3/3')) AS t(k, status)")
def block_statuses(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_name").alias("title"), F.lit("").alias("context"))
    broken = nations.withColumn("title", F.raise_error(F.lit("no such title")).cast("string"))
    writes = [lambda g: merge.merge_nodes(g, "Nation", nations), lambda g: merge.merge_nodes(g, "Broken", broken), lambda g: merge.merge_nodes(g, "Nation", nations)]
    _, report = extraction.load_blocks(Graph(), writes)
    return spark.createDataFrame([(i, line.split(":")[0]) for i, line in enumerate(report, 1)], "k int, status string")


# ingest


@query("SELECT string_agg(n_name || ' ą', chr(10) ORDER BY n_nationkey) || chr(10) AS text, CAST(0 AS BIGINT) AS left_out FROM nation")
def text_directory(spark, d):
    path = work_path(spark, "texts")
    table(spark, d, "nation").orderBy("n_nationkey").select(F.concat("n_name", F.lit(" ą"))).coalesce(1).write.text(path)
    good, bad = read_directory(spark, path)
    return good.select("text").crossJoin(bad.agg(F.count(F.lit(1)).alias("left_out")))


@query("SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation")
def text_file(spark, d):
    path = work_path(spark, "text")
    table(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return read_text(spark, path).select("text")


@query("SELECT n_name AS title, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def ingest_with_feedback(spark, d):
    """Pages of a stream, a batch for each region; every batch merges into what the one before has published."""
    pages, history = work_path(spark, "pages"), History(spark, work_path(spark, "versions"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.format_string("%s is a Nation. %s is a Region. %s LIES_IN %s.", F.col("n_name"), F.translate("r_name", " ", "_"), F.col("n_name"), F.translate("r_name", " ", "_"))
    rows.select("n_regionkey", F.col("n_nationkey").alias("doc_id"), text.alias("text")).repartition("n_regionkey").write.partitionBy("n_regionkey").parquet(pages)

    def publish(statements, number):
        rows = merge.statement_rows(statements.select(F.col("doc_id").alias("batch"), F.col("statements").alias("text")))
        return introspect.summary_text(history.read(history.commit(lambda g: merge.merge_batches(g, rows), batch=("pages", number))))

    stream = spark.readStream.schema("doc_id int, text string").option("maxFilesPerTrigger", 1).parquet(f"{pages}/*")
    live.ingest(stream, lambda batch, summary: extraction.extracted(batch), publish, work_path(spark, "ingest")).awaitTermination()
    g = history.read()
    m = g.match("n", "Nation").to("LIES_IN", "r", "Region")
    return m.df.select(F.col("n__title").alias("title"), F.translate("r__title", "_", " ").alias("region"))


@query("SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def live_counts(spark, d):
    out = work_path(spark, "live")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    q = live.counts_by_window(stream).writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", work_path(spark, "live-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("started", F.col("started").cast("timestamp_ntz"))


def _session_events(spark, d):
    kind = F.when(F.col("event_type") == "signup", "create").when((F.col("event_type") == "error") & (F.col("event_id") % 41 == 0), "deactivate").when(F.col("event_type") != "error", "append").otherwise(F.lit("other"))
    own = F.col("user_id").cast("string")
    return table(spark, d, "events").select(own.alias("session_id"), kind.alias("kind"), F.concat(F.lit("u"), own).alias("user_id"), F.lit("user").alias("role"), F.col("ts").cast("timestamp").alias("at"))


_LIVE = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts, CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' AND event_id % 41 = 0 THEN 'deactivate' WHEN event_type <> 'error' THEN 'append' ELSE 'other' END AS kind FROM events),
c AS (SELECT session_id, min(ts) AS created_at FROM e WHERE kind = 'create' GROUP BY session_id),
o AS (SELECT e.*, created_at, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) AS gap FROM e JOIN c USING (session_id) WHERE kind = 'create' AND ts = created_at OR kind IN ('append', 'deactivate') AND ts >= created_at)
SELECT session_id, 'u' || session_id AS user_id, created_at, max(ts) AS updated_at, count(*) FILTER (kind = 'append') AS message_count, bool_and(kind <> 'deactivate') AND {idle} AS is_active FROM o GROUP BY session_id, created_at"""


def _live(spark, d, idle):
    """The events of three spans of time, in a stream that is stopped after the first and started again."""
    rows, into = _session_events(spark, d), work_path(spark, "session-events")
    out, checkpoint = work_path(spark, "live-sessions"), work_path(spark, "live-sessions-state")
    for n, (since, until) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2025-01-01"))):
        rows.where((F.col("at") >= since) & (F.col("at") < until)).write.mode("append").parquet(into)
        if n != 1:
            stream = spark.readStream.schema(live_sessions.EVENTS).parquet(into)
            live_sessions.keep(live_sessions.live_sessions(stream, idle), out, checkpoint).awaitTermination()
    found = live_sessions.kept(spark, out)
    return found.select("session_id", "user_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "message_count", "is_active")


@query(_LIVE.format(idle="true"))
def live_sessions_events(spark, d):
    return _live(spark, d, None)


@query(_LIVE.format(idle="coalesce(max(gap), INTERVAL 0 DAY) <= INTERVAL 3 DAY AND max(ts) + INTERVAL 3 DAY >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"))
def live_sessions_expired(spark, d):
    """As live_sessions_events; three days without an event end a session."""
    return _live(spark, d, "3 days")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS at FROM events")
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", T.iso_time("ts").alias("at"))


@query("SELECT doc_id, trim('||' || coalesce(text, '') || '|a|b|||', '|') AS text FROM documents")
def strip_pipes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_pipes(F.concat(F.lit("||"), F.coalesce("text", F.lit("")), F.lit("|a|b|||"))).alias("text"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR text IS NULL OR text = '' THEN '{T.NO_SCHEMA}' ELSE text END AS text FROM documents")
def or_default(spark, d):
    return table(spark, d, "documents").select("doc_id", T.or_default(F.when(F.col("doc_id") % 3 != 0, F.col("text")), T.NO_SCHEMA).alias("text"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) = 0 THEN 'empty' WHEN starts_with(text, 'ERROR:') THEN 'error' WHEN length(trim(text, ' ' || chr(10) || chr(9))) = 0 THEN 'blank' END AS reason FROM documents")
def doc_guards(spark, d):
    return table(spark, d, "documents").select("doc_id", ingest.guard_reason().alias("reason"))


_CHUNKS = """SELECT doc_id, CAST(p AS INT) AS part, CAST(n AS INT) AS parts, CASE WHEN n = 1 THEN text ELSE substring(text, (p - 1) * 800 + 1, 1000) END AS text
FROM (SELECT doc_id, text, n, unnest(range(1, n + 1)) AS p FROM (SELECT doc_id, text, CASE WHEN length(text) > 1000 THEN CAST(ceil((length(text) - 200) / 800.0) AS BIGINT) ELSE 1 END AS n FROM documents))"""


@query(_CHUNKS)
def doc_chunk_fixed(spark, d):
    return ingest.chunk_fixed(table(spark, d, "documents"), size=1000, overlap=200)


@query(f"SELECT doc_id, part, parts, CASE WHEN parts > 1 THEN '[Part ' || part || ' of ' || parts || ' from documents] ' || text ELSE text END AS text FROM ({_CHUNKS.replace('1000', '30000').replace('800.0', '29800.0').replace('* 800', '* 29800')})")
def doc_chunk_labels(spark, d):
    return ingest.labelled(ingest.chunk_fixed(table(spark, d, "documents")), "documents")


def _cut(pos: str) -> str:
    """SQL of where a part of at most 1000 characters that starts after pos ends: past the last separator beyond the overlap, if any."""
    last = ", ".join(f"CASE WHEN strpos(reverse(substring(text, {pos} + 102, 899)), {x}) > 0 THEN 1001 - strpos(reverse(substring(text, {pos} + 102, 899)), {x}) END" for x in ("chr(10) || chr(10)", "chr(10)", "' '"))
    return f"CASE WHEN length(text) - {pos} > 1000 THEN {pos} + coalesce({last}, 1000) END"


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, text, 1 AS part, 0 AS pos, {_cut("0")} AS cut FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
UNION ALL SELECT doc_id, text, part + 1, cut - 100, {_cut("(cut - 100)")} FROM c WHERE cut IS NOT NULL)
SELECT doc_id, CAST(part AS INT) AS part, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS parts, substring(text, pos + 1, coalesce(cut, length(text)) - pos) AS text FROM c""")
def doc_chunk_separators(spark, d):
    return ingest.chunk_by_separators(table(spark, d, "documents"), size=1000, overlap=100)


@query(None)
def doc_chunk_recursive(spark, d):
    """Recursive splitting and merging; the tests compare it with a plain recursive version on all documents."""
    return ingest.chunk_recursively(table(spark, d, "documents"), size=1000, overlap=100)


@query("SELECT doc_id, length(text) > 60000 AS oversize FROM documents")
def doc_oversize(spark, d):
    return table(spark, d, "documents").select("doc_id", ingest.oversize().alias("oversize"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def joined_pages(spark, d):
    return ingest.joined_pages(table(spark, d, "conversations"), "conv_id", "turn")


@query("SELECT doc_id, regexp_replace(translate(text, 'ąćęłńóśźżĄĆĘŁŃÓŚŹŻ', 'acelnoszzACELNOSZZ'), '[^\\x00-\\x7F]', '', 'g') AS text FROM documents")
def ascii_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ascii_fold("text").alias("text"))


_PIPES = "list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len({_PIPES}) AS INT) AS n, coalesce({_PIPES}[1], '') AS first FROM documents")
def pipe_split(spark, d):
    parts = T.pipe_split("text")
    return table(spark, d, "documents").select("doc_id", F.size(parts).alias("n"), F.coalesce(F.get(parts, 0), F.lit("")).alias("first"))


@query(f"SELECT doc_id, array_to_string({_PIPES}, '|') AS text FROM documents")
def pipe_join(spark, d):
    return table(spark, d, "documents").select("doc_id", T.pipe_join(T.pipe_split("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END AS preview FROM documents")
def preview_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview("text").alias("preview"))


@query("SELECT conv_id, turn, 'Q: ' || text || ' {x}' AS prompt FROM conversations WHERE role = 'user'")
def prompt_fill(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.fill_prompt("Q: {q} {{x}}", q="text").alias("prompt"))


@query("SELECT conv_id, turn, 'Q: {data} [{\"a\":{\"b\":1}}] {' || text || '} {x} {other}' AS prompt FROM conversations WHERE role = 'user'")
def prompt_fill_braces(spark, d):
    """Braces and names inside values stay as they are."""
    question = F.concat(F.lit("{data} "), F.lit('[{"a":{"b":1}}] {'), "text", F.lit("}"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.fill_prompt("Q: {q} {{x}} {other}", q=question, data=F.lit("no")).alias("prompt"))


_RUN = 20_000


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, length(trim(t || repeat(' ', {_RUN}) || 'x ' || chr(8195) || chr(10), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(8195))) AS trimmed,
       length(trim(t || repeat('|', {_RUN}) || 'x||', '|')) AS stripped, length(t) + {_RUN} + CASE WHEN contains(upper(t), 'LIMIT') THEN 3 ELSE 9 END AS limited FROM d""")
def trims_of_long_runs(spark, d):
    """Runs of blanks, pipes or semicolons inside a text are left alone, in time linear in the text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    inner = lambda sign, end: F.concat("t", F.repeat(F.lit(sign), F.lit(_RUN)), F.lit(end))
    limited = T.with_limit_by_substring(inner(";", "x;;"))
    return docs.select("doc_id", *(F.length(x).cast("long").alias(name) for name, x in (("trimmed", T.trim_all(inner(" ", "x \u2003\n"))), ("stripped", T.strip_pipes(inner("|", "x||"))), ("limited", limited))))


# questions


_GUARD = retrieval.keyword_guard("the", "der", "que")
_ASKED = "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'que') THEN 'generate_cypher' ELSE 'end' END AS guardrail_decision FROM conversations WHERE role = 'user'"


def _asked(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


@query(_ASKED)
def guardrail_route(spark, d):
    return retrieval.routed(_asked(spark, d), _GUARD).select("conv_id", "turn", "guardrail_decision")


@query(f"SELECT conv_id, turn, '{retrieval.REFUSAL}' AS answer, '[]' AS context, CAST(NULL AS VARCHAR) AS query FROM ({_ASKED}) WHERE guardrail_decision = 'end'")
def refusal_branch(spark, d):
    return retrieval.refusals(retrieval.routed(_asked(spark, d), _GUARD)).select("conv_id", "turn", "answer", "context", "query")


@query("SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"none\":null}' AS json FROM customer")
def context_json(spark, d):
    return as_json(table(spark, d, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("none")))


def _plan(spark, d):
    m = star_graph(spark, d).match("n", "Nation").back("CUSTOMER_IN", "c", "Customer")
    rows = m.returns(("n", "title", "nation"), ("c", "title", "customer"), ("c", "context", "segment"))
    return retrieval.Plan(r"(?i)customers in (\w+)", rows, "nation", ["customer", "segment"], [F.col("customer")], "customers of nation {key}")


def _questions(spark, d):
    nations = table(spark, d, "nation")
    real = nations.select(F.col("n_nationkey").cast("long").alias("qid"), F.concat(F.lit("Which customers in "), "n_name", F.lit(" are there?")).alias("question"))
    other = nations.select((F.col("n_nationkey") + 100).cast("long").alias("qid"), F.lit("Tell me a joke").alias("question"))
    vague = nations.select((F.col("n_nationkey") + 200).cast("long").alias("qid"), F.lit("How many customers?").alias("question"))
    return real.union(other).union(vague)


_ENVELOPE = f"""WITH f AS (SELECT n_nationkey, '[' || string_agg('{{"customer":"' || c_name || '","segment":"' || c_mktsegment || '"}}', ',' ORDER BY c_name) || ']' AS context
FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k <= 5 GROUP BY n_nationkey)
SELECT CAST(n.n_nationkey AS BIGINT) AS qid, 'generate_cypher' AS decision, coalesce(context, '[]') AS context, 'customers of nation ' || lower(n_name) AS query, '{retrieval.NO_MODEL}' || coalesce(context, '[]') AS answer FROM nation n LEFT JOIN f USING (n_nationkey)
UNION ALL SELECT n_nationkey + 100, 'end', '[]', NULL, '{retrieval.REFUSAL}' FROM nation
UNION ALL SELECT n_nationkey + 200, 'generate_cypher', '[]', 'Query failed: no pattern fits the question', '{retrieval.NO_MODEL}[]' FROM nation"""


@query(_ENVELOPE)
def rag_envelope(spark, d):
    rows = retrieval.answer_questions(_questions(spark, d), retrieval.keyword_guard("customer"), _plan(spark, d))
    return rows.select("qid", F.col("metadata.guardrail_decision").alias("decision"), F.col("metadata.context").alias("context"), F.col("metadata.query").alias("query"), "answer")


@query("SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(r_name), lower('asia')) ORDER BY c_name LIMIT 10")
def rag_end_to_end(spark, d):
    m = star_graph(spark, d).match("r", "Region").where_contains("r", "title", "asia").back("IN_REGION", "n", "Nation").back("CUSTOMER_IN", "c", "Customer")
    return limited(m.returns(("c", "title", "customer"), ("n", "title", "nation"), ("r", "title", "region")), 10, [F.col("customer")])


@query("""SELECT CAST(n_nationkey AS BIGINT) AS qid, 'customers of nation ' || lower(n_name) AS query, CAST(NULL AS VARCHAR) AS error FROM nation UNION ALL SELECT n_nationkey + 100, 'suppliers of nation ' || lower(n_name), NULL FROM nation
UNION ALL SELECT n_nationkey + 200, 'Query failed: no pattern fits the question', 'Query failed: no pattern fits the question' FROM nation UNION ALL SELECT n_nationkey + 300, 'Query failed: no pattern fits the question', 'Query failed: no pattern fits the question' FROM nation""")
def plans_first_fit(spark, d):
    """The first plan that fits a question and whose labels and types the schema has."""
    first = _plan(spark, d)
    m = star_graph(spark, d).match("n", "Nation").back("SUPPLIER_IN", "s", "Supplier")
    second = retrieval.Plan(r"(?i)suppliers in (\w+)", m.returns(("n", "title", "nation"), ("s", "title", "supplier")), "nation", ["supplier"], [F.col("supplier")], "suppliers of nation {key}", needs=("Supplier", "SUPPLIER_IN"))
    third = replace(second, pattern=r"(?i)dealers in (\w+)", needs=("Dealer",))
    nations = table(spark, d, "nation")
    asked = [nations.select((F.col("n_nationkey") + 100 * i).cast("long").alias("qid"), F.concat(F.lit(start), "n_name").alias("question")) for i, start in enumerate(("customers in ", "suppliers in ", "who knows ", "dealers in "))]
    rows = retrieval.Plans((first, second, third), frozenset({"Nation", "Supplier", "SUPPLIER_IN"})).retrieve(reduce(DataFrame.union, asked), "qid", "question")
    return rows.select("qid", "query", "error")


_FIRST_CUSTOMERS = """SELECT n_nationkey, '[' || string_agg('{"title":"' || c_name || '","context":"' || c_mktsegment || '"}', ',' ORDER BY c_name) || ']' AS context
FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k <= 5 GROUP BY n_nationkey"""
_FIRST_NATIONS = """SELECT n_regionkey, '[' || string_agg('{"title":"' || n_name || '","context":""}', ',' ORDER BY n_name) || ']' AS context
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation) WHERE k <= 5 GROUP BY n_regionkey"""
_TO_CUSTOMERS = "'MATCH (a:Nation {title: ''' || n_name || '''})<-[:CUSTOMER_IN]-(b:Customer) RETURN DISTINCT b.title, b.context LIMIT 5'"
_TO_REGION = "'MATCH (a:Supplier {title: ''' || s_name || '''})-[:SUPPLIER_IN]->(b:Nation)-[:IN_REGION]->(c:Region) RETURN DISTINCT c.title, c.context LIMIT 5'"
_AROUND_REGION = "'MATCH (a:Region {title: ''' || r_name || '''})--(b) RETURN DISTINCT b.title, b.context LIMIT 5'"


@query(f"""WITH c AS ({_FIRST_CUSTOMERS}), r AS ({_FIRST_NATIONS})
SELECT kind || n_nationkey AS qid, coalesce(context, '[]') AS context, {_TO_CUSTOMERS} AS query, CAST(NULL AS VARCHAR) AS error FROM (VALUES ('nation '), ('misspelt ')) AS k(kind), nation LEFT JOIN c USING (n_nationkey)
UNION ALL SELECT 'joke ' || n_nationkey, '[]', '{retrieval.NO_PLAN}', '{retrieval.NO_PLAN}' FROM nation
UNION ALL SELECT 'supplier ' || s_suppkey, '[{{"title":"' || r_name || '","context":""}}]', {_TO_REGION}, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'region ' || r_regionkey, context, {_AROUND_REGION}, NULL FROM region JOIN r ON n_regionkey = r_regionkey""")
def planned_by_schema(spark, d):
    """Questions that no pattern foresees: entities, some misspelt, are linked to nodes, and the schema gives the way to what is asked for."""
    nations, suppliers, regions = (table(spark, d, t) for t in ("nation", "supplier", "region"))

    def asked(df, kind, key, *parts):
        return df.select(F.concat(F.lit(kind + " "), key).alias("qid"), F.concat(*parts).alias("question"))

    questions = [
        asked(nations, "nation", "n_nationkey", F.lit("Which customers are in "), "n_name", F.lit("?")),
        asked(nations, "misspelt", "n_nationkey", F.lit("Show every customer of '"), F.replace("n_name", F.lit("NATION"), F.lit("NATIN")), F.lit("'!")),
        asked(nations, "joke", "n_nationkey", F.lit("Tell me a joke")),
        asked(suppliers, "supplier", "s_suppkey", F.lit("What region is the supplier "), F.lower("s_name"), F.lit(" from?")),
        asked(regions, "region", "r_regionkey", F.lit("Tell me about "), "r_name"),
    ]
    rows = SchemaPlan.of(star_graph(spark, d)).retrieve(reduce(DataFrame.union, questions), "qid", "question")
    return rows.select("qid", "context", "query", "error")


@query(f"SELECT CAST(n_nationkey AS BIGINT) AS qid, '[]' AS context, true AS failed, '{retrieval.NO_MODEL}[]' AS answer FROM nation")
def failed_retrieval(spark, d):
    """An error while the query runs gives an empty context and its text, not a lost question."""
    plan = _plan(spark, d)
    broken = retrieval.Guarded(replace(plan, rows=plan.rows.withColumn("customer", F.raise_error(F.lit("disk on fire")).cast("string"))))
    asked = _questions(spark, d).where("qid < 100")
    rows = retrieval.answer_questions(asked, retrieval.keyword_guard("customer"), broken)
    return rows.select("qid", "context", F.startswith("query", F.lit("Query failed: ")).alias("failed"), "answer")


@query("SELECT conv_id, turn, '<' || lower(text) || '>' AS answer FROM conversations WHERE role = 'user'")
def model_choice(spark, d):
    """The first configured model of an order of preference answers."""
    model = extraction.choose({"small": F.lower, "other": F.upper}, ("large", "small", "other"))
    return _asked(spark, d).select("conv_id", "turn", retrieval.model_answer("<{user_input}>", model)(F.col("question"), F.lit(""), F.lit(None)).alias("answer"))


@query("SELECT text AS prompt, 2 * count(*) AS n, CAST(1 AS BIGINT) AS replies FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY text")
def replies_once(spark, d):
    """A model that answers anew each time is asked once for each distinct prompt, in two passes over all questions."""
    model = Model("random", lambda prompt: F.concat(F.uuid(), prompt), Replies(spark, work_path(spark, "replies")))
    asked = _asked(spark, d).where("question is not null")
    both = [model.replies.ask(asked, F.col("question"), model.name, model.call) for _ in range(2)]
    return both[0].union(both[1]).groupBy(F.col("question").alias("prompt")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("reply").alias("replies"))


@query("SELECT conv_id, turn, CAST(1 AS BIGINT) AS n, true AS whole FROM conversations WHERE role = 'user'")
def answers_once(spark, d):
    """Guard and answers are random; each question is refused or answered, and never both."""
    replies = Replies(spark, work_path(spark, "replies"))
    guard = Model("coin", lambda p: F.when(F.rand() < 0.5, "generate").otherwise(F.lit("end")), replies)
    final = retrieval.model_answer("{user_input} {data}", Model("random", lambda p: F.concat(F.uuid(), p), replies))
    rows = retrieval.answer_questions(_asked(spark, d), guard, replace(_plan(spark, d), pattern=r"(\w+)"), final=final)
    whole = F.when(F.col("guardrail_decision") == "end", F.col("answer") == retrieval.REFUSAL).otherwise(F.endswith("answer", F.col("context")))
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.bool_and(whole).alias("whole"))


@query("SELECT 'graph TD' || chr(10) || '    START --> guard' || chr(10) || '    guard -->|generate_cypher| plan' || chr(10) || '    guard -->|end| refuse' || chr(10) || '    plan --> retrieve' || chr(10) || '    refuse --> END' || chr(10) || '    retrieve --> END' AS diagram")
def state_diagram(spark, d):
    return spark.createDataFrame([(retrieval.mermaid(retrieval.STATES),)], "diagram string")


# sessions: conversations are the messages; users, times and activity are derived from their numbers


def _store(spark, d):
    talks = table(spark, d, "conversations")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    messages = talks.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text", at.alias("ts"))
    own = talks.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = own.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") % 10).cast("string").alias("user_id"), at.alias("created_at"), (at + F.make_interval(mins=F.col("last").cast("int"))).alias("updated_at"), (F.col("conv_id") % 3 != 0).alias("is_active"), F.col("conv_id").alias("seq"))
    return sessions.Store(rows, messages, rows.select("user_id").distinct())


_SESSIONS = "SELECT conv_id, CAST(conv_id AS VARCHAR) AS session_id, CAST(conv_id % 10 AS VARCHAR) AS user_id, conv_id % 3 <> 0 AS is_active, max(turn) AS last, count(*) AS message_count FROM conversations GROUP BY conv_id"


@query(f"SELECT session_id, user_id, message_count, is_active FROM ({_SESSIONS})")
def session_info(spark, d):
    return _store(spark, d).info().select("session_id", "user_id", "message_count", "is_active")


@query(f"SELECT count(*) AS total_sessions, count(*) FILTER (is_active) AS active_sessions, count(*) FILTER (NOT is_active) AS inactive_sessions, CAST(sum(message_count) AS BIGINT) AS total_messages, count(DISTINCT user_id) AS unique_users, sum(message_count) / count(*) AS avg_messages_per_session FROM ({_SESSIONS})")
def session_stats(spark, d):
    return _store(spark, d).stats()


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def history_last_n(spark, d):
    return sessions.history(_store(spark, d).messages, 3).select("session_id", "turn", "role", "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k > 2")
def history_skip_first(spark, d):
    return sessions.history(_store(spark, d).messages, -2).select("session_id", "turn")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, least(count(*), 3) AS returned, count(*) AS total_messages FROM conversations GROUP BY conv_id")
def history_response_counts(spark, d):
    return sessions.history_counts(_store(spark, d).messages, 3)


_LINES = "SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg({role} || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= {n} GROUP BY conv_id"


@query(_LINES.format(role="role", name="context", n=10))
def context_window_10(spark, d):
    return sessions.context_window(_store(spark, d).messages)


@query(_LINES.format(role="upper(role)", name="history", n=6))
def chat_history_6(spark, d):
    return sessions.chat_history(_store(spark, d).messages)


@query(f"SELECT user_id, session_id FROM ({_SESSIONS}) WHERE is_active")
def user_sessions(spark, d):
    return _store(spark, d).of_user().select("user_id", "session_id")


@query(f"SELECT user_id, count(*) FILTER (is_active) AS session_count FROM ({_SESSIONS}) GROUP BY user_id")
def user_session_counts(spark, d):
    return _store(spark, d).session_counts()


@query(f"SELECT user_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, conv_id) AS k FROM ({_SESSIONS}) WHERE is_active) WHERE k = 1")
def active_session_latest(spark, d):
    return _store(spark, d).latest_active().select("user_id", "session_id")


@query(f"SELECT session_id, message_count FROM ({_SESSIONS}) WHERE conv_id % 4 <> 0")
def sessions_after_delete(spark, d):
    s = _store(spark, d)
    return s.delete(s.sessions.where("seq % 4 = 0")).info().select("session_id", "message_count")


@query(f"SELECT user_id, count(*) FILTER (CAST(user_id AS INT) >= 4 AND conv_id % 2 = 0) AS session_count FROM ({_SESSIONS}) GROUP BY user_id")
def unique_users_tombstone(spark, d):
    """Users stay known when their sessions are deleted."""
    s = _store(spark, d)
    return s.delete(s.sessions.where("user_id < '4' or seq % 2 = 1")).session_counts(active_only=False)


@query(f"SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'made' ELSE 'own ' || n_nationkey END AS session_id, 'u' || n_nationkey AS user_id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 32 ELSE length('own ' || n_nationkey) END AS INT) AS n, true AS later FROM nation")
def sessions_created(spark, d):
    """Ids are made up where there are none; sessions created later come later in order."""
    s = _store(spark, d)
    last = s.sessions.agg(F.max("seq").alias("last"))
    new = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 != 0, F.concat(F.lit("own "), "n_nationkey")).alias("session_id"), F.concat(F.lit("u"), "n_nationkey").alias("user_id"), F.expr("timestamp_ntz'2024-03-01 00:00:00'").alias("at"))
    made = written(s.create(new).sessions.where(F.startswith("user_id", F.lit("u"))), "created").crossJoin(last)
    own = F.when(F.startswith("session_id", F.lit("own")), F.col("session_id")).otherwise(F.lit("made"))
    return made.select(own.alias("session_id"), "user_id", F.length("session_id").alias("n"), (F.col("seq") > F.col("last")).alias("later"))


@query(f"SELECT session_id, user_id, is_active FROM ({_SESSIONS}) WHERE session_id = '7'")
def session_get(spark, d):
    return _store(spark, d).get("7").select("session_id", "user_id", "is_active")


@query(f"SELECT count(*) AS cleared, CAST(0 AS BIGINT) AS total_sessions, CAST(0 AS BIGINT) AS total_messages, CAST(0 AS BIGINT) AS unique_users FROM ({_SESSIONS})")
def sessions_cleared(spark, d):
    empty, n = _store(spark, d).clear()
    return empty.stats().select(F.lit(n).cast("long").alias("cleared"), "total_sessions", "total_messages", "unique_users")


@query(f"SELECT session_id, CASE WHEN conv_id % 7 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(last AS INT)) END AS updated_at FROM ({_SESSIONS})")
def sessions_updated(spark, d):
    """A message makes its session the one updated last; the store is written and read again."""
    s = _store(spark, d)
    new = s.sessions.where("seq % 7 = 0").select("session_id", F.lit("user").alias("role"), F.lit("hi").alias("text"), F.expr("timestamp_ntz'2024-05-01 00:00:00'").alias("at"))
    path = work_path(spark, "store")
    write_store(s.append(new)[0], path)
    return read_store(spark, path).sessions.select("session_id", "updated_at")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'empty message' WHEN turn % 4 = 2 THEN 'unknown session' END AS error FROM conversations")
def invalid_requests(spark, d):
    requests = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 2, "nobody").when(F.col("turn") % 4 != 3, F.col("conv_id").cast("string")).alias("session_id"), F.when(F.col("turn") % 4 == 1, "").otherwise(F.lit("hello")).alias("message"))
    return sessions.invalid_requests(requests, _store(spark, d).sessions).select("conv_id", "turn", "error")


@query(f"""SELECT session_id, '{retrieval.REFUSAL}' AS message, 'knowledge_graph' AS source, message_count + 2 AS message_count FROM ({_SESSIONS}) WHERE conv_id % 3 = 0
UNION ALL SELECT session_id, '{retrieval.NO_MODEL}[{{"customer":"' || (SELECT min(c_name) FROM customer WHERE c_nationkey = 3) || '"}}]', 'knowledge_graph', message_count + 2 FROM ({_SESSIONS}) WHERE conv_id % 3 = 1
UNION ALL SELECT 'new', '{retrieval.APOLOGY}Query failed: no pattern fits the question', 'error', 2 FROM ({_SESSIONS}) WHERE conv_id % 3 = 2 UNION ALL SELECT 'nobody', NULL, 'error', NULL FROM ({_SESSIONS}) WHERE conv_id = 0""")
def chat_turn(spark, d):
    """Refused, answered and failing questions, one of an unknown session, and those that open a session."""
    s = _store(spark, d)
    k, at = F.col("seq") % 3, F.expr("timestamp_ntz'2024-04-01 00:00:00'")
    message = F.when(k == 0, "Tell me a joke").when(k == 1, "Which customers in NATION_3 are there?").otherwise(F.lit("How many customers?"))
    requests = s.sessions.select(F.when(k != 2, F.col("session_id")).alias("session_id"), "user_id", message.alias("message"), at.alias("at"))
    lost = s.sessions.where("seq = 0").select(F.lit("nobody").alias("session_id"), "user_id", F.lit("hello").alias("message"), at.alias("at"))
    after, answers = chat(s, requests.union(lost), retrieval.keyword_guard("customer"), replace(_plan(spark, d), columns=["customer"], limit=1))
    known = s.sessions.select(F.col("session_id").alias("known"))
    rows = answers.join(after.info().select("session_id", "message_count"), "session_id", "left").join(known, F.col("session_id") == F.col("known"), "left")
    name = F.when(F.col("known").isNotNull() | (F.col("session_id") == "nobody"), F.col("session_id")).otherwise(F.lit("new"))
    return rows.select(name.alias("session_id"), "message", "source", "message_count")


@query(f"SELECT session_id, is_active AND conv_id % 5 <> 0 AS is_active FROM ({_SESSIONS})")
def sessions_deactivated(spark, d):
    s = _store(spark, d)
    gone = s.sessions.where("seq % 5 = 0").select("session_id", F.expr("timestamp_ntz'2024-02-01 00:00:00'").alias("at"))
    return s.deactivate(gone).sessions.select("session_id", "is_active")


@query(f"SELECT session_id, message_count + 1 AS message_count FROM ({_SESSIONS})")
def messages_appended(spark, d):
    s = _store(spark, d)
    new = s.sessions.select("session_id", F.lit("user").alias("role"), F.lit("hello").alias("text"), F.expr("timestamp_ntz'2024-02-01 00:00:00'").alias("at"))
    return s.append(new)[0].info().select("session_id", "message_count")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def activity_by_user(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("user_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT conv_id, session_id, user_id, conv_id % 3 <> 0 AS is_active, message_count FROM ({_SESSIONS}) WHERE conv_id % 4 <> 1),
l AS (SELECT conv_id, arg_max(text, turn) AS last_text, count(*) AS turns FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY conv_id)
SELECT phase, session_id, user_id, is_active, turns AS message_count, last_text, turns - 1 AS last_turn FROM s JOIN l USING (conv_id), (VALUES ('before'), ('after')) AS p(phase)""")
def session_log_compacted(spark, d):
    """Sessions created, messages appended in two commits, sessions deactivated and deleted; read before and after compaction."""
    log, talks = SessionLog(spark, work_path(spark, "session-log"), buckets=8), table(spark, d, "conversations")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    talks = talks.select("conv_id", F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") % 10).cast("string").alias("user_id"), "role", "text", "turn", (at + F.make_interval(mins=F.col("turn").cast("int"))).alias("at"))
    log.create(talks.select("session_id", "user_id", at.alias("at")))
    for part in ("turn < 2", "turn >= 2"):
        log.append(talks.where(part).select("session_id", "role", "text", "at"))
    log.deactivate(talks.where("conv_id % 3 = 0").select("session_id", at.alias("at")))
    log.delete(talks.where("conv_id % 4 = 1").select("session_id"))

    def now(phase):
        store = log.store()
        last = store.messages.groupBy("session_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("last_turn"))
        return written(store.info().join(last, "session_id", "left").select(F.lit(phase).alias("phase"), "session_id", "user_id", "is_active", "message_count", "last_text", "last_turn"), "session-log-read")

    before = now("before")
    log.compact()
    return before.union(now("after"))
