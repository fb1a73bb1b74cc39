"""Get-or-create writes, deletes, and batches of generated statements. Every write gives a new graph; tables are never changed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph, Match, Tables, node_id
from loomgraph.sources.scratch import settled, work_path


def _with(tables: Mapping[str, DataFrame], name: str, df: DataFrame) -> Tables:
    return Tables({**{k: lambda k=k: tables[k] for k in tables}, name: lambda: df})


def new_nodes(graph: Graph, label: str, batch: DataFrame) -> DataFrame:
    """batch: title and context, with repeats. The nodes that a merge adds."""
    new = batch.select(node_id(label, F.col("title"), F.col("context")).alias("id"), "title", "context").dropDuplicates(["id"])
    new = new.withColumn("props", F.create_map(F.lit("title"), F.col("title"), F.lit("context"), F.col("context")))
    old = graph.nodes.get(label)
    return new if old is None else new.join(old.select("id"), "id", "left_anti")


def new_edges(graph: Graph, kind: str, batch: DataFrame) -> DataFrame:
    """batch: src and dst, with repeats. The edges that a merge adds."""
    new = batch.select("src", "dst").where("src is not null and dst is not null").distinct()
    old = graph.edges.get(kind)
    return new if old is None else new.join(old, ["src", "dst"], "left_anti")


def merge_nodes(graph: Graph, label: str, batch: DataFrame) -> Graph:
    """batch: title and context, with repeats. Only nodes that aren't there yet are added."""
    new, old = new_nodes(graph, label, batch), graph.nodes.get(label)
    return Graph(_with(graph.nodes, label, new if old is None else old.unionByName(new)), graph.edges)


def merge_edges(graph: Graph, kind: str, batch: DataFrame) -> Graph:
    """batch: src and dst, with repeats."""
    new, old = new_edges(graph, kind, batch), graph.edges.get(kind)
    return Graph(graph.nodes, _with(graph.edges, kind, new if old is None else old.unionByName(new)))


def match_merge(graph: Graph, rows: Match, src: str, kind: str, dst: str) -> Graph:
    """An edge for each matched row; no match writes nothing."""
    return merge_edges(graph, kind, rows.df.select(F.col(f"{src}__id").alias("src"), F.col(f"{dst}__id").alias("dst")))


def detach_delete(graph: Graph, ids: DataFrame | None = None) -> Graph:
    """Drops nodes (ids: a column id; none: all) and the edges at either of their ends."""
    if ids is None:
        return Graph(_each(graph.nodes, lambda v: v.limit(0)), _each(graph.edges, lambda v: v.limit(0)))
    gone = ids.select("id").distinct()
    ends = lambda df, end: df.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return Graph(_each(graph.nodes, lambda v: v.join(gone, "id", "left_anti")), _each(graph.edges, lambda v: ends(ends(v, "src"), "dst").select("src", "dst")))


def removed(graph: Graph, ids: DataFrame) -> Graph:
    """What detach_delete takes out: the nodes, and the edges at either of their ends."""
    gone = ids.select("id").distinct()

    def ends(df: DataFrame) -> DataFrame:
        marked = df.join(gone.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(gone.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
        return marked.where("a or b").select("src", "dst")

    return Graph(_each(graph.nodes, lambda v: v.join(gone, "id", "left_semi")), _each(graph.edges, ends))


def _each(tables: Mapping[str, DataFrame], change: Callable[[DataFrame], DataFrame]) -> Tables:
    return Tables({k: lambda k=k: change(tables[k]) for k in tables})


#: Possessive, so that long texts neither overflow the stack nor are gone over twice. A quote that isn't closed takes in all the rest.
_TEXT = r"'([^'\\]*+(?:\\.[^'\\]*+)*+)'"
BETWEEN_PIPES = r"(?s)(?:[^|']++|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z))++"
NODE_STATEMENT = rf"(?s)^MERGE\s*\(\s*(\w+)\s*:\s*(\w+)\s*\{{\s*title\s*:\s*{_TEXT}\s*,\s*context\s*:\s*{_TEXT}\s*\}}\s*\)\s*;?$"
EDGE_STATEMENT = r"(?s)^MERGE\s*\(\s*(\w+)\s*\)\s*-\s*\[\s*:\s*(\w+)\s*\]\s*->\s*\(\s*(\w+)\s*\)\s*;?$"
TYPE_NAME = r"^[A-Z][A-Z0-9_]*$"


def statement_rows(batches: DataFrame) -> DataFrame:
    """batches: batch and text, statements between pipes. A row for each statement: kind (node, edge or rejected) and its fields.

    A pipe inside quotes doesn't split. Edge types that aren't upper snake case, and anything but the two forms, are rejected.
    """
    parts = F.regexp_extract_all("text", F.lit(BETWEEN_PIPES), F.lit(0))
    each = batches.select("batch", F.posexplode(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "statement"))
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    node, edge = F.col("statement").rlike(NODE_STATEMENT), F.col("statement").rlike(EDGE_STATEMENT) & F.regexp_extract("statement", EDGE_STATEMENT, 2).rlike(TYPE_NAME)
    pick = lambda pattern, when, i: F.when(when, F.regexp_extract("statement", pattern, i))
    return each.select(
        "batch",
        "pos",
        "statement",
        F.when(node, "node").when(edge, "edge").otherwise("rejected").alias("kind"),
        F.coalesce(pick(NODE_STATEMENT, node, 1), pick(EDGE_STATEMENT, edge, 1)).alias("var"),
        F.coalesce(pick(NODE_STATEMENT, node, 2), pick(EDGE_STATEMENT, edge, 2)).alias("name"),
        plain(pick(NODE_STATEMENT, node, 3)).alias("title"),
        plain(pick(NODE_STATEMENT, node, 4)).alias("context"),
        pick(EDGE_STATEMENT, edge, 3).alias("to_var"),
    )


def reused_variables(rows: DataFrame) -> DataFrame:
    """Variables that a batch binds more than once."""
    return rows.where("kind = 'node'").groupBy("batch", "var").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def batch_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, id, title, context) and edges (src, type, dst) of statement rows; variables hold within their batch only, and an
    edge whose variable isn't bound there writes nothing."""
    nodes = rows.where("kind = 'node'").select("batch", "var", F.col("name").alias("label"), node_id(F.col("name"), F.col("title"), F.col("context")).alias("id"), "title", "context")
    bound = nodes.select("batch", "var", "id")
    edges = rows.where("kind = 'edge'").select("batch", F.col("var").alias("a"), F.col("name").alias("type"), F.col("to_var").alias("b"))
    edges = edges.join(bound.withColumnsRenamed({"var": "a", "id": "src"}), ["batch", "a"]).join(bound.withColumnsRenamed({"var": "b", "id": "dst"}), ["batch", "b"])
    return nodes.select("label", "id", "title", "context").distinct(), edges.select("src", "type", "dst").distinct()


def merge_batches(graph: Graph, rows: DataFrame) -> Graph:
    """Merges all batches. They are taken apart once, into tables with a partition for each label and type, in the work folder; the labels
    and types present are schema, and few. Statements that might be others when they are made again are written first."""
    rows = settled(rows, "statements")
    nodes, edges = batch_rows(rows)
    for column, table, merged in (("label", nodes, merge_nodes), ("type", edges, merge_edges)):
        path = work_path(rows.sparkSession, f"batch-{column}")
        table.write.partitionBy(column).parquet(path)
        table = rows.sparkSession.read.schema(table.schema).parquet(path)
        for name in sorted(r[0] for r in table.select(column).distinct().collect()):
            graph = merged(graph, name, table.where(F.col(column) == name))
    return graph


def merge_by_titles(graph: Graph, links: DataFrame) -> Graph:
    """links: type, src_label, src_title, dst_label, dst_title; a MATCH of two titles and a MERGE between them for each row. Ends that aren't
    there write nothing; a title that several nodes have links each. Types and labels are schema, and few."""
    for kind, a, b in sorted(map(tuple, links.select("type", "src_label", "dst_label").distinct().collect())):
        own = links.where((F.col("type") == kind) & (F.col("src_label") == a) & (F.col("dst_label") == b))
        source = graph.table(a).select(F.col("id").alias("src"), F.col("title").alias("src_title"))
        target = graph.table(b).select(F.col("id").alias("dst"), F.col("title").alias("dst_title"))
        graph = merge_edges(graph, kind, own.join(source, "src_title").join(target, "dst_title"))
    return graph
