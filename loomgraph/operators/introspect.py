"""The schema of a graph: labels, properties with samples, relationship triples, summary texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.sources.scratch import written

HEADINGS = ("Node properties:", "Relationship properties:", "The relationships:")


def labels(graph: Graph) -> DataFrame:
    return graph.all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def triples(graph: Graph) -> DataFrame:
    """Which labels each type joins, and how often."""
    ends = graph.all_nodes().select("id", "label")
    edges = graph.all_edges().join(ends.withColumnsRenamed({"id": "src", "label": "src_label"}), "src").join(ends.withColumnsRenamed({"id": "dst", "label": "dst_label"}), "dst")
    return edges.groupBy("src_label", "type", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def schema(graph: Graph) -> list[tuple[str, str, str]]:
    """Which labels each type joins: triples() without counts, in order.

    A type whose edges all begin at nodes of one label and all end at nodes of one joins these two, so its ends are looked up once each
    and not its edges. Only types with several labels at an end, or with ends that aren't there, are joined edge by edge.
    """
    ends = graph.all_edges().select("type", F.inline(F.array(*(F.struct(F.lit(x).alias("end"), F.col(x).alias("id")) for x in ("src", "dst"))))).distinct()
    known = ends.join(graph.all_nodes().select("id", "label"), "id", "left")
    found: dict[str, dict[str, list[str | None]]] = {}
    for r in known.select("type", "end", "label").distinct().collect():
        found.setdefault(r.type, {}).setdefault(r.end, []).append(r.label)
    plain = {t: (*of["src"], t, *of["dst"]) for t, of in found.items() if all(len(x) == 1 and x[0] is not None for x in of.values())}
    rest = {t: graph.edges[t] for t in found if t not in plain}
    rows = [(r.src_label, r.type, r.dst_label) for r in triples(Graph(graph.nodes, rest)).collect()] if rest else []
    return sorted([*plain.values(), *rows])


#: Random groups of a property's values whose least values bound its first ones.
GROUPS = 64


def samples(graph: Graph, k: int = 5) -> DataFrame:
    """The first k distinct values, in order, of each label's properties.

    The k-th of the least values of random groups of values is k-th or later among all, so only values up to it can be wanted: one scan
    gathers a few numbers for each property, the next shuffles little more than what is shown.
    """
    each = _values(graph)
    least = each.groupBy("label", "property", F.pmod(F.xxhash64("value"), F.lit(GROUPS)).alias("group")).agg(F.min("value").alias("value"))
    bound = _first(least, k).groupBy("label", "property").agg(F.when(F.count(F.lit(1)) == k, F.max("value")).alias("bound"))
    few = each.join(bound, ["label", "property"]).where("bound is null or value <= bound").select("label", "property", "value").distinct()
    return _first(few, k).groupBy("label", "property").agg(F.array_sort(F.collect_list("value")).alias("samples"))


def _first(values: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("label", "property").orderBy("value"))
    return values.withColumn("turn", turn).where(F.col("turn") <= k)


@dataclass(frozen=True)
class Statistics:
    """The schema's figures of a graph, kept from version to version: how many nodes a label has, which labels each type joins and how often,
    and the k least values of each property. A write changes them by what it adds or removes; the graph isn't counted again.

    labels: label, n. triples: src_label, type, dst_label, n. least: label, property, value. All are as small as the schema.
    """

    labels: DataFrame
    triples: DataFrame
    least: DataFrame
    k: int = 5

    @staticmethod
    def of(graph: Graph, k: int = 5) -> Statistics:
        """From a full count."""
        least = samples(graph, k).select("label", "property", F.explode("samples").alias("value"))
        return Statistics(*(written(df, "statistics") for df in (labels(graph), triples(graph), least)), k)

    def changed(self, after: Graph, added: Graph | None = None, removed: Graph | None = None, before: Graph | None = None) -> Statistics:
        """after a write that added and removed some nodes and edges. before: the graph that removed edges lie in (their ends' labels are
        looked up there). Values are read again for those properties only of which one of the k least has been removed."""
        none, parts = Graph(), {1: added or Graph(), -1: removed or Graph()}
        whole = {1: after, -1: before or after}

        def total(old: DataFrame, keys: list[str], count: Callable[[Graph, Graph], DataFrame]) -> DataFrame:
            rows = old
            for sign, part in parts.items():
                rows = rows.unionByName(count(part, whole[sign]).withColumn("n", F.col("n") * sign))
            return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")

        own = total(self.labels, ["label"], lambda part, _: labels(part))
        joined = total(self.triples, ["src_label", "type", "dst_label"], lambda part, g: triples(Graph(g.nodes, part.edges)))
        lost = _values(parts[-1]).join(F.broadcast(self.least), ["label", "property", "value"], "left_semi").select("label", "property").distinct()
        again = {(r.label, r.property) for r in lost.collect()}  # schema rows
        kept = self.least.unionByName(_values(parts[1]))
        if again:
            stale = F.broadcast(self.least.sparkSession.createDataFrame(sorted(again), "label string, property string"))
            some = Graph({label: after.nodes[label] for label in {a for a, _ in again} if label in after.nodes}, none.edges)
            kept = kept.join(stale, ["label", "property"], "left_anti").unionByName(_values(some).join(stale, ["label", "property"], "left_semi"))
        least = _first(kept.distinct(), self.k).drop("turn")
        return Statistics(*(written(df, "statistics") for df in (own, joined, least)), self.k)


def _values(graph: Graph) -> DataFrame:
    return graph.all_nodes().select("label", F.explode("props").alias("property", "value")).where("value is not null")


def summary(graph: Graph) -> DataFrame:
    """One row: labels with counts, and types, as texts."""
    own = labels(graph).agg(F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit(" ("), F.col("n"), F.lit(")")))), ", ").alias("node_types"))
    kinds = graph.all_edges().select("type").distinct().agg(F.array_join(F.array_sort(F.collect_list("type")), ", ").alias("relationship_types"))
    return own.crossJoin(kinds)


def schema_text(graph: Graph, k: int = 5) -> str:
    """The three headed sections; schema rows are few, whatever the graph's size."""
    props = [f"{r.label}.{r.property}: {', '.join(r.samples)}" for r in samples(graph, k).orderBy("label", "property").collect()] if graph.nodes else []
    rels = [f"(:{r.src_label})-[:{r.type}]->(:{r.dst_label})" for r in triples(graph).orderBy("src_label", "type", "dst_label").collect()] if graph.edges and graph.nodes else []
    return "\n".join([HEADINGS[0], *props, HEADINGS[1], HEADINGS[2], *rels])


def is_empty_schema(text: str | None) -> bool:
    """Blank, or nothing but the headings."""
    return not [line for line in (text or "").splitlines() if line.strip() and line.strip() not in HEADINGS]


def summary_text(graph: Graph) -> str:
    row = summary(graph).first()
    lone = graph.all_nodes().select("id").join(graph.all_edges().select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti").count()
    return f"NODE TYPES: {row.node_types}\nRELATIONSHIP TYPES: {row.relationship_types}\nOBSERVATIONS: {lone} nodes have no relationship.\nEXTRACTION HINTS: relationships for nodes that have none."


class SchemaCache:
    """The schema text of a snapshot, by its version; a new version is read anew, and an empty schema isn't kept."""

    def __init__(self):
        self._kept: dict[str, str] = {}

    def get(self, version: str, graph: Graph) -> str:
        if version not in self._kept:
            text = schema_text(graph)
            if is_empty_schema(text):
                return ""
            self._kept = {version: text}
        return self._kept[version]
