"""Property graphs as DataFrames, and patterns as joins.

A graph has one node table for each label (id, title, context, props) and one edge table for each type (src, dst). A pattern is
built step by step, and every step is a DataFrame step, so filters, columns and join strategies are Catalyst's to choose.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import skew

NODE = "id string, title string, context string, props map<string,string>"
EDGE = "src string, dst string"
DEFAULT_LIMIT, PROMPT_LIMIT = 5, 10


def node_id(label: Column | str, title: Column, context: Column) -> Column:
    """The identity of a node is its label and all of its properties. Parts stand between separators, and a null is a sign of its own; where a
    part holds either, it is written with an escape, so no two nodes have one identity."""
    label = F.lit(label) if isinstance(label, str) else label
    parts = [F.coalesce(_escaped(x), F.lit("\x00")) for x in (label, title, context)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _escaped(part: Column) -> Column:
    for sign, code in (("\x1b", "e"), ("\x1f", "s"), ("\x00", "n")):
        part = F.replace(part, F.lit(sign), F.lit(f"\x1b{code}"))
    return part


class Tables(Mapping):
    """Tables by name that are opened when they are first asked for, as opening one reads its footers."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._open = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._makers[name]()
        return self._open[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass(frozen=True)
class Graph:
    nodes: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: Mapping[str, DataFrame] = field(default_factory=dict)
    #: Of a type and an end (src, dst), the nodes that very many edges have there; with_hubs() finds them.
    hubs: Mapping[tuple[str, str], DataFrame | None] = field(default_factory=dict)

    def all_nodes(self) -> DataFrame:
        """Nodes of any label."""
        return reduce(DataFrame.unionByName, (df.select(F.lit(label).alias("label"), "id", "title", "context", "props") for label, df in sorted(self.nodes.items())), _none(f"label string, {NODE}"))

    def all_edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (df.select("src", F.lit(kind).alias("type"), "dst") for kind, df in sorted(self.edges.items())), _none("src string, type string, dst string"))

    def table(self, label: str) -> DataFrame:
        """The nodes of a label; a label that the graph doesn't have has none."""
        return self.nodes[label] if label in self.nodes else _none(NODE)

    def links(self, kind: str) -> DataFrame:
        """The edges of a type; a type that the graph doesn't have has none."""
        return self.edges[kind] if kind in self.edges else _none(EDGE)

    def with_hubs(self, *kinds: str, rows: int = skew.ROWS) -> Graph:
        """The same graph, knowing the hubs of some types or of all: patterns that pass them deal their edges over many tasks. It counts
        the edges of each node once; without it a hub's edges are split by AQE only, which doesn't split where a plan has no shuffle read."""
        found = {(k, end): hubs for k in kinds or self.edges for end, hubs in skew.frequent_of(self.edges[k], ("src", "dst"), rows).items()}
        return Graph(self.nodes, self.edges, {**self.hubs, **found})

    def match(self, var: str, label: str | None = None) -> Match:
        """Starts a pattern with the nodes of a label, or of any."""
        return Match(self, _named(self._scan(label), var), (var,), var)

    def _scan(self, label: str | None) -> DataFrame:
        return self.all_nodes().drop("label") if label is None else self.table(label)


def _none(schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame([], schema)


def _named(df: DataFrame, var: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{var}__{c}") for c in ("id", "title", "context", "props")))


@dataclass(frozen=True)
class Match:
    """Rows so far (a bag), the variables they bind, the one that the next step starts from, and the edges passed in this clause."""

    graph: Graph
    df: DataFrame
    vars: tuple[str, ...]
    at: str
    passed: tuple[tuple[str, str], ...] = ()

    def prop(self, var: str, name: str) -> Column:
        return self.df[f"{var}__{name}"] if name in ("id", "title", "context") else self.df[f"{var}__props"][name]

    def _with(self, **changed) -> Match:
        return Match(**{**self.__dict__, **changed})

    def where_equal(self, var: str, name: str, value) -> Match:
        """Inline property equality; null never matches."""
        return self._with(df=self.df.where(self.prop(var, name) == F.lit(value)))

    def where_contains(self, var: str, name: str, value: str) -> Match:
        """Fuzzy match: contains, both sides in lower case."""
        return self._with(df=self.df.where(F.contains(F.lower(self.prop(var, name)), F.lower(F.lit(value)))))

    def where(self, condition: Column) -> Match:
        return self._with(df=self.df.where(condition))

    def start(self, var: str) -> Match:
        """The next step starts from a variable bound before."""
        return self._with(at=var)

    def to(self, kind: str, var: str, label: str | None = None, *, reverse: bool = False, optional: bool = False) -> Match:
        """Follows edges of a type from the current variable to nodes of a label. An edge is passed once at most in a clause.

        The rows so far meet the edges first and what they lead to then, so a filter on the start thins out both joins. Only an optional
        step joins edges and far nodes beforehand, as a row goes on without a hop if the far node isn't of the label.
        """
        edges = self.graph.links(kind)
        if reverse:
            edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        step = f"e{len(self.passed)}__{var}"
        edges = edges.select(F.col("src").alias(f"{step}_a"), F.col("dst").alias(f"{step}_b"))
        far = _named(self.graph._scan(label), var)
        near_end, far_end = F.col(f"{self.at}__id") == F.col(f"{step}_a"), F.col(f"{step}_b") == F.col(f"{var}__id")
        near_hubs, far_hubs = (self.graph.hubs.get((kind, end)) for end in (("dst", "src") if reverse else ("src", "dst")))
        if optional:
            df = self.df.join(edges.join(far, far_end), near_end, "left")
        else:
            df = self.df.join(edges, near_end) if near_hubs is None else skew.spread(edges, F.col(f"{step}_a"), self.df, F.col(f"{self.at}__id"), near_hubs)
            df = df.join(far, far_end) if far_hubs is None else skew.spread(df, F.col(f"{step}_b"), far, F.col(f"{var}__id"), far_hubs)
        own = [F.col(f"{step}_b"), F.col(f"{step}_a")] if reverse else [F.col(f"{step}_a"), F.col(f"{step}_b")]
        df = df.withColumn(step, F.struct(own[0].alias("src"), own[1].alias("dst")))
        for other, k in self.passed:
            if k == kind:
                df = df.where(_another(step, other))
        return self._with(df=df.drop(f"{step}_a", f"{step}_b"), vars=(*self.vars, var), at=var, passed=(*self.passed, (step, kind)))

    def back(self, kind: str, var: str, label: str | None = None, **how) -> Match:
        """Follows edges against their direction."""
        return self.to(kind, var, label, reverse=True, **how)

    def also(self, other: Match) -> Match:
        """A comma between patterns of one clause: rows agree in variables that both bind, and no edge is passed by both. Without a common
        variable that is all combinations: filter both sides first; a large product is the caller's wish."""
        steps = {step: f"e{len(self.passed) + i}__{step.split('__', 1)[1]}" for i, (step, _) in enumerate(other.passed)}
        common = [v for v in other.vars if v in self.vars]
        shared = {f"{v}__{c}": f"also__{v}__{c}" for v in common for c in ("id", "title", "context", "props")}
        right = other.df.withColumnsRenamed({**steps, **shared})
        df = self.df.join(right, reduce(Column.__and__, (F.col(f"{v}__id") == F.col(f"also__{v}__id") for v in common))) if common else self.df.crossJoin(right)
        for step, kind in other.passed:
            for own, k in self.passed:
                if k == kind:
                    df = df.where(_another(steps[step], own))
        passed = (*self.passed, *((steps[step], kind) for step, kind in other.passed))
        return self._with(df=df.drop(*shared.values()), vars=(*self.vars, *(v for v in other.vars if v not in common)), at=other.at, passed=passed)

    def carry(self, *vars: str) -> Match:
        """WITH: only these variables go on, rows keep their number, and a new clause begins."""
        columns = [f"{v}__{c}" for v in vars for c in ("id", "title", "context", "props")]
        return self._with(df=self.df.select(*columns), vars=vars, at=vars[-1], passed=())

    def returns(self, *items: tuple[str, str, str], distinct: bool = False) -> DataFrame:
        """Named properties: (variable, property, alias)."""
        df = self.df.select(*(self.prop(v, p).alias(a) for v, p, a in items))
        return df.distinct() if distinct else df

    def count(self, alias: str = "n") -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias(alias))


def _another(step: str, other: str) -> Column:
    """The edge of a step isn't that of another; a step that wasn't taken passes none."""
    return ~F.col(step).eqNullSafe(F.col(other)) | F.col(f"{step}.src").isNull()


def limited(df: DataFrame, n: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """The asked number of rows, or five."""
    return (df.orderBy(*order) if order else df).limit(DEFAULT_LIMIT if n is None else n)


def reachable(edges: DataFrame, most: int) -> DataFrame:
    """Pairs of nodes that are one to most directed steps apart, with the least number of steps; the number of joins is most - 1."""
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    paths = found = step.select("a", "b", F.lit(1).alias("steps"))
    for k in range(2, most + 1):
        paths = paths.select("a", F.col("b").alias("m")).join(step.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct().withColumn("steps", F.lit(k))
        found = found.union(paths)
    return found.groupBy("a", "b").agg(F.min("steps").alias("steps"))
