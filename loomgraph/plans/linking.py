"""Planning by the schema: a question names a node, perhaps misspelt, and a label; the schema says how one leads to the other."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import quote_escape
from loomgraph.operators.graph import DEFAULT_LIMIT, Graph
from loomgraph.operators.introspect import Statistics, schema
from loomgraph.operators.titles import links
from loomgraph.plans.retrieval import NO_PLAN, context_json
from loomgraph.sources.scratch import written

#: Signs around a word that don't belong to it, and the number of a mention's characters for which one edit is allowed.
AROUND, CHARS_PER_EDIT = "?!.,;:\"'()", 4
#: A step: type, whether it is passed against its direction, and the label it leads to.
Step = tuple[str, bool, str]


def spoken(label: str) -> str:
    """A label as it stands in a question: its words in lower case."""
    return " ".join(re.findall(r"[A-Z]+(?![^A-Z_])|[A-Z]?[^A-Z_]+", label)).lower()


def tokens(question: Column) -> Column:
    """The words of a question, without signs around them."""
    return F.filter(F.transform(F.split(question, r"\s+"), lambda t: F.btrim(t, F.lit(AROUND))), lambda t: t != "")


def mentions(questions: DataFrame, question: str, words: int) -> DataFrame:
    """All runs of up to so many words of each question: where they begin, their number, their text. A null question has none."""
    own = F.col("tokens_")

    def of(n: int) -> Column:
        at = F.when(F.size(own) >= n, F.sequence(F.lit(0), F.size(own) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(own, i + 1, F.lit(n)), " ").alias("text")))

    # the words are a column of their own, so they are taken apart once and not for each run
    return questions.withColumn("tokens_", tokens(F.col(question))).select(question, F.inline(F.concat(*(of(n) for n in range(1, words + 1)))))


def shortest(schema: Iterable[tuple[str, str, str]], start: str, end: str, hops: int) -> list[Step] | None:
    """The least number of steps between two labels, in either direction of a type; of equally long ways the first by types. Schema rows only."""
    ways: list[tuple[str, list[Step]]] = [(start, [])]
    seen = {start}
    for _ in range(hops):
        longer = []
        for at, way in ways:
            steps = [(t, False, b) for a, t, b in schema if a == at] + [(t, True, a) for a, t, b in schema if b == at]
            longer += [(far, [*way, (t, back, far)]) for t, back, far in steps]
        longer.sort(key=lambda w: w[1])
        for far, way in longer:
            if far == end:
                return way
        ways = [next(w for w in longer if w[0] == far) for far in sorted({far for far, _ in longer} - seen)]
        seen |= {far for far, _ in ways}
    return None


@dataclass(frozen=True)
class SchemaPlan:
    """A planner that needs no patterns of questions, but the schema: (label, type, label) rows.

    A question's entity is the node whose title is nearest to one of its runs of words: within so many edits, one for each four characters
    at most; of equally near ones the longest run counts, then title and id. Its target is the first label that it names, in the singular or
    with an s, other than the entity's own. The context holds the title and context of the nodes of that label which the shortest way of
    the schema reaches from the entity, or of all its neighbours where no label is named; distinct nodes, the first ones by title and id. A
    question without an entity, without a way to its target, or null has an empty context and an error.

    Only distinct questions are looked up, each distinct run of words is linked once, and the graph is asked once for each entity and target.
    What passes the driver is pairs of labels, at most as many as the schema has.
    """

    graph: Graph
    schema: tuple[tuple[str, str, str], ...]
    edits: int = 1
    words: int = 3
    hops: int = 3
    limit: int = DEFAULT_LIMIT

    @staticmethod
    def of(graph: Graph, statistics: Statistics | None = None, **how) -> SchemaPlan:
        """With the schema of kept figures, or as all edges have it."""
        rows = [(r.src_label, r.type, r.dst_label) for r in statistics.triples.collect()] if statistics else schema(graph)
        return SchemaPlan(graph, tuple(sorted(rows)), **how)

    def entities(self, questions: DataFrame, question: str) -> DataFrame:
        """Rows: asked (distinct questions), id, title, label and target; questions without an entity are left out."""
        spark = questions.sparkSession
        asked = questions.select(F.col(question).alias("asked")).where("asked is not null").distinct()
        runs = mentions(asked, "asked", self.words)
        labels = sorted({x for a, _, b in self.schema for x in (a, b)})
        names = spark.createDataFrame([(name, x) for x in labels for name in (spoken(x), spoken(x) + "s")], "name string, named string")
        marked = runs.join(F.broadcast(names), F.lower("text") == F.col("name"), "left").drop("name")
        texts = marked.where("named is null").select("text").distinct()
        nodes = Graph({x: self.graph.nodes[x] for x in labels if x in self.graph.nodes}).all_nodes()
        found = links(texts, nodes, self.edits, "text", "text", ("label",)).where(F.col("distance") * CHARS_PER_EDIT <= F.char_length("text"))
        # the best node of each run of words first, so a title of very many nodes is reduced before it meets the questions
        best = found.groupBy("text").agg(F.min(F.struct("distance", "title", "id", "label")).alias("best"))
        near = F.struct("best.distance", (-F.char_length("text")).alias("length"), "best.title", "best.id", "best.label")
        entity = marked.where("named is null").join(best, "text").groupBy("asked").agg(F.min(near).alias("e")).select("asked", "e.id", "e.title", "e.label")
        spoken_of = marked.where("named is not null").select("asked", "at", "named")
        target = spoken_of.join(entity.select("asked", "label"), "asked").where("named <> label").groupBy("asked").agg(F.min_by("named", F.struct("at", "named")).alias("target"))
        return entity.join(target, "asked", "left")

    def ways(self, label: str, target: str | None) -> list[list[Step]]:
        if target is not None:
            way = shortest(self.schema, label, target, self.hops)
            return [way] if way else []
        return [[(t, False, b)] for a, t, b in self.schema if a == label] + [[(t, True, a)] for a, t, b in self.schema if b == label]

    def retrieve(self, questions: DataFrame, qid: str, question: str) -> DataFrame:
        linked = written(self.entities(questions, question), "linked")
        pairs = sorted(((r.label, r.target) for r in linked.select("label", "target").distinct().collect()), key=lambda p: (p[0], p[1] or ""))
        reached, text = None, F.lit(None).cast("string")
        for label, target in pairs:
            own = (F.col("label") == label) & F.col("target").eqNullSafe(F.lit(target))
            ways = self.ways(label, target)
            for way in ways:
                rows = self._reached(linked.where(own).select("id").distinct(), label, way).withColumn("target", F.lit(target).cast("string"))
                reached = rows if reached is None else reached.union(rows)
            if ways:
                text = F.when(own, self._text(label, ways[0] if target else None)).otherwise(text)
        out = linked.select("asked", _key().alias("key_"), text.alias("query"))
        if reached is not None:
            shown = reached.distinct().withColumn("key_", _key())
            out = out.join(context_json(shown, "key_", ["title", "context"], [F.col("title").asc_nulls_last(), F.col("far")], self.limit), "key_", "left")
        else:
            out = out.withColumn("context", F.lit(None).cast("string"))
        rows = questions.join(out.drop("key_").withColumnRenamed("asked", "asked_"), F.col(question) == F.col("asked_"), "left").drop("asked_")
        error = F.when(F.col("query").isNull(), F.lit(NO_PLAN))
        return rows.withColumn("error", error).withColumns({"context": F.coalesce("context", F.lit("[]")), "query": F.coalesce("query", "error")})

    def _reached(self, starts: DataFrame, label: str, way: list[Step]) -> DataFrame:
        m = self.graph.match("v0", label)
        m = replace(m, df=m.df.join(starts.withColumnRenamed("id", "v0__id"), "v0__id", "left_semi"))
        for i, (kind, back, far) in enumerate(way, 1):
            m = m.to(kind, f"v{i}", far, reverse=back)
        last = f"v{len(way)}"
        return m.returns(("v0", "id", "id"), (last, "id", "far"), (last, "title", "title"), (last, "context", "context"))

    def _text(self, label: str, way: list[Step] | None) -> Column:
        """How the pattern reads."""
        names = [chr(ord("b") + i) for i in range(len(way or [0]))]
        steps = "".join(f"{'<' * back}-[:{kind}]-{'>' * (not back)}({v}:{far})" for v, (kind, back, far) in zip(names, way)) if way else "--(b)"
        end = f"'}}){steps} RETURN DISTINCT {names[-1]}.title, {names[-1]}.context LIMIT {self.limit}"
        return F.concat(F.lit(f"MATCH (a:{label} {{title: '"), quote_escape("title"), F.lit(end))


def _key() -> Column:
    return F.concat_ws("\x1f", F.coalesce("target", F.lit("")), "id")
