"""Planning by the schema."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomgraph.operators import introspect
from loomgraph.operators.graph import EDGE, NODE, Graph
from loomgraph.plans.linking import SchemaPlan, mentions, shortest, spoken
from loomgraph.plans.retrieval import NO_PLAN, answer_questions, keyword_guard

SCHEMA = (("Course", "HELD_IN", "Room"), ("Person", "TEACHES", "Course"), ("Person", "WORKS_IN", "ResearchUnit"), ("Room", "PART_OF", "House"))


def graph(spark):
    def nodes(*titles):
        return spark.createDataFrame([(f"{t}{i}", t, f"about {t}", {"title": t or ""}) for i, t in enumerate(titles)], NODE)

    def edges(*pairs):
        return spark.createDataFrame(list(pairs), "src string, dst string")

    people, courses, rooms = nodes("Nowak", "Kowalski", "Nowak", None), nodes("Graph theory", "Algebra", "It's logic"), nodes("A1", "B22")
    return Graph(
        {"Person": people, "Course": courses, "Room": rooms, "ResearchUnit": nodes("Algebra"), "House": nodes("Main house")},
        {
            "TEACHES": edges(("Nowak0", "Graph theory0"), ("Nowak0", "Algebra1"), ("Nowak0", "Algebra1"), ("Kowalski1", "It's logic2")),
            "HELD_IN": edges(("Graph theory0", "A10"), ("Algebra1", "B221")),
            "WORKS_IN": edges(("Kowalski1", "Algebra0")),
            "PART_OF": edges(("A10", "Main house0")),
        },
    )


def ask(spark, *questions, **how):
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "qid int, question string")
    out = SchemaPlan(graph(spark), SCHEMA, **how).retrieve(rows, "qid", "question").orderBy("qid").collect()
    assert [r.qid for r in out] == list(range(len(questions)))
    return [([x["title"] for x in json.loads(r.context)], r.query, r.error) for r in out]


def test_schema_of_a_graph(spark):
    assert SchemaPlan.of(graph(spark)).schema == SCHEMA


def test_spoken_labels():
    assert [spoken(x) for x in ("Person", "ResearchUnit", "WORKS_IN", "PhDStudent", "x")] == ["person", "research unit", "works in", "ph d student", "x"]


def test_mentions(spark):
    asked = spark.createDataFrame([('  Who is "Dr. No"?',), ("",), (" ?! ",), (None,)], "q string")
    got = [tuple(r) for r in mentions(asked, "q", 2).select("at", "n", "text").collect()]
    assert got == [(0, 1, "Who"), (1, 1, "is"), (2, 1, "Dr"), (3, 1, "No"), (0, 2, "Who is"), (1, 2, "is Dr"), (2, 2, "Dr No")]


def test_shortest_ways():
    assert shortest(SCHEMA, "Person", "Room", 3) == [("TEACHES", False, "Course"), ("HELD_IN", False, "Room")]
    assert shortest(SCHEMA, "House", "ResearchUnit", 3) is None
    assert shortest(SCHEMA, "House", "ResearchUnit", 4) == [("PART_OF", True, "Room"), ("HELD_IN", True, "Course"), ("TEACHES", True, "Person"), ("WORKS_IN", False, "ResearchUnit")]
    assert shortest((("A", "Y", "B"), ("A", "X", "B")), "A", "B", 1) == [("X", False, "B")]
    assert shortest((("A", "NEXT", "A"),), "A", "A", 2) == [("NEXT", False, "A")]


def test_questions(spark):
    got = ask(spark, "Which courses does Nowak teach?", "which rooms is nowk in", "What about Kowalski?", "Which research units is Kowalski in?", None, "", "Tell me a joke", "Which house is kowalski in?", "Which rooms is Nowak in", "Which rooms is Nowak in")
    assert got[0] == (["Algebra", "Graph theory"], "MATCH (a:Person {title: 'Nowak'})-[:TEACHES]->(b:Course) RETURN DISTINCT b.title, b.context LIMIT 5", None)
    assert got[1] == (["A1", "B22"], "MATCH (a:Person {title: 'Nowak'})-[:TEACHES]->(b:Course)-[:HELD_IN]->(c:Room) RETURN DISTINCT c.title, c.context LIMIT 5", None)
    assert got[2] == (["Algebra", "It's logic"], "MATCH (a:Person {title: 'Kowalski'})--(b) RETURN DISTINCT b.title, b.context LIMIT 5", None)
    assert got[3][0] == ["Algebra"] and "ResearchUnit" in got[3][1]
    assert got[4:7] == [([], NO_PLAN, NO_PLAN)] * 3
    assert got[7][0] == [] and got[7][2] is None  # there is a way, but no room of that course
    assert got[8] == got[9] == got[1]


def test_edits_follow_the_length(spark):
    """One edit for each four characters; a longer run of words wins among equally near ones; quotes are guarded."""
    got = ask(spark, "A2", "Which person teaches It's logic?", "Which room is graph theroy held in?", "Which room is graph theroy held in?", edits=2, limit=1)
    assert got[0] == ([], NO_PLAN, NO_PLAN)
    assert got[1] == (["Kowalski"], "MATCH (a:Course {title: 'It\\'s logic'})<-[:TEACHES]-(b:Person) RETURN DISTINCT b.title, b.context LIMIT 1", None)
    assert got[2] == got[3] and got[2][0] == ["A1"]


def test_no_way_and_empty_tables(spark):
    assert ask(spark, "Which research unit is Main house?") == [([], NO_PLAN, NO_PLAN)]
    none = spark.createDataFrame([], "qid int, question string")
    assert SchemaPlan(graph(spark), SCHEMA).retrieve(none, "qid", "question").collect() == []
    asked = spark.createDataFrame([(1, "Nowak")], "qid int, question string")
    assert SchemaPlan(Graph(), ()).retrieve(asked, "qid", "question").first().error == NO_PLAN


def test_in_the_question_path(spark):
    asked = spark.createDataFrame([(1, "Which courses does Nowak teach?"), (2, "Hello")], "qid int, question string")
    rows = {r.qid: r for r in answer_questions(asked, keyword_guard("course"), SchemaPlan(graph(spark), SCHEMA)).collect()}
    assert "Graph theory" in rows[1].answer and rows[2].context == "[]"


def test_schema_without_a_join_of_plain_types_edges(spark, monkeypatch):
    """Types of one label at each end need no look at their edges; others, with labels mixed or ends that aren't there, give the same."""
    node = lambda *ids: spark.createDataFrame([(i, i, "", None) for i in ids], NODE)
    edge = lambda *pairs: spark.createDataFrame(list(pairs), EDGE)
    edges = {"PLAIN": edge(("a1", "b1"), ("a2", "b1")), "MIXED": edge(("a1", "b1"), ("b1", "a1"), ("c1", "c1")), "TORN": edge(("a1", "gone"), ("gone", "b1")), "OPEN": edge(("a1", "b1"), (None, "b1")), "NONE": edge(), "TWICE": edge(("a1", "x"))}
    g = Graph({"A": node("a1", "a2", "x"), "B": node("b1", "x"), "C": node("c1")}, edges)
    want = sorted((r.src_label, r.type, r.dst_label) for r in introspect.triples(g).collect())
    inner, joined = introspect.triples, []
    monkeypatch.setattr(introspect, "triples", lambda graph: joined.append(sorted(graph.edges)) or inner(graph))
    assert list(SchemaPlan.of(g).schema) == want and ("A", "PLAIN", "B") in want
    assert joined == [["MIXED", "OPEN", "TORN", "TWICE"]]
