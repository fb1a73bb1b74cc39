from __future__ import annotations

import uuid
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import sessions
from loomgraph.operators.graph import Graph
from loomgraph.plans import extraction, retrieval
from loomgraph.plans.chat import chat
from loomgraph.plans.replies import Model, Replies, ask
from loomgraph.plans.retrieval import Plan


@pytest.fixture
def counting(tmp_path):
    """A model that notes each call, and answers differently each time."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def make(reply=lambda p: f"{p} {uuid.uuid4()}"):
        @F.pandas_udf("string")
        def model(prompts: pd.Series) -> pd.Series:
            for p in prompts:
                (Path(str(calls)) / uuid.uuid4().hex).write_text(p)
            return prompts.map(reply)

        return model

    return make, lambda: sorted(f.read_text() for f in calls.iterdir())


QUESTIONS = [(i, f"Which things in k{i % 3} are there?") for i in range(12)] + [(100, None), (101, "")]


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid long, question string").repartition(3)


def plan(spark):
    rows = spark.createDataFrame([("k0", "x"), ("k1", "y"), ("k1", "z")], "k string, thing string")
    return Plan(r"things in (\w+)", rows, "k", ["thing"], [F.col("thing")], "things of {key}")


def test_each_prompt_is_called_once(spark, tmp_path, counting):
    make, calls = counting
    replies = Replies(spark, f"file://{tmp_path}/replies")
    for _ in range(2):
        rows = replies.ask(questions(spark), F.col("question"), "m", make())
        first = sorted(map(tuple, rows.collect()), key=repr)
        assert len(first) == len(QUESTIONS) and first == sorted(map(tuple, rows.collect()), key=repr)
        assert len({r[2] for r in first if r[0] < 100}) == 3 and [r[2] for r in first if r[0] == 100] == [None]
    assert calls() == sorted({q for _, q in QUESTIONS if q is not None})
    replies.ask(questions(spark), F.col("question"), "another model", make())
    assert len(calls()) == 8


def test_failures_are_tried_again(spark, tmp_path, counting):
    make, calls = counting
    replies = Replies(spark, f"file://{tmp_path}/replies")
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "p string")
    rows = replies.ask(df, F.col("p"), "m", make(lambda p: None if p == "a" else "fine")).collect()
    assert sorted((r.p, r.reply) for r in rows if r.reply) == [("b", "fine")] and len(rows) == 3
    rows = replies.ask(df, F.col("p"), "m", make(lambda p: "now")).collect()
    assert sorted((r.p, r.reply) for r in rows) == [("a", "now"), ("a", "now"), ("b", "fine")]
    assert calls() == ["a", "a", "b"]
    assert replies.ask(df.limit(0), F.col("p"), "m", make()).collect() == []


def test_a_faster_run_s_reply_is_that_of_both(spark, tmp_path):
    replies = Replies(spark, f"file://{tmp_path}/replies")
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    inner, other = replies._commit, Replies(spark, f"file://{tmp_path}/replies")

    def late(called):
        replies._commit = inner
        other.ask(df.where("p = 'a'"), F.col("p"), "m", lambda p: F.concat(F.lit("other "), p))
        return inner(called)

    replies._commit = late
    rows = replies.ask(df, F.col("p"), "m", lambda p: F.concat(F.lit("own "), p)).collect()
    assert sorted((r.p, r.reply) for r in rows) == [("a", "other a"), ("b", "own b")]
    assert replies.table().count() == 2


def test_folders_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomgraph.plans.replies.FOLDERS", 2)
    replies = Replies(spark, f"file://{tmp_path}/replies")
    for k in range(4):
        replies.ask(spark.createDataFrame([(f"p{k}",)], "p string"), F.col("p"), "m", F.upper)
    assert sorted(r.reply for r in replies.table().collect()) == ["P0", "P1", "P2", "P3"]
    assert len(replies.log.latest().content["folders"]) == 2


@pytest.mark.parametrize("kept", [True, False])
def test_questions_are_neither_lost_nor_doubled(spark, tmp_path, counting, kept):
    """A guard and an answer that vary: a question is in one branch only, whether replies are kept or a function is given."""
    make, calls = counting
    replies = Replies(spark, f"file://{tmp_path}/replies")
    wrap = lambda name, f: Model(name, f, replies) if kept else f
    guard = wrap("guard", make(lambda p: ["generate", "end"][uuid.uuid4().int % 2]))
    rows = retrieval.answer_questions(questions(spark), guard, plan(spark), final=retrieval.model_answer("{user_input}|{data}", wrap("answer", make())))
    for _ in range(2):
        assert sorted(r.qid for r in rows.select("qid").collect()) == sorted(q for q, _ in QUESTIONS)
    found = rows.collect()
    assert [r.answer for r in found] == [r.answer for r in rows.collect()]
    for r in found:
        assert (r.answer == retrieval.REFUSAL) == (r.guardrail_decision == "end")
    if kept:
        assert len(calls()) == len(set(calls()))


def test_the_stored_answer_is_the_one_sent(spark, tmp_path, counting):
    make, _ = counting
    store = sessions.Store.empty(spark)
    requests = spark.createDataFrame([(None, f"u{i}", q) for i, q in QUESTIONS[:6]], "session_id string, user_id string, message string").withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    after, answers = chat(store, requests, retrieval.keyword_guard("things"), plan(spark), final=lambda q, data, past: make()(data))
    sent = {r.session_id: r.message for r in answers.collect()}
    stored = {r.session_id: r.text for r in after.messages.where("role = 'assistant'").collect()}
    assert sent == stored and len(set(sent.values())) == 6


def test_chunks_are_extracted_once(spark, tmp_path, counting):
    from loomgraph.operators import merge

    make, calls = counting
    chunks = spark.createDataFrame([(i, f"text {i % 2}") for i in range(4)] + [(9, "  "), (10, None)], "doc_id long, text string")
    statement = lambda p: f"MERGE (a:Thing {{title: '{p} {uuid.uuid4()}', context: ''}})|MERGE (a)-[:IS]->(a)"
    model = Model("m", make(statement), Replies(spark, f"file://{tmp_path}/replies"))
    rows = merge.statement_rows(extraction.extracted_by_model(chunks, "{context}", model).select(F.col("doc_id").alias("batch"), F.col("statements").alias("text")))
    g = merge.merge_batches(Graph(), rows)
    assert g.all_nodes().count() == 2 and calls() == ["text 0", "text 1"]
    assert g.all_edges().join(g.all_nodes().select(F.col("id").alias("src")), "src").count() == 2
    # a function that isn't kept is still settled before nodes and edges part
    rows = merge.statement_rows(extraction.extracted_by_model(chunks, "{context}", make(statement)).select(F.col("doc_id").alias("batch"), F.col("statements").alias("text")))
    g = merge.merge_batches(Graph(), rows)
    assert g.all_nodes().count() == 4 and g.all_edges().join(g.all_nodes().select(F.col("id").alias("src")), "src").count() == 4


def test_expressions_stay_expressions(spark):
    df = ask(questions(spark), F.col("question"), F.upper, "reply")
    assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_described_schema(spark):
    from loomgraph.operators import merge
    from loomgraph.operators.introspect import schema_text

    g = merge.merge_nodes(Graph(), "A", spark.createDataFrame([("x", "")], "title string, context string"))
    text = schema_text(g)
    assert extraction.described_schema(g, "{schema}", None) == text
    assert extraction.described_schema(g, "Sum up: {schema}", F.upper) == f"Sum up: {text}".upper()
    for bad in (lambda p: F.lit(None).cast("string"), lambda p: F.lit(" \n")):
        assert extraction.described_schema(g, "{schema}", bad) == text
