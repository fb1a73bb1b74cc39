from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loomgraph.operators import sessions
from loomgraph.plans import retrieval
from loomgraph.plans.chat import chat
from loomgraph.streaming import live

AT = dt.datetime(2024, 1, 1)


def at(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def store(spark):
    s = sessions.Store.empty(spark).create(at(spark, [("a", "u", AT), ("b", "u", AT + dt.timedelta(1)), ("c", "v", AT)], "session_id string, user_id string, at timestamp_ntz"))
    new = [("a", "user", "hi", AT + dt.timedelta(2)), ("zz", "user", "lost", AT), ("b", "robot", "bad role", AT)]
    return s.append(at(spark, new, "session_id string, role string, text string, at timestamp_ntz"))


def test_store(spark):
    s, lost = store(spark)
    assert sorted(r.text for r in lost.collect()) == ["bad role", "lost"]
    assert {r.session_id: r.message_count for r in s.info().collect()} == {"a": 1, "b": 0, "c": 0}
    assert {r.user_id: r.session_id for r in s.latest_active().collect()} == {"u": "a", "v": "c"}
    assert [r.session_id for r in s.of_user("u").collect()] == ["a", "b"]
    off = s.deactivate(at(spark, [("a", AT + dt.timedelta(9))], "session_id string, at timestamp_ntz"))
    assert [r.session_id for r in off.of_user("u").collect()] == ["b"] and off.get("a").first().updated_at == AT + dt.timedelta(9)
    gone = s.delete(s.sessions)
    assert gone.stats().first().asDict() == {"total_sessions": 0, "active_sessions": 0, "inactive_sessions": 0, "total_messages": 0, "unique_users": 2, "avg_messages_per_session": 0.0}
    empty, n = s.clear()
    assert n == 3 and empty.stats().first().unique_users == 0


def test_created_ids_and_repeats(spark):
    s, _ = store(spark)
    more = s.create(at(spark, [("a", "other", AT), (None, "w", AT)], "session_id string, user_id string, at timestamp_ntz"))
    assert more.sessions.count() == 4 and more.get("a").first().user_id == "u"


def test_history(spark):
    m = at(spark, [("s", i, "user", str(i)) for i in range(8)], "session_id string, turn long, role string, text string")
    last = lambda n: [r.turn for r in sessions.history(m, n).orderBy("turn").collect()]
    assert last(3) == [5, 6, 7] and last(0) == list(range(8)) == last(None) and last(-2) == [2, 3, 4, 5, 6, 7] and last(100) == list(range(8))
    assert sessions.chat_history(m).first().history == "\n".join(f"USER: {i}" for i in range(2, 8))
    assert sessions.history_counts(m, 100).first()[1:] == (8, 8) and sessions.history_counts(m, -3).first().returned == 5


def test_chat(spark):
    s, _ = store(spark)
    facts = at(spark, [("analysis", "Nowak"), ("analysis", "Adams")], "course string, teacher string")
    plan = retrieval.Plan(r"teaches (\w+)", facts, "course", ["teacher"], [F.col("teacher")], "who teaches {key}")
    asked = [("a", "u", "who teaches Analysis?", AT), ("b", "u", "tell a joke", AT), ("c", "v", "", AT), ("q", "v", "who teaches x", AT)]
    requests = at(spark, asked, "session_id string, user_id string, message string, at timestamp_ntz")
    after, answers = chat(s, requests, retrieval.keyword_guard("teaches"), plan)
    got = {r.session_id: (r.message, r.error) for r in answers.collect()}
    assert got["a"] == (retrieval.NO_MODEL + '[{"teacher":"Adams"},{"teacher":"Nowak"}]', None)
    assert got["b"] == (retrieval.REFUSAL, None) and got["c"][1] == "empty message" and got["q"][1] == "unknown session"
    assert {r.session_id: r.message_count for r in after.info().collect()} == {"a": 3, "b": 2, "c": 0}
    model = retrieval.model_answer("{history}|{user_input}|{data}", F.upper)
    rows = retrieval.answer_questions(at(spark, [(1, "who teaches nobody")], "qid long, question string"), retrieval.keyword_guard("teaches"), plan, final=model)
    assert rows.first().answer == "(NO PRIOR CONVERSATION)|WHO TEACHES NOBODY|[]"


def test_chat_without_a_session(spark):
    s, _ = store(spark)
    plan = retrieval.Plan(r"teaches (\w+)", at(spark, [("analysis", "Nowak")], "course string, teacher string"), "course", ["teacher"], [F.col("teacher")], "who teaches {key}")
    asked = [(None, "w", "who teaches Analysis?", AT), (None, "w", "who teaches Analysis?", AT), (None, "w", "", AT), ("a", "u", "tell a joke", AT)]
    requests = at(spark, asked, "session_id string, user_id string, message string, at timestamp_ntz")
    after, answers = chat(s, requests, retrieval.keyword_guard("teaches"), plan)
    got = answers.collect()
    made = {r.session_id for r in got} - {"a", None}
    answer = retrieval.NO_MODEL + '[{"teacher":"Nowak"}]'
    assert len(got) == 4 and len(made) == 2
    assert sorted(str(r.message or r.error) for r in got) == sorted([answer, answer, "empty message", retrieval.REFUSAL])
    assert {r.session_id: r.message_count for r in after.info().where("user_id = 'w'").collect()} == dict.fromkeys(made, 2)


def test_diagram():
    text = retrieval.mermaid(retrieval.STATES)
    assert text.splitlines()[0] == "graph TD" and "    guard -->|end| refuse" in text


def test_streams(spark, tmp_path):
    rows = [("u", AT), ("u", AT + dt.timedelta(minutes=10)), ("u", AT + dt.timedelta(hours=5))]
    at(spark, [(u, t, "x") for u, t in rows], "user_id string, ts timestamp, event_type string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id string, ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    q = live.activity(stream).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.message_count for r in spark.table("bursts").collect()) == [1, 2]
    q = live.counts_by_window(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 2]


def test_ingest_feedback(spark, tmp_path):
    """A stream that is started again goes on with the summary that it had."""
    seen = []

    def run(name):
        at(spark, [(f"page {name}",), ("  ",)], "text string").write.mode("append").parquet(f"{tmp_path}/pages")
        pages = spark.readStream.schema("text string").parquet(f"{tmp_path}/pages")
        live.ingest(pages, lambda df, summary: seen.append(summary) or df, lambda df, n: f"after {name}: {df.count()}", f"{tmp_path}/cp").awaitTermination()

    run("one")
    run("two")
    assert seen == ["", "after one: 1"]


def test_store_versions(spark, tmp_path):
    from loomgraph.sources.snapshots import read_store, write_store

    s, _ = store(spark)
    write_store(s, f"{tmp_path}/v1")
    back = read_store(spark, f"{tmp_path}/v1")
    assert back.stats().first() == s.stats().first() and back.sessions.columns == s.sessions.columns
    again = back.create(at(spark, [("d", "u", AT)], "session_id string, user_id string, at timestamp_ntz"))
    assert again.sessions.agg(F.max_by("session_id", "seq")).first()[0] == "d" and again.sessions.select("seq").distinct().count() == 4


def test_a_failing_retrieval_keeps_its_questions(spark):
    rows = at(spark, [("analysis", "Nowak")], "course string, teacher string").withColumn("teacher", F.raise_error(F.lit("gone")).cast("string"))
    plan = retrieval.Plan(r"teaches (\w+)", rows, "course", ["teacher"], [F.col("teacher")], "who teaches {key}")
    asked = at(spark, [(1, "who teaches analysis"), (2, "joke")], "qid long, question string")
    got = {r.qid: r for r in retrieval.answer_questions(asked, retrieval.keyword_guard("teaches"), retrieval.Guarded(plan)).collect()}
    assert got[1].error.startswith("Query failed: ") and got[1].context == "[]" and got[2].error is None
    assert got[1].metadata.query == got[1].error


def test_extraction(spark):
    from loomgraph.operators import merge
    from loomgraph.operators.graph import Graph
    from loomgraph.plans import extraction

    texts = [(1, "Nowak is a Professor. Analysis is a Course. Nowak TEACHES Analysis. Nowak TEACHES Nothing."), (2, "  "), (3, "no facts"), (4, None)]
    chunks = at(spark, texts, "doc_id long, text string")
    rows = {r.doc_id: r.statements for r in extraction.extracted(chunks).collect()}
    assert set(rows) == {1, 3} and rows[3] == "" and rows[1].endswith("|MERGE (nowak)-[:TEACHES]->(analysis)")
    batches = extraction.extracted(chunks).select(F.col("doc_id").alias("batch"), F.col("statements").alias("text"))
    g = merge.merge_batches(Graph(), merge.statement_rows(batches))
    assert g.all_nodes().count() == 2 and g.all_edges().count() == 1
    replies = extraction.extracted_by_model(chunks, "{schema_context}: {context}", lambda c: F.when(F.contains(c, F.lit("no facts")), F.lit(None).cast("string")).otherwise(F.lit(" a | |b")))
    assert {r.doc_id: r.statements for r in replies.collect()} == {1: "a|b", 3: ""}
    same, report = extraction.load_blocks(g, [lambda g: g, lambda g: 1 / 0, lambda g: g])
    assert all(same.nodes[k] is g.nodes[k] for k in g.nodes) and set(same.edges) == set(g.edges) and [r.split()[0] for r in report] == ["OK", "ERROR", "OK"]
    assert extraction.choose({"b": F.upper}, ("a", "b")) is F.upper and extraction.choose({}, ("a",)) is None
