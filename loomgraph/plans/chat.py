"""A chat turn for many requests at once: session, question, history, retrieval, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.sessions import Store, chat_history, invalid_requests
from loomgraph.plans.retrieval import APOLOGY, Guarded, Plan, Plans, TextModel, answer_questions, no_model_answer
from loomgraph.sources.scratch import settled, written


def chat(store: Store, requests: DataFrame, guard: TextModel, plan: Plan | Plans | Guarded, final=no_model_answer) -> tuple[Store, DataFrame]:
    """requests: session_id, user_id, message, at; one for a session in a call. Sessions that are unknown under an id given with them are
    refused (error); a request without an id gets a session of its own, whose id is made up, unless its message is empty.

    Gives the store with both messages of each turn, and for each request: session_id, message (the answer), source, error.
    """
    checked = invalid_requests(requests, store.sessions)
    made = checked.where("error is null and session_id is null").withColumn("session_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
    made = written(made, "opened")  # ids are made up once
    store = store.create(made.select("session_id", "user_id", "at"))
    good = checked.where("error is null and session_id is not null").unionByName(made)
    store, _ = store.append(good.select("session_id", F.lit("user").alias("role"), F.col("message").alias("text"), "at"))
    past = chat_history(store.messages.join(good.select("session_id"), "session_id", "left_semi"))
    asked = good.select("session_id", "message", "at").join(past, "session_id", "left")
    answers = answer_questions(asked, guard, plan, qid="session_id", question="message", final=final, past="history")
    answers = answers.select("session_id", "at", F.when(F.col("error").isNotNull(), F.concat(F.lit(APOLOGY), "error")).otherwise(F.col("answer")).alias("message"), F.when(F.col("error").isNotNull(), F.lit("error")).otherwise(F.lit("knowledge_graph")).alias("source"), "error")
    answers = settled(answers, "answers")  # what is stored is what is sent
    store, _ = store.append(answers.select("session_id", F.lit("assistant").alias("role"), F.col("message").alias("text"), "at"))
    bad = checked.where("error is not null").select("session_id", "at", F.lit(None).cast("string").alias("message"), F.lit("error").alias("source"), "error")
    return store, answers.unionByName(bad).drop("at")
