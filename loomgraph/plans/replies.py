"""Replies of text models, kept by content: a prompt is put to a model once, and every later use reads the reply.

A model may cost much and answer differently each time. So its replies are a table, keyed by a digest of the model's name and the prompt:
new prompts are found by an anti join, each distinct one is called once, and what was written is joined by all that need it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.commits import Log, Manifest
from loomgraph.sources.scratch import discard, settled, written

REPLIES = "digest binary, model string, prompt string, reply string"
#: Folders of replies, one for each write, beyond which they are put together.
FOLDERS = 32


class Replies:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def table(self, manifest: Manifest | None = None) -> DataFrame:
        """All replies; a failed call's reply is null and doesn't count."""
        last = manifest or self.log.latest()
        folders = last.content["folders"] if last else []
        rows = self.spark.read.schema(REPLIES).parquet(*folders) if folders else self.spark.createDataFrame([], REPLIES)
        return rows.where("reply is not null")

    def ask(self, df: DataFrame, prompt: Column, name: str, call, alias: str = "reply") -> DataFrame:
        """df with a reply to each row's prompt: null for a null prompt, and where the call fails (gives null), which is tried again next
        time. df is evaluated once. call: from a column of prompts to a column of replies; it is evaluated once for each distinct prompt
        that has no reply yet, but for tasks that are run again after a failure, whose earlier replies nobody has seen.

        Two runs that ask the same at once may both call; the reply that is committed first is that of both.
        """
        key = F.unhex(F.sha2(F.concat(F.lit(f"{len(name)}:{name}:"), "asked_"), 256))
        asked = written(df.withColumn("asked_", prompt).withColumn("digest_", key), "asked")
        last = self.log.latest()
        new = asked.where("asked_ is not null").select(F.col("digest_").alias("digest"), F.col("asked_").alias("prompt")).dropDuplicates(["digest"])
        new = new.join(self.table(last).select("digest"), "digest", "left_anti")
        # written before any commit, so a lost race calls no model again
        called = written(new.select("digest", F.lit(name).alias("model"), "prompt", call(F.col("prompt")).alias("reply")), "called")
        given = last
        if not called.where("reply is not null").isEmpty():
            given = self._commit(called)
        discard(called)
        found = self.table(given).select(F.col("digest").alias("digest_"), F.col("reply").alias(alias))
        return asked.join(found, "digest_", "left").drop("digest_", "asked_")

    def _commit(self, called: DataFrame) -> Manifest:
        made: list[str] = []

        def make(last: Manifest | None) -> dict:
            if made:
                self.log.drop(made.pop())
            there = self.table(last).select("digest") if last else None
            rows = called.where("reply is not null")
            folders = list(last.content["folders"]) if last else []
            rows = rows.join(there, "digest", "left_anti") if folders else rows
            if len(folders) >= FOLDERS:
                rows, folders = self.table(last).unionByName(rows), []
            folder = self.log.new_folder("replies")
            rows.write.parquet(folder)
            made.append(folder)
            return {"folders": [*folders, folder]}

        return self.log.commit(make)


@dataclass(frozen=True)
class Model:
    """A model whose replies are kept. Its name says which model, and which version of it, gives them."""

    name: str
    call: object
    replies: Replies

    def __call__(self, prompt: Column) -> Column:
        raise TypeError("a model whose replies are kept is asked by ask()")


def ask(df: DataFrame, prompt: Column, model, alias: str) -> DataFrame:
    """df with a model's reply to each row's prompt. Of a plain function of columns an expression stays one; if it may give other replies
    when it is evaluated again (Python, random numbers), the rows are written once."""
    if isinstance(model, Model):
        return model.replies.ask(df, prompt, model.name, model.call, alias)
    return settled(df.withColumn(alias, model(prompt)), "replies")
