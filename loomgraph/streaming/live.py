"""Structured Streaming: live session activity, message counts, and ingest by micro-batches with feedback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import is_blank


SUMMARY = "batch long, summary string"


def activity(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """messages: user_id and ts. A user's bursts of messages, closed by a gap; messages later than the watermark are left out."""
    return messages.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("message_count")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "message_count")


def counts_by_window(messages: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Messages of each type in windows of time."""
    return messages.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def ingest(pages: DataFrame, extract: Callable[[DataFrame, str], DataFrame], publish: Callable[[DataFrame, int], str], checkpoint: str):
    """Pages in micro-batches: extract(pages, schema summary) gives statements; publish(statements, batch) writes them and returns the
    summary that the next batch sees. Blank pages are left out, and a batch without any keeps the summary.

    Summaries are kept beside the checkpoint, one for each batch, so a stream that is started again goes on with the last one; a batch
    that is run again sees that of the batch before it. A stop between publishing and keeping the summary runs the batch again, too: so
    publish takes the batch's number, with which a History finds that it has been written (sources.history).
    """
    spark, kept = pages.sparkSession, f"{checkpoint.rstrip('/')}-summaries"
    spark.createDataFrame([], SUMMARY).write.mode("append").parquet(kept)

    def each(batch: DataFrame, number: int) -> None:
        full = batch.where(~is_blank("text"))
        if not full.isEmpty():
            last = spark.read.schema(SUMMARY).parquet(kept).where(F.col("batch") < number).orderBy(F.desc("batch")).first()
            summary = publish(extract(full, last.summary if last else ""), number)
            spark.createDataFrame([(number, summary)], SUMMARY).coalesce(1).write.mode("append").parquet(kept)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
