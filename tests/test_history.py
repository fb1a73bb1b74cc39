from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import merge
from loomgraph.operators.graph import Graph
from loomgraph.sources.commits import Conflict, Log, Manifest
from loomgraph.sources.history import History
from loomgraph.streaming import live


def adding(spark, *titles):
    batch = spark.createDataFrame([(t, "") for t in titles], "title string, context string")
    return lambda g: merge.merge_nodes(g, "Thing", batch)


def titles(graph):
    return sorted(r.title for r in graph.all_nodes().collect())


def test_a_number_is_claimed_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log one")
    assert log.latest() is None
    log.claim(Manifest(1, 0, {"a": "ü"}))
    with pytest.raises(Conflict):
        log.claim(Manifest(1, 0, {"a": "other"}))
    assert log.latest() == Manifest(1, 0, {"a": "ü"})
    with pytest.raises(ValueError):
        log.read(2)


def test_a_rename_doesnt_replace(spark, tmp_path):
    """The way of other file systems than local ones."""
    log = Log(spark, f"file://{tmp_path}")
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    log._rename(log._at("a"), log._at("target"), 1)
    with pytest.raises(Conflict):
        log._rename(log._at("b"), log._at("target"), 1)
    assert (tmp_path / "target").read_text() == "a"


def test_many_writers_at_once(spark, tmp_path):
    """Each writer starts from what it sees; none of their changes is lost or doubled."""
    log, done = Log(spark, f"file://{tmp_path}"), []

    def write(k):
        done.append(log.commit(lambda last: {"all": [*(last.content["all"] if last else []), k]}).version)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == list(range(1, 13)) and sorted(log.latest().content["all"]) == list(range(12))


def test_two_writers_of_one_version(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}")
    assert history.version() == 0 and titles(history.read()) == []
    history.commit(adding(spark, "a", "b"))
    other = []

    def slow(g):
        if not other:
            other.append(history.commit(adding(spark, "b", "c")))
        return adding(spark, "c", "d")(g)

    assert history.commit(slow) == 3 and other == [2]
    assert titles(history.read()) == ["a", "b", "c", "d"] and titles(history.read(1)) == ["a", "b"]
    assert len(list((tmp_path / "data").iterdir())) == 3  # the writer who was slower has removed what it wrote first


def test_batches_are_published_once(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}")
    assert [history.commit(adding(spark, f"t{k}"), ("s", k)) for k in (0, 0, 1, 0, 4, 4)] == [1, 1, 2, 1, 3, 3]
    assert history.commit(adding(spark, "other"), ("another stream", 0)) == 4
    assert history.commit(adding(spark, "x"), ("s", 4)) == 3
    assert titles(history.read()) == ["other", "t0", "t1", "t4"]
    with pytest.raises(ValueError):
        history.commit(adding(spark, "x"), ("s", 2))


def test_a_failing_change_leaves_no_version(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}")
    history.commit(adding(spark, "a"))
    with pytest.raises(Exception, match="on fire"):
        history.commit(lambda g: merge.merge_nodes(g, "Bad", spark.range(1).select(F.raise_error(F.lit("on fire")).cast("string").alias("title"), F.lit("").alias("context"))))
    assert history.version() == 1 and history.commit(adding(spark, "b")) == 2


@pytest.mark.parametrize("stop", ["before publishing", "after publishing"])
def test_a_stream_stopped_around_publishing(spark, tmp_path, stop):
    """The batch is run again after a restart, and every row is there once."""
    pages, history, stopped = f"{tmp_path}/pages", History(spark, f"file://{tmp_path}/history"), []
    for k in range(3):
        spark.createDataFrame([(k, f"page {k}")], "doc_id int, text string").coalesce(1).write.mode("append").parquet(pages)

    def publish(rows, number):
        if stop == "before publishing" and number == 1 and not stopped:
            stopped.append(1)
            raise RuntimeError("stopped")
        history.commit(lambda g: merge.merge_nodes(g, "Page", rows.select(F.col("text").alias("title"), F.uuid().alias("context"))), ("pages", number))
        if stop == "after publishing" and number == 1 and not stopped:
            stopped.append(1)
            raise RuntimeError("stopped")
        return f"summary {number}"

    seen = []

    def extract(batch, summary):
        seen.append(summary)
        return batch

    def run():
        stream = spark.readStream.schema("doc_id int, text string").option("maxFilesPerTrigger", 1).parquet(pages)
        live.ingest(stream, extract, publish, f"file://{tmp_path}/checkpoint").awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        run()
    run()
    assert titles(history.read()) == ["page 0", "page 1", "page 2"] and history.version() == 3
    assert seen == ["", "summary 0", "summary 0", "summary 1"]


def test_empty_graph_and_identities(spark):
    batch = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc"), (None, ""), ("\x00", ""), ("", None), ("", "\x00"), ("\x1bn", ""), ("a", "\x1bsb")], "title string, context string")
    g = merge.merge_nodes(merge.merge_nodes(Graph(), "A", batch), "A\x1fa", batch)
    ids = [r.id for r in g.all_nodes().collect()]
    assert len(ids) == len(set(ids)) == 16
