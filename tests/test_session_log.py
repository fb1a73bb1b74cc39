from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from loomgraph.operators.sessions import Store
from loomgraph.sources.session_log import SessionLog
from loomgraph.streaming import sessions as live

AT = dt.datetime(2024, 1, 1)
NEW, SAID, GONE = "session_id string, user_id string, at timestamp_ntz", "session_id string, role string, text string, at timestamp_ntz", "session_id string, at timestamp_ntz"


def day(n):
    return AT + dt.timedelta(n)


def rows(store):
    return (
        sorted(tuple(r) for r in store.sessions.drop("seq").collect()),
        sorted(tuple(r) for r in store.messages.collect()),
        sorted(r.user_id for r in store.users.collect()),
    )


CREATED = [(f"s{i}", f"u{i % 3}", day(i)) for i in range(9)] + [("s0", "another", day(9))]
APPENDED = [
    [(f"s{i}", "user", f"hi {i}", day(10)) for i in range(6)] + [("nobody", "user", "lost", day(1)), ("s1", "robot", "no role", day(1)), ("s1", "assistant", "first", day(9))],
    [("s1", "user", "again", day(20)), ("s1", "user", "again", day(20)), ("s8", "system", "late", day(3))],
]


def filled(spark, target):
    """The same writes to a log or a store, which each give their own successor."""
    frame = spark.createDataFrame
    steps = [("create", frame(CREATED, NEW)), *(("append", frame(a, SAID)) for a in APPENDED), ("deactivate", frame([("s2", day(30)), ("nobody", day(1))], GONE)), ("delete", frame([("s3",), ("s4",)], "session_id string"))]
    steps += [("create", frame([("s3", "u9", day(40))], NEW)), ("append", frame([("s3", "user", "new life", day(41))], SAID))]
    for name, df in steps:
        out = getattr(target, name)(df)
        if isinstance(target, Store):
            target = out[0] if isinstance(out, tuple) else out
    return target


def test_equals_store_before_and_after_compaction(spark, tmp_path):
    log = filled(spark, SessionLog(spark, f"file://{tmp_path}/log", buckets=4))
    want = rows(filled(spark, Store.empty(spark)))
    assert rows(log.store()) == want
    before = log.log.latest().version
    log.compact()
    assert rows(log.store()) == want == rows(log.store(before))
    assert len(log.log.latest().content["folders"]) == 1
    log.append(spark.createDataFrame([("s1", "user", "after", day(50))], SAID))
    assert [r.turn for r in log.store().messages.where("text = 'after'").collect()] == [4]
    order = [r.session_id for r in log.store().sessions.orderBy("seq").collect()]
    assert order[-1] == "s3" and set(order[:-1]) == {"s0", "s1", "s2", "s5", "s6", "s7", "s8"}


def test_an_append_reads_no_messages(spark, tmp_path):
    """It works while all messages are out of reach."""
    log = filled(spark, SessionLog(spark, f"file://{tmp_path}/log", buckets=4))
    held = []
    for folder in log.log.latest().content["folders"]:
        at = folder.removeprefix("file://") + "/messages"
        os.rename(at, at + "-away")
        held.append(at)
    log.append(spark.createDataFrame([("s1", "user", "blind", day(60))], SAID))
    for at in held:
        os.rename(at + "-away", at)
    assert [r.turn for r in log.store().messages.where("text = 'blind'").collect()] == [4]


def test_only_touched_buckets_are_read(spark, tmp_path):
    log = SessionLog(spark, f"file://{tmp_path}/log", buckets=8)
    log.create(spark.createDataFrame(CREATED, NEW))
    last = log.log.latest()
    files = log._rows(last, "sessions", "session_id string, bucket int", [3]).inputFiles()
    plan = log._latest(last, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80] and files


def test_two_writers(spark, tmp_path):
    """A writer who was slower numbers its turns after what the first has written."""
    log = SessionLog(spark, f"file://{tmp_path}/log", buckets=4)
    log.create(spark.createDataFrame([("a", "u", AT)], NEW))
    inner, raced = log._latest, []

    def latest(manifest, buckets=None):
        if not raced:
            raced.append(1)
            SessionLog(spark, f"file://{tmp_path}/log", buckets=4).append(spark.createDataFrame([("a", "user", "first", day(1))], SAID))
        return inner(manifest, buckets)

    log._latest = latest
    log.append(spark.createDataFrame([("a", "user", "second", day(1))], SAID))
    assert sorted((r.turn, r.text) for r in log.store().messages.collect()) == [(0, "first"), (1, "second")]


def test_folders_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("loomgraph.sources.session_log.FOLDERS", 2)
    log = SessionLog(spark, f"file://{tmp_path}/log", buckets=2)
    log.create(spark.createDataFrame([("a", "u", AT)], NEW))
    for k in range(3):
        log.append(spark.createDataFrame([("a", "user", f"m{k}", day(k))], SAID))
    assert len(log.log.latest().content["folders"]) <= 2
    assert [r.text for r in log.store().messages.orderBy("turn").collect()] == ["m0", "m1", "m2"]


def test_empty_log(spark, tmp_path):
    log = SessionLog(spark, f"file://{tmp_path}/log")
    assert rows(log.store()) == ([], [], [])
    log.append(spark.createDataFrame([], SAID))
    assert rows(log.store()) == ([], [], [])


def test_live_sessions_equal_the_store_over_a_restart(spark, tmp_path):
    """The same events in a stream, stopped and started again between batches, and in a store."""
    into, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    batches = [
        [(s, "create", u, None, at) for s, u, at in CREATED],
        [(s, "append", None, role, at) for s, role, _, at in APPENDED[0]] + [(None, "append", None, "user", AT), ("s1", "unknown", None, None, AT), ("s1", "append", None, "user", None)],
        [(s, "append", None, role, at) for s, role, _, at in APPENDED[1]] + [("s2", "deactivate", None, None, day(30)), ("s2", "append", None, "user", day(31))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, live.EVENTS).coalesce(1).write.mode("append").parquet(into)
        stream = spark.readStream.schema(live.EVENTS).option("maxFilesPerTrigger", 1).parquet(into)
        live.keep(live.live_sessions(stream), out, checkpoint).awaitTermination()
    frame, store = spark.createDataFrame, Store.empty(spark).create(spark.createDataFrame(CREATED, NEW))
    store = store.append(frame(APPENDED[0], SAID))[0].append(frame(APPENDED[1], SAID))[0].deactivate(frame([("s2", day(30))], GONE))
    store = store.append(frame([("s2", "user", "x", day(31))], SAID))[0]
    want = sorted(tuple(r) for r in store.info().select("session_id", "user_id", "created_at", "updated_at", "is_active", "message_count").collect())
    found = live.kept(spark, out).select("session_id", "user_id", F.col("created_at").cast("timestamp_ntz"), F.col("updated_at").cast("timestamp_ntz"), "is_active", "message_count")
    assert sorted(tuple(r) for r in found.collect()) == want


def test_idle_sessions_expire(spark, tmp_path):
    """By the next event, and by the watermark alone."""
    into, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    batches = [[("a", "create", "u", None, day(0)), ("b", "create", "u", None, day(0)), ("c", "create", "u", None, day(0))], [("a", "append", None, "user", day(1)), ("b", "append", None, "user", day(9))], [("c", "append", None, "user", day(10)), ("d", "create", "u", None, day(10))]]
    for batch in batches:
        spark.createDataFrame(batch, live.EVENTS).coalesce(1).write.mode("append").parquet(into)
        live.keep(live.live_sessions(spark.readStream.schema(live.EVENTS).parquet(into), "3 days"), out, checkpoint).awaitTermination()
    assert {r.session_id: (r.is_active, r.message_count) for r in live.kept(spark, out).collect()} == {"a": (False, 1), "b": (False, 1), "c": (False, 1), "d": (True, 0)}


class Noted:
    """A session's state and timers, as Spark's handle gives them; notes the calls, each of which is a message to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_few_calls_of_state_give_what_events_one_by_one_do():
    draw, idle = random.Random(5), 40
    for _ in range(300):
        session, noted, plain = live._Session(idle), Noted(), None
        session.init(noted)
        for _ in range(4):
            events = [(draw.randrange(90) * 1000, draw.choice((0, 1, 1, 1, 2) if draw.random() < 0.2 else (1, 1, 0, None)), draw.choice(("u", "v", None))) for _ in range(draw.randrange(6))]
            noted.calls, before = 0, plain
            out = list(session.handleInputRows(("s",), iter([Row(session_id="s", micros=m, turn=t, user_id=u) for m, t, u in events]), None))
            for m, t, u in sorted((e for e in events if e[1] is not None), key=lambda e: (e[0], e[1], e[2] is None, e[2] or "")):
                if plain is None:
                    plain = (u, m, m, True, 0, 1) if t == 0 else None
                elif t:
                    user, created, updated, active, messages, changes = plain
                    plain = (user, created, max(updated, m), active and t != 2 and m - updated <= idle * 1000, messages + (t == 1), changes + 1)
            assert noted.value == plain and noted.calls <= 4
            assert [tuple(r)[1:] for r in out] == ([plain] if plain != before else [])
            assert noted.timers == ({plain[2] // 1000 + idle + 1} if plain and plain[3] else set())
