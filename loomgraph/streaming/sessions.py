"""Live sessions by keyed state: create, append, deactivate, and expiry by timers, as Store has them for tables.

A session's state is a few numbers, whatever its length: who opened it and when, when it was changed last, whether it is active, and how
many messages and changes there were. Spark keeps it by session, saves it with each batch, and goes on from there after a restart.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.sessions import ROLES

#: kind: create, append or deactivate.
EVENTS = "session_id string, kind string, user_id string, role string, at timestamp"
#: Times are microseconds since 1970, which no time zone moves.
STATE = "user_id string, created_at long, updated_at long, is_active boolean, messages long, changes long"
CHANGES = "session_id string, user_id string, created_at timestamp, updated_at timestamp, is_active boolean, message_count long, changes long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = CHANGES.replace("timestamp", "long")
_APPEND, _DEACTIVATE = 1, 2


class _Session(StatefulProcessor):
    """One row out for each batch that changes a session: the session as it is then."""

    def __init__(self, idle_ms: int | None):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # every call of the state's or the timers' is a message to the JVM, so there are as few as can be
        held = self.state.get()
        user, created, updated, active, messages, changes = held or (None, None, None, True, 0, 0)
        timer = self._timer(updated) if held and active else None
        # a batch's rows come in no order; only kinds and times are held, which are few bytes a row
        times, turns, opening = array("q"), array("b"), None
        for r in rows:
            if r.turn is None or r.micros is None:
                continue
            if r.turn:
                times.append(r.micros)
                turns.append(r.turn)
            elif created is None:  # the earliest create opens it; of those at one time the first user
                who = (r.micros, r.user_id is None, r.user_id or "")
                opening = who if opening is None or who < opening else opening
        if created is None:
            if opening is None:
                return  # no session takes it
            created = updated = opening[0]
            user, changes = None if opening[1] else opening[2], 1
        at, turn = np.frombuffer(times, np.int64), np.frombuffer(turns, np.int8)
        if held is None:
            at, turn = at[at >= created], turn[at >= created]
        elif not len(at):
            return  # creates of a session that exists
        if len(at):
            latest = np.maximum.accumulate(np.concatenate(([updated], np.sort(at))))
            idle = self.idle is not None and bool((np.diff(latest) > self.idle * 1000).any())
            active = bool(active and not idle and not (turn == _DEACTIVATE).any())
            messages, updated, changes = messages + int((turn == _APPEND).sum()), int(latest[-1]), changes + len(at)
        self.state.update((user, created, updated, active, messages, changes))
        new = self._timer(updated) if active else None
        if timer != new:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if new is not None:
                self.handle.registerTimer(new)
        yield Row(session_id=key[0], user_id=user, created_at=created, updated_at=updated, is_active=active, message_count=messages, changes=changes)

    def _timer(self, updated: int) -> int | None:
        """When a session that was changed last then is idle; an active session has this timer and no other, an inactive one has none."""
        return None if self.idle is None else updated // 1000 + self.idle + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Nothing has come for too long."""
        user, created, updated, active, messages, changes = self.state.get()
        if active:
            self.state.update((user, created, updated, False, messages, changes + 1))
            yield Row(session_id=key[0], user_id=user, created_at=created, updated_at=updated, is_active=False, message_count=messages, changes=changes + 1)

    def close(self) -> None:
        pass


def live_sessions(events: DataFrame, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """events: a stream of EVENTS. Each session that a batch changes, as it is after it.

    As in Store, the first create opens a session and later ones change nothing; messages to no session, or of unknown roles, go; a
    deactivated session stays so, but still takes messages. A session without change for longer than idle (such as 3 days) is inactive
    from then on, as soon as the next change or the watermark shows it; the watermark is the latest time less late. Events of a batch
    are taken by time, then create, append, deactivate. Rows without a session, a time or a known kind go. A session's events of one
    batch are held together as three short columns: let batches be bounded (maxFilesPerTrigger) where one session may have very many.
    """
    rows = events.where("session_id is not null").withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    # rows that go stay in until they are read, as the watermark is theirs, too
    turn = F.when(F.col("kind") == "create", 0).when((F.col("kind") == "append") & F.col("role").isin(*ROLES), _APPEND).when(F.col("kind") == "deactivate", _DEACTIVATE)
    rows = rows.select("session_id", "at", "micros", turn.cast("int").alias("turn"), F.when(turn == 0, F.col("user_id")).alias("user_id"))
    gap = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    mode = "none" if idle is None else "eventTime"
    return rows.groupBy("session_id").transformWithState(_Session(gap), _OUT, "update", mode).withColumns({c: F.timestamp_micros(c) for c in ("created_at", "updated_at")})


def keep(changes: DataFrame, path: str, checkpoint: str):
    """Writes a stream's changes below path, a folder for each batch; a batch that is run again writes its own folder anew. Keyed state needs
    Spark's RocksDB store, which is set for this stream only."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf, name = changes.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)
    try:
        return changes.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The sessions as they are after the last batch: of each, the row with most changes."""
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(path)
    latest = Window.partitionBy("session_id").orderBy(F.desc("changes"), F.desc("batch"))
    return rows.withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k", "batch")
