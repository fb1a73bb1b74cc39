"""A session store as a log of changes: writes add rows, the latest row of a session wins, compaction puts them together by bucket.

Each commit adds a folder with the sessions it changed, the messages it took and the users it saw, by buckets of the session id. A
session's row carries how many turns it has, so an append reads the sessions of the touched buckets and no message. Readers get a Store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.sessions import ROLES, SESSIONS, Store
from loomgraph.sources.commits import Log, Manifest
from loomgraph.sources.scratch import discard, settled, written

#: n: the commit that wrote a row; since: the commit that created the session, before which messages belong to a deleted one of that id.
SESSION_ROWS = f"{SESSIONS}, turns long, deleted boolean, since long, n long, bucket int"
MESSAGE_ROWS = "session_id string, turn long, role string, text string, ts timestamp_ntz, n long, bucket int"
USER_ROWS = "user_id string"
#: Buckets of session ids; folders beyond which a write puts all together.
BUCKETS, FOLDERS = 64, 64


class SessionLog:
    """Of two writers at once one is first, and the other's change is made anew on what the first has written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.log, self.buckets = spark, Log(spark, path), buckets

    def _bucket(self, session_id: Column | str = "session_id") -> Column:
        return F.pmod(F.hash(session_id), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: Manifest | None, kind: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{f}/{kind}" for f in manifest.content["folders"]] if manifest else []
        if not folders:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f) for f in folders]
        out = parts[0]
        for df in parts[1:]:
            out = out.unionByName(df)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def _latest(self, manifest: Manifest | None, buckets: list[int] | None = None) -> DataFrame:
        """Each session's last row, tombstones too."""
        rows = self._rows(manifest, "sessions", SESSION_ROWS, buckets)
        names = [c for c in rows.columns if c != "session_id"]
        return rows.groupBy("session_id").agg(F.max_by(F.struct(*names), "n").alias("row")).select("session_id", "row.*")

    def store(self, version: int | None = None) -> Store:
        """What the log holds, as tables; of a version, or of the latest."""
        manifest = self.log.latest() if version is None else self.log.read(version)
        live = self._latest(manifest).where("not deleted")
        said = self._rows(manifest, "messages", MESSAGE_ROWS).join(live.select("session_id", "since"), "session_id").where("n >= since")
        return Store(live.select("session_id", "user_id", "created_at", "updated_at", "is_active", "seq"), said.select("session_id", "turn", "role", "text", "ts"), self._rows(manifest, "users", USER_ROWS).distinct())

    def _commit(self, ids: DataFrame, change: Callable[[DataFrame, int], tuple[DataFrame, DataFrame | None]]) -> int:
        """ids: a column session_id. change: from the latest rows of the touched buckets and the commit's number to the changed session rows
        and new messages."""
        touched = sorted(r[0] for r in ids.select(self._bucket()).distinct().collect())  # BUCKETS numbers at most

        def make(last: Manifest | None, folder: str) -> list[str]:
            n = (last.version if last else 0) + 1
            sessions, messages = change(self._latest(last, touched), n)
            kept = list(last.content["folders"]) if last else []
            self._write(folder, sessions.withColumns({"n": F.lit(n).cast("long"), "bucket": self._bucket()}), messages.withColumns({"n": F.lit(n).cast("long"), "bucket": self._bucket()}) if messages is not None else None, sessions.select("user_id"))
            return [*kept, folder]

        version = self._claimed(make)
        if len(self.log.read(version).content["folders"]) > FOLDERS:
            version = self.compact()
        return version

    def _claimed(self, make: Callable[[Manifest | None, str], list[str]]) -> int:
        made: list[str] = []

        def content(last: Manifest | None) -> dict:
            if made:  # another writer was faster
                self.log.drop(made.pop())
            made.append(self.log.new_folder("sessions"))
            return {"folders": make(last, made[0])}

        return self.log.commit(content).version

    def _write(self, folder: str, sessions: DataFrame, messages: DataFrame | None, users: DataFrame) -> None:
        for df, kind, schema in ((sessions, "sessions", SESSION_ROWS), (messages, "messages", MESSAGE_ROWS)):
            df = self.spark.createDataFrame([], schema) if df is None else df
            df.select(*(x.split()[0] for x in schema.split(", "))).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{kind}")
        users.where("user_id is not null").distinct().write.parquet(f"{folder}/users")

    # writes

    def create(self, new: DataFrame) -> int:
        """new: session_id, user_id, at; an id is made up where it is null. Sessions that exist stay as they are; gives the version."""
        ids = F.coalesce("session_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
        rows = written(new.withColumn("session_id", ids).groupBy("session_id").agg(F.min_by(F.struct("user_id", "at"), F.struct("at", "user_id")).alias("row")).select("session_id", "row.*"), "created")

        def change(latest: DataFrame, n: int) -> tuple[DataFrame, None]:
            fresh = rows.join(latest.where("not deleted").select("session_id"), "session_id", "left_anti")
            at, none = F.col("at"), F.lit(0).cast("long")
            number = F.lit(n << 40) + F.monotonically_increasing_id()  # later commits come later, and a commit has its own order
            return fresh.select("session_id", "user_id", at.alias("created_at"), at.alias("updated_at"), F.lit(True).alias("is_active"), number.alias("seq"), none.alias("turns"), F.lit(False).alias("deleted"), F.lit(n).cast("long").alias("since")), None

        version = self._commit(rows, change)
        discard(rows)
        return version

    def append(self, new: DataFrame) -> int:
        """new: session_id, role, text, at. Rows that no session takes, or whose role is unknown, go. No message is read."""
        rows = settled(new.where(F.col("role").isin(*ROLES)), "appended")

        def change(latest: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
            live = latest.where("not deleted").drop("n", "bucket")
            turn = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "role", "text"))
            said = rows.withColumn("k", turn).join(live.select("session_id", "turns"), "session_id")
            more = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("more"), F.max("at").alias("at"))
            changed = live.join(more, "session_id").withColumns({"turns": F.col("turns") + F.col("more"), "updated_at": F.greatest("updated_at", "at")}).drop("more", "at")
            return changed, said.select("session_id", (F.col("turns") + F.col("k") - 1).alias("turn"), "role", "text", F.col("at").alias("ts"))

        return self._commit(rows, change)

    def deactivate(self, ids: DataFrame) -> int:
        """ids: session_id, at."""
        latest_at = ids.groupBy("session_id").agg(F.max("at").alias("at"))

        def change(latest: DataFrame, n: int) -> tuple[DataFrame, None]:
            rows = latest.where("not deleted").drop("n", "bucket").join(latest_at, "session_id")
            return rows.withColumns({"updated_at": F.greatest("updated_at", "at"), "is_active": F.lit(False)}).drop("at"), None

        return self._commit(ids, change)

    def delete(self, ids: DataFrame) -> int:
        """Sessions and their messages go; their users stay known."""
        gone = ids.select("session_id").distinct()

        def change(latest: DataFrame, n: int) -> tuple[DataFrame, None]:
            return latest.where("not deleted").drop("n", "bucket").join(gone, "session_id", "left_semi").withColumn("deleted", F.lit(True)), None

        return self._commit(ids, change)

    def compact(self) -> int:
        """One folder with each session's last row and the messages that count; deleted sessions' rows go."""

        def make(last: Manifest | None, folder: str) -> list[str]:
            live = self._latest(last).where("not deleted")
            said = self._rows(last, "messages", MESSAGE_ROWS).join(live.select("session_id", "since"), "session_id").where("n >= since").drop("since")
            self._write(folder, live, said, self._rows(last, "users", USER_ROWS))
            return [folder]

        return self._claimed(make)
