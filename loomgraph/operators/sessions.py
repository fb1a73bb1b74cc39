"""Conversation sessions as three tables: sessions, messages, users. Writes give a new store; reads give DataFrames.

sessions: session_id, user_id, created_at, updated_at, is_active, seq. messages: session_id, turn, role, text, ts. users: user_id,
which stays when a user's last session is deleted. Times are UTC without a zone. A session without messages counts as one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSIONS = "session_id string, user_id string, created_at timestamp_ntz, updated_at timestamp_ntz, is_active boolean, seq long"
MESSAGES = "session_id string, turn long, role string, text string, ts timestamp_ntz"
ROLES = ("user", "assistant", "system")


def _one(c: Column) -> Column:
    return F.count(F.when(c, 1))


@dataclass(frozen=True)
class Store:
    sessions: DataFrame
    messages: DataFrame
    users: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        return Store(spark.createDataFrame([], SESSIONS), spark.createDataFrame([], MESSAGES), spark.createDataFrame([], "user_id string"))

    # writes

    def create(self, new: DataFrame) -> Store:
        """new: session_id, user_id, at; an id is made up where it is null. Sessions that exist already stay as they are."""
        ids = F.coalesce("session_id", F.replace(F.uuid(), F.lit("-"), F.lit("")))
        after = self.sessions.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("after"))
        rows = new.withColumn("session_id", ids).dropDuplicates(["session_id"]).join(self.sessions.select("session_id"), "session_id", "left_anti").crossJoin(after)
        rows = rows.select("session_id", "user_id", F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.lit(True).alias("is_active"), (F.col("after") + 1 + F.monotonically_increasing_id()).alias("seq"))
        users = self.users.union(rows.select("user_id")).distinct()
        return replace(self, sessions=self.sessions.unionByName(rows), users=users)

    def append(self, new: DataFrame) -> tuple[Store, DataFrame]:
        """new: session_id, role, text, at. Also gives the rows that no session takes, or whose role is unknown."""
        known = new.join(self.sessions.select("session_id"), "session_id", "left_semi").where(F.col("role").isin(*ROLES))
        last = self.messages.groupBy("session_id").agg(F.max("turn").alias("last"))
        turn = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "role", "text"))
        rows = known.withColumn("k", turn).join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(-1)) + F.col("k")).alias("turn"), "role", "text", F.col("at").alias("ts"))
        lost = new.join(self.sessions.select("session_id"), "session_id", "left_anti").unionByName(new.join(self.sessions.select("session_id"), "session_id", "left_semi").where(~F.col("role").isin(*ROLES)))
        return replace(self._touched(known.select("session_id", "at")), messages=self.messages.unionByName(rows)), lost

    def _touched(self, at: DataFrame, active: Column | None = None) -> Store:
        latest = at.groupBy("session_id").agg(F.max("at").alias("at"))
        rows = self.sessions.join(latest, "session_id", "left")
        kept = F.col("is_active") if active is None else F.when(F.col("at").isNotNull(), active).otherwise(F.col("is_active"))
        return replace(self, sessions=rows.select("session_id", "user_id", "created_at", F.greatest("updated_at", "at").alias("updated_at"), kept.alias("is_active"), "seq"))

    def deactivate(self, ids: DataFrame) -> Store:
        """ids: session_id, at."""
        return self._touched(ids.select("session_id", "at"), F.lit(False))

    def delete(self, ids: DataFrame) -> Store:
        """Sessions and their messages go; their users stay known."""
        gone = ids.select("session_id").distinct()
        return replace(self, sessions=self.sessions.join(gone, "session_id", "left_anti"), messages=self.messages.join(gone, "session_id", "left_anti"))

    def clear(self) -> tuple[Store, int]:
        return Store(self.sessions.limit(0), self.messages.limit(0), self.users.limit(0)), self.sessions.count()

    # reads

    def get(self, session_id: str) -> DataFrame:
        return self.sessions.where(F.col("session_id") == session_id)

    def info(self) -> DataFrame:
        counts = self.messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))
        return self.sessions.join(counts, "session_id", "left").select("session_id", "user_id", F.coalesce("message_count", F.lit(0)).alias("message_count"), "created_at", "updated_at", "is_active")

    def of_user(self, user_id: str | None = None, active_only: bool = True) -> DataFrame:
        """A user's sessions, or everybody's, in the order of creation."""
        rows = self.sessions if user_id is None else self.sessions.where(F.col("user_id") == user_id)
        return (rows.where("is_active") if active_only else rows).orderBy("user_id", "created_at", "seq")

    def session_counts(self, active_only: bool = True) -> DataFrame:
        rows = self.sessions.where("is_active") if active_only else self.sessions
        counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("session_count"))
        return self.users.join(counts, "user_id", "left").select("user_id", F.coalesce("session_count", F.lit(0)).alias("session_count"))

    def latest_active(self) -> DataFrame:
        """Each user's active session that was updated last; of ties, the first created."""
        order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.asc("created_at"), F.asc("seq"))
        return self.sessions.where("is_active").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")

    def stats(self) -> DataFrame:
        own = self.sessions.agg(F.count(F.lit(1)).alias("total_sessions"), _one(F.col("is_active")).alias("active_sessions"), _one(~F.col("is_active")).alias("inactive_sessions"))
        total = self.messages.agg(F.count(F.lit(1)).alias("total_messages"))
        users = self.users.agg(F.countDistinct("user_id").alias("unique_users"))
        ratio = F.when(F.col("total_sessions") > 0, F.col("total_messages") / F.col("total_sessions")).otherwise(F.lit(0.0))
        return own.crossJoin(total).crossJoin(users).withColumn("avg_messages_per_session", ratio)


def history(messages: DataFrame, n: int | None = None, key: str = "session_id") -> DataFrame:
    """The last n messages of each session; none or 0 is all, and a negative n leaves out the first ones."""
    if not n:
        return messages
    if n > 0:
        order = Window.partitionBy(key).orderBy(F.desc("turn"))
        return messages.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")
    order = Window.partitionBy(key).orderBy(F.asc("turn"))
    return messages.withColumn("k", F.row_number().over(order)).where(F.col("k") > -n).drop("k")


def transcript(messages: DataFrame, n: int | None, key: str = "session_id", upper: bool = False, alias: str = "history") -> DataFrame:
    """The last n messages of each session as lines of role and text."""
    role = F.upper("role") if upper else F.col("role")
    line = F.concat(role, F.lit(": "), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn"), line.alias("line"))))
    return history(messages, n, key).groupBy(key).agg(F.array_join(F.transform(ordered, lambda m: m["line"]), "\n").alias(alias))


def context_window(messages: DataFrame, key: str = "session_id") -> DataFrame:
    return transcript(messages, 10, key, alias="context")


def chat_history(messages: DataFrame, key: str = "session_id") -> DataFrame:
    """Six messages, with the question that was just added."""
    return transcript(messages, 6, key, upper=True)


def history_counts(messages: DataFrame, n: int | None, key: str = "session_id") -> DataFrame:
    """How many messages a history of n gives, and how many there are; no message is ranked for it."""
    total = F.count(F.lit(1))
    given = total if not n else F.least(total, F.lit(n)) if n > 0 else F.greatest(total + n, F.lit(0))
    return messages.groupBy(key).agg(given.cast("long").alias("returned"), total.alias("total_messages"))


def invalid_requests(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """requests: session_id (may be null), message. Why each fails, or null."""
    known = sessions.select(F.col("session_id").alias("known_id")).distinct()
    rows = requests.join(known, F.col("session_id") == F.col("known_id"), "left")
    reason = F.when(F.coalesce(F.length("message"), F.lit(0)) < 1, "empty message").when(F.col("session_id").isNotNull() & F.col("known_id").isNull(), "unknown session")
    return rows.withColumn("error", reason).drop("known_id")
