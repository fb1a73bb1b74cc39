"""Indexes of node titles: by trigrams for parts of titles, and by deletions for titles within one or two edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import ascii_fold, trim_all
from loomgraph.operators.graph import Graph

GRAM, BUCKETS, MOST_EDITS = 3, 64, 2


def _grams(text: Column) -> Column:
    """The distinct runs of three characters."""
    n = F.char_length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class Trigrams:
    """Which nodes' titles hold which trigrams, in lower case: posting rows in buckets of the trigram, below a path.

    A pattern reads the buckets of its own trigrams; nodes that have them all are candidates, whose titles are then compared. Patterns of
    fewer than three characters have no trigram and are looked for in all titles.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, nodes: DataFrame) -> None:
        """nodes: id and title; those without a title are in no index. Written once; titles are kept beside the postings, by bucket of id."""
        own = nodes.where("title is not null").select("id", "title")
        own.withColumn("bucket", _bucket("id", self.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/titles")
        rows = own.select("id", F.explode(_grams(F.lower("title"))).alias("gram"))
        # rows of a frequent trigram are dealt over files by their ids, and sorted, so a file's statistics name few trigrams
        rows = rows.withColumns({"bucket": _bucket("gram", self.buckets), "part": F.pmod(F.xxhash64("id"), F.lit(4))})
        rows.repartition("bucket", "part").sortWithinPartitions("bucket", "gram").drop("part").write.partitionBy("bucket").parquet(f"{self.path}/grams")

    def postings(self, grams: list[str]) -> DataFrame:
        at = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket("gram", self.buckets)).distinct()
        wanted = sorted(r[0] for r in at.collect())  # of one pattern's trigrams
        rows = self.spark.read.schema("id string, gram string, bucket int").parquet(f"{self.path}/grams")
        return rows.where(F.col("bucket").isin(wanted) & F.col("gram").isin(grams)).select("id", "gram")

    def titles(self) -> DataFrame:
        return self.spark.read.schema("id string, title string, bucket int").parquet(f"{self.path}/titles")

    def contains(self, pattern: str) -> DataFrame:
        """id and title of all nodes whose title holds the pattern, in any case; an empty one is in every title."""
        low = F.lower(F.lit(pattern))
        grams = self.spark.range(1).select(_grams(low).alias("g")).first().g
        there = F.contains(F.lower("title"), low)
        if not grams:
            return self.titles().where(there).select("id", "title")
        few = self.postings(grams).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("id", _bucket("id", self.buckets).alias("bucket"))
        return self.titles().join(few, ["bucket", "id"]).where(there).select("id", "title")


def folded(title: Column | str) -> Column:
    """Titles as they are compared: without marks on letters, in lower case, trimmed."""
    return F.lower(trim_all(ascii_fold(title)))


def _deletions(text: Column, edits: int) -> Column:
    """The text and all that is left of it when up to so many characters are deleted, and how many were."""
    level = F.array(text)
    out = level
    for _ in range(edits):
        without: Callable[[Column], Column] = lambda t: F.when(F.char_length(t) > 0, F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))))).otherwise(F.array().cast("array<string>"))
        level = F.array_distinct(F.flatten(F.transform(level, without)))
        out = F.array_union(out, level)
    return out


def links(mentions: DataFrame, nodes: DataFrame, edits: int = 1, key: str = "mention_id", text: str = "mention", carry: tuple[str, ...] = ()) -> DataFrame:
    """For each mention the nodes whose folded title is within so many edits (one or two) of the folded mention.

    Two texts within n edits have a text in common that n deletions at most leave of either, so both sides are joined by what deletions
    leave, by its hash, and the candidates' distances are then counted. Rows: key, id, title, distance, and what is carried along of nodes.
    Titles are compared once for each distinct one; empty mentions and titles, and null ones, are linked to nothing.
    """
    if not 1 <= edits <= MOST_EDITS:
        raise ValueError("one or two edits")
    asked = mentions.select(F.col(key).alias("key_"), folded(text).alias("asked")).where("asked <> ''")
    own = nodes.select("id", "title", *carry, folded("title").alias("name")).where("name <> ''")
    rests = lambda name: F.explode(F.transform(_deletions(F.col(name), edits), lambda t: F.xxhash64(t))).alias("rest")
    left = asked.select("asked").distinct().select("asked", rests("asked"))
    right = own.select("name").distinct().select("name", rests("name"))
    pairs = left.join(right, "rest").select("asked", "name").distinct().withColumn("distance", F.levenshtein("asked", "name")).where(F.col("distance") <= edits)
    return asked.join(pairs, "asked").join(own, "name").select(F.col("key_").alias(key), "id", "title", "distance", *carry)


def linked(mentions: DataFrame, nodes: DataFrame, edits: int = 1, key: str = "mention_id", text: str = "mention") -> DataFrame:
    """Entity linking: the links of each mention, and their rank: by distance, then title, then id."""
    return links(mentions, nodes, edits, key, text).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", "title", "id")))


def linked_in(graph: Graph, mentions: DataFrame, label: str, edits: int = 1, **names) -> DataFrame:
    """As linked, with the nodes of a label."""
    return linked(mentions, graph.table(label), edits, **names)
