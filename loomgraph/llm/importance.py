"""Importance resampling towards a target: hashed word runs, their gains, and a weighted draw without replacement.

A feature is a run of 1 to n consecutive words, joined by one space; its bucket is the CRC-32 of its bytes, modulo a number of buckets.
One scan of a text keeps a ring of the running states of the last n starts: every word extends each of them by a space and itself, and
opens one more. So no run is ever put together, and memory doesn't grow with a text's features.

A bucket's gain is 1000 times the logarithm of how much likelier it is in the target than in the raw texts, both smoothed by one. A text's
weight is the sum over its features; with Gumbel noise from its id added, the highest scores are a draw in proportion to the weights.
"""

from __future__ import annotations

import hashlib
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, id_text, map_texts, slices, table, written
from loomgraph.llm.words import NORMAL

N, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Buckets that are counted at once; a longer text is counted in parts.
HELD = 1 << 16
RESULT = "doc_id long, n_words long, n_features long, weight long, score long"


def features(words: list[bytes], n: int):
    """The CRC-32 of every run of 1 to n words, in the order of their last words."""
    if n == 1:  # a ring of one state, which every word opens anew
        yield from map(crc32, words)
        return
    ring: list[int] = []
    for word in words:
        longer = b" " + word
        ring = [*(crc32(longer, state) for state in ring[1 - n :]), crc32(word)]
        yield from ring


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def _parts(words: list[bytes], n: int, buckets: int):
    """The buckets of all features, at most about HELD at once."""
    found = features(words, n)
    while len(part := np.fromiter((x for _, x in zip(range(HELD), found)), np.int64)):
        yield part % buckets


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> dict[int, int]:
    """texts: a column text. The number of features of each bucket that has any, over all texts; buckets numbers at most leave a task."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for i, j in slices(b.column(0)):
                held, size = [], 0
                for t in b.column(0).slice(i, j - i).to_pylist():
                    for part in _parts(_words(t or ""), n, buckets):
                        held.append(part)
                        size += len(part)
                        if size >= HELD:
                            sums += np.bincount(np.concatenate(held), minlength=buckets)
                            held, size = [], 0
                if held:
                    sums += np.bincount(np.concatenate(held), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in found.collect()}


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    raw_all, target_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    own = ((target.get(b, 0) + 1.0) * raw_all / ((raw.get(b, 0) + 1.0) * target_all) for b in range(buckets))
    return np.array([floor(1000 * log(x)) for x in own], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 that the seed and the id give; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, n: int = N, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_words, n_features, weight and score. gain: of each bucket, a bounded number of them."""
    sent = df.sparkSession.sparkContext.broadcast(gain)

    def make():
        gain = sent.value

        def one(ids, texts):
            words = [_words(t) for t in texts]
            sizes = [len(w) for w in words]
            weights, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, own in enumerate(words):
                for part in _parts(own, n, len(gain)):
                    weights[i] += int(gain[part].sum())
                    counts[i] += len(part)
            return ids, sizes, counts, weights, [int(w) + noise(seed, i) for w, i in zip(weights, ids)]

        return one

    return map_texts(id_text(df, id_col, text_col), RESULT, make)


def resample(df: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Draws floor(percent * N / 100) of the N rows of df with at least min_words words, by their likeness to the target's texts (a
    column text). Every row stays: doc_id, n_words, n_features, weight, score, and rank (from 1; null where it isn't drawn).

    Null texts have no words. Ties go to the smaller doc_id, null ids last; rows with equal ids are rows of their own, and of those with
    equal scores any order is right, as nothing in the result tells them apart but the rank. Ranks need no task that holds all rows:
    the numbers of rows are sorted in ranges, and each range's first rank is the sum of those before it.
    """
    raw = bucket_counts(df.select(F.col(text_col).cast("string").alias("text")), n, buckets)
    goal = bucket_counts(target.select(F.col("text").cast("string").alias("text")), n, buckets)
    rows = scored(df, gains(raw, goal, buckets), n, seed, id_col, text_col)
    short = (F.col("n_words") < min_words).alias("short")
    keys = [short, F.desc("score"), F.asc_nulls_last("doc_id"), "at"]
    scores = written(rows.withColumn("at", F.monotonically_increasing_id()), "resample-scores")  # to sort in ranges, Spark reads them twice
    # short texts come last, so the drawn ones are the first rows of all; "at" splits even a range of rows that are equal in all else
    ordered = scores.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = written(ordered, "resample-ordered")
    discard(scores)
    part = F.shiftright("at", 33).cast("int")
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_words") >= min_words, 1)).alias("able")).collect()
    before, total, able = {}, 0, sum(r.able for r in sizes)
    for r in sorted(sizes):
        before[r.part] = total
        total += r.n
    first = df.sparkSession.createDataFrame(list(before.items()), "part int, before long")  # a number for each range
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    numbered = ordered.withColumn("part", part).join(F.broadcast(first), "part")
    return numbered.select("doc_id", "n_words", "n_features", "weight", "score", F.when(place <= percent * able // 100, place).alias("rank"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)
#: CRC-32 by its polynomial, for distinct words only.
ORACLE = f"""
WITH RECURSIVE steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS c FROM steps WHERE k = 8),
d AS (SELECT doc_id, {_SPLIT} AS words FROM documents), b AS (SELECT {_SPLIT} AS words FROM benchmark),
w AS (SELECT doc_id, unnest(words) AS word FROM d), g AS (SELECT unnest(words) AS word FROM b),
u AS (SELECT word, hex(encode(word)) AS x, c FROM (SELECT word FROM w UNION SELECT word FROM g), crc),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substring(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, y: xor(a >> 8, c[(xor(a, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM u),
s AS (SELECT bucket, count(*) AS n FROM w JOIN h USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM g JOIN h USING (word) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (total.s + {BUCKETS}) / ((s.n + 1)::DOUBLE * (total.t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
own AS (SELECT doc_id, sum(gain) AS weight FROM w JOIN h USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
r AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substring(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN own USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM r WHERE n_words >= {MIN_WORDS})
SELECT r.doc_id, n_words AS n_features, weight, score, CASE WHEN rank <= {PERCENT} * able // 100 THEN rank END AS rank, n_words FROM r LEFT JOIN ranked USING (doc_id)
"""
