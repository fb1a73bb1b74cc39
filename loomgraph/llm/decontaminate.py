"""Benchmark decontamination by one Aho-Corasick automaton over the word windows of all items."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import carried, id_text, map_texts, table, work_path, written
from loomgraph.llm.words import mixed, normal, runs

WINDOW = 10
#: Characters of items in one automaton (about 60 bytes of memory for each); more items go to further automata, one scan each.
AUTOMATON_CHARS = 4_000_000
#: A mask's size as a power of two at most (128 MB), its bits for a character of items (about 30 for a window), bits set for a window.
MASK_BITS, MASK_EACH, MASK_HASHES = 30, 6, 8
#: Bits of the mask that one task puts together at a time, as a power of two; segment -1 has the windows' numbers of words.
SEGMENT_BITS, SEGMENTS = 20, "segment bigint, bits binary"
#: Lots that one task deals out, on average.
LOTS = 8
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
HITS = "doc_id bigint, n_words bigint, spans array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>, items array<string>"


def windows(text: str, window: int = WINDOW) -> set[bytes]:
    """The item's runs of so many words, or all its words if they are fewer; each word is followed by a space."""
    words = normal(text or "").split()
    return {b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))} if words else set()


@lru_cache(2)
def _automaton(items: tuple[tuple[str | None, str], ...], window: int):
    """Patterns are bytes as Latin-1 characters, between spaces; each has its words' number and its items."""
    import ahocorasick

    found: dict[bytes, set[str | None]] = {}
    for item, text in items:
        for w in windows(text, window):
            found.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, own in found.items():
        a.add_word(" " + w.decode("latin-1"), (w.count(b" "), frozenset(own)))
    if found:
        a.make_automaton()
    return a if found else None


def _word_offsets(text: str, wanted: set[int]) -> dict[int, tuple[int, int]]:
    """Where words begin and end in the original text, in characters."""
    data = np.array([min(ord(c), 255) for c in text], np.uint8) if not text.isascii() else np.frombuffer(text.encode(), np.uint8)
    upper = (data >= 65) & (data <= 90)
    inside = np.concatenate([[False], (data >= 128) | upper | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return {i: (int(edges[2 * i]), int(edges[2 * i + 1])) for i in wanted}


def _lots(items: DataFrame, chars: int) -> tuple[DataFrame, list[int]]:
    """Distinct items dealt into lots, in the shared folder by lot, and the lots' numbers.

    Hashes deal items into buckets of about LOTS lots; in each, a running sum of lengths gives the lots, of chars and one item at most.
    """
    spark, path = items.sparkSession, work_path(items.sparkSession, "benchmark")
    items = items.distinct().withColumn("n", F.length("text").cast("long"))
    total = items.agg(F.sum("n")).first()[0]
    bucket = F.pmod(F.xxhash64("item", "text"), F.lit(-(-total // (LOTS * chars))))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy(F.xxhash64("text", "item"), "item", "text").rowsBetween(Window.unboundedPreceding, -1))
    lot = F.shiftleft("bucket", 32) + F.floor(F.coalesce(before, F.lit(0)) / F.lit(chars))
    dealt = items.withColumn("bucket", bucket).select("item", "text", lot.alias("lot"))
    dealt.repartition("lot").write.partitionBy("lot").parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    return dealt, sorted(r.lot for r in dealt.select("lot").distinct().collect())


class Mask:
    """A Bloom filter of the hashes of item windows, of bounded size: tells which documents may hold any. Tasks find the bits that items
    set, and put them together by segments; whole, it is broadcast."""

    def __init__(self, chars: int):
        self.size = 1 << max(SEGMENT_BITS, min(MASK_BITS, (MASK_EACH * chars).bit_length()))
        self.bits = np.zeros(0, np.uint8)
        self.lengths: set[int] = set()

    def _places(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(self.size - 1)

    def places(self, texts: list[str], window: int) -> tuple[np.ndarray, set[int]]:
        """The bits that the windows of some items set, in order, and the windows' numbers of words."""
        by_length: dict[int, list[bytes]] = {}
        for n in map(normal, texts):
            if words := n.count(b" "):
                by_length.setdefault(min(words, window), []).append(n)
        found = [np.zeros(0, np.uint64)]
        for length, normals in by_length.items():
            hashes = np.unique(runs(normals, {length})[0])
            found += [self._places(hashes, k) for k in range(MASK_HASHES)]
        return np.unique(np.concatenate(found)), set(by_length)

    def add(self, items: Iterable[tuple[str | None, str]], window: int) -> None:
        """Sets the bits of items at hand."""
        at, lengths = self.places([text for _, text in items], window)
        self.bits = self.bits if len(self.bits) else np.zeros(self.size >> 3, np.uint8)
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.lengths |= lengths

    def fill(self, items: DataFrame, window: int) -> Mask:
        """Sets the bits of all items. A task holds the bits of one slice of texts, then those of one segment; the driver gets each segment
        once, the whole mask at most."""
        mask = self

        def make():
            def one(_, texts):
                at, lengths = mask.places(texts, window)
                segment = at >> np.uint64(SEGMENT_BITS)
                starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(1 << 40))) if len(at) else np.zeros(0, np.int64)
                bits = np.split((at & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u4"), starts[1:]) if len(at) else []
                return [-1, *segment[starts].astype(np.int64).tolist()], [np.array(sorted(lengths), "<u4").tobytes(), *(b.tobytes() for b in bits)]

            return one

        def together(batches):
            at, held = None, None
            for b in batches:
                for segment, bits in zip(b.column(0).to_pylist(), b.column(1)):
                    if segment != at:
                        if held is not None:
                            yield _segment(at, held)
                        at, held = segment, np.zeros(1 << SEGMENT_BITS >> 3, np.uint8)
                    own = np.frombuffer(bits.as_py(), "<u4")
                    np.bitwise_or.at(held, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
            if held is not None:
                yield _segment(at, held)

        parts = map_texts(items.select(F.lit(0).alias("doc_id"), "text"), SEGMENTS, make)
        merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(together, SEGMENTS)
        self.bits = np.zeros(self.size >> 3, np.uint8)
        each = 1 << SEGMENT_BITS >> 3
        for r in merged.toLocalIterator():
            own = np.frombuffer(r.bits, np.uint8)
            if r.segment < 0:
                self.lengths = set(np.flatnonzero(np.unpackbits(own, bitorder="little")).tolist())
            else:
                self.bits[r.segment * each : (r.segment + 1) * each] = own
        return self

    def suspects(self, normals: list[bytes]) -> np.ndarray:
        """Whether each text may hold a window; one that does always may."""
        hashes, texts = runs(normals, self.lengths)
        for k in range(MASK_HASHES):
            at = self._places(hashes, k)
            there = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1) > 0
            hashes, texts = hashes[there], texts[there]
        out = np.zeros(len(normals), bool)
        out[texts] = True
        return out


def _segment(number: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["segment", "bits"])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars: int = AUTOMATON_CHARS, carry: bool = False) -> DataFrame:
    """One row for each document: its words, the hit spans (word numbers first to last, and characters start to end, exclusive), the items.

    Each automaton holds at most about chars characters of items (and one item whole), so what a task holds is bounded. A larger
    benchmark is dealt into lots in Spark. First tasks put all windows into one mask of bounded size, and a single scan of the corpus
    keeps the texts of documents that may hold any; then the driver fetches one lot after another, and its automaton scans those few. Hits are
    joined on the row's number. Null texts have no words, items whose text is null or has none no windows; repeated rows and null ids
    stay. Items without an id hit as others do, and are one null among the items. A text of any length is scanned whole, at about 30
    bytes of memory for one. With carry, a column row holds all columns of the input.
    """
    docs = (carried if carry else id_text)(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    send = docs.sparkSession.sparkContext.broadcast
    if total <= chars:
        return _scan(docs, send(_fetched(items)), window)
    numbered = written(docs.withColumn("number", F.monotonically_increasing_id()), "decontaminate")
    dealt, lots = _lots(items, chars)
    sent = send(Mask(total).fill(dealt, window))
    rows = written(_suspects(numbered.select(F.col("number").alias("doc_id"), "text"), sent), "suspects")
    sent.destroy()
    parts = rows.select("doc_id", "n_words", F.expr("cast(array() as array<struct<first: bigint, last: bigint, start: bigint, end: bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    few = rows.where("text is not null").select("doc_id", "text")
    for lot in lots:
        sent = send(_fetched(dealt.where(F.col("lot") == lot)))
        parts = parts.unionByName(written(_scan(few, sent, window).where(F.size("spans") > 0), "hits"))
        sent.destroy()
    joined = parts.groupBy(F.col("doc_id").alias("number")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return numbered.drop("text").join(joined, "number").select("doc_id", "n_words", "spans", "items", *(["row"] if carry else []))


def _suspects(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """Every row's number of words, and the text of those that may hold a window."""

    def make():
        mask = sent.value

        def one(numbers, texts):
            normals = [normal(t) for t in texts]
            return numbers, [n.count(b" ") for n in normals], [t if s else None for t, s in zip(texts, mask.suspects(normals).tolist())]

        return one

    return map_texts(rows, "doc_id long, n_words long, text string", make)


def _fetched(items: DataFrame) -> tuple[tuple[str | None, str], ...]:
    return tuple((r.item, r.text) for r in items.select("item", "text").collect())


def _scan(docs: DataFrame, sent: Broadcast, window: int) -> DataFrame:
    def make():
        automaton = _automaton(sent.value, window)

        def one(ids, texts):
            counts, spans, items = [], [], []
            for t in texts:
                n = normal(t)
                counts.append(n.count(b" "))
                hits = list(automaton.iter(" " + n.decode("latin-1"))) if automaton is not None and n else []
                if not hits:
                    spans.append([])
                    items.append([])
                    continue
                before = np.concatenate([[0], np.cumsum(np.frombuffer(b" " + n, np.uint8) == 32)])
                runs, own = [], set()
                for last, (words, found) in hits:
                    end = int(before[last + 1]) - 1  # words that have ended here
                    own |= found
                    runs.append((end - words, end - 1))
                merged = []
                for a, b in sorted(runs):
                    if merged and a <= merged[-1][1] + 1:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                at = _word_offsets(t, {w for m in merged for w in m})
                spans.append([{"first": a, "last": b, "start": at[a][0], "end": at[b][1]} for a, b in merged])
                items.append(sorted(own, key=lambda i: (i is None, i or "")))
            return ids, counts, spans, items

        return one

    return map_texts(docs, HITS, make)


def digest(hits: DataFrame) -> DataFrame:
    """The counts and the digest of item ids for each document of scan(); spans of several lots may overlap, so words are counted once.

    As in the SQL, items without an id count as one item, and the digest leaves them out.
    """
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["to"] + 1) + 1)).alias("n"), F.greatest(acc["to"], s["last"]).alias("to")),
        lambda acc: acc["n"],
    )
    return hits.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_NORM = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ')"
ORACLE = f"""
WITH d AS (SELECT doc_id, CASE WHEN n = '' THEN []::VARCHAR[] ELSE string_split(n, ' ') END AS w FROM (SELECT doc_id, {_NORM.format("coalesce(text, '')")} AS n FROM documents)),
i AS (SELECT DISTINCT item_id, string_split(n, ' ') AS w FROM (SELECT item_id, {_NORM.format("coalesce(text, '')")} AS n FROM benchmark) WHERE n <> ''),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k FROM i)),
q AS (SELECT doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') AS s
      FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM p))),
h AS (SELECT doc_id, k, q.l, item_id FROM q JOIN p ON q.s = p.s AND q.l = p.l),
m AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS x FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
