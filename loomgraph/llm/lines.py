"""Line dedup through a sharded minimal perfect hash of the repeated lines.

Each shard holds, for its lines' hashes, a BBHash function (levels of bit arrays; a key's index is the rank of its bit), and arrays in
its order: a 64-bit fingerprint from a second hash, the number of documents, and the document that keeps the line. Documents hash
their own lines and probe the arrays; line texts are not joined. Arrays that fit into a task go to the documents; of larger ones a shard
meets the hashes of its lines, and whole documents are shuffled once, by row, to meet the numbers of the lines that they lose.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import carried, discard, id_text, map_texts, table, written
from loomgraph.llm.words import mixed, span_hashes

MIN_CHARS = 10
#: Lines of a shard, on average; bytes for a line in all arrays; bytes of arrays that a task may hold whole.
SHARD_LINES, LINE_BYTES, HELD_BYTES = 200_000, 24, 64_000_000
#: Lines that are probed by one task beyond that.
PROBES = 1_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LINES = "h long, f long, doc_id long"


class Lines:
    """The lines of texts, with the hash and the fingerprint of each key that counts."""

    def __init__(self, texts: list[str], min_chars: int):
        coded = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
        data = np.frombuffer(b"".join(coded).translate(_FOLD), np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.counts = np.array([c.count(b"\n") for c in coded])
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        solid = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
        first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        full = last > first
        begin, end = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        begin[full], end[full] = solid[first[full]], solid[last[full] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.at = np.flatnonzero(points[end] - points[begin] >= min_chars)
        self.h = span_hashes(data, begin[self.at], end[self.at]).view(np.int64)
        self.f = span_hashes(data, begin[self.at], end[self.at], 1).view(np.int64)
        self.of = self.text[self.at]


class PerfectHash:
    """BBHash over distinct 64-bit keys: levels of twice as many bits as keys are left; a key takes a bit that no other wants."""

    def __init__(self, keys: np.ndarray):
        self.levels, base, left = [], 0, keys.astype(np.uint64)
        for level in range(32):
            if not len(left):
                break
            bits = 2 * len(left) + 64
            wanted = self._bit(left, level, bits)
            alone = np.bincount(wanted, minlength=bits) == 1
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(alone, np.arange(0, bits, 64)))]) + base
            self.levels.append((bits, np.packbits(alone, bitorder="little"), ranks.astype(np.uint32)))
            base += int(alone.sum())
            left = left[~alone[wanted]]
        self.rest = {int(k): base + i for i, k in enumerate(np.sort(left).tolist())}

    @staticmethod
    def _bit(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; for others some index, or -1."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, packed, ranks) in enumerate(self.levels):
            at = self._bit(keys[open_], level, bits)
            hit = (packed[at >> 3] >> (at & 7)) & 1 == 1
            block = at[hit] >> 6
            inside = np.arange(64) < (at[hit] & 63)[:, None]
            padded = np.concatenate([packed, np.zeros(8, np.uint8)])
            words = np.unpackbits(padded[(block * 8)[:, None] + np.arange(8)], axis=1, bitorder="little")
            out[open_[hit]] = ranks[block] + (words & inside).sum(1)
            open_ = open_[~hit]
            if not len(open_):
                break
        for i in open_.tolist() if self.rest else ():
            out[i] = self.rest.get(int(keys[i]), -1)
        return out


class Shard:
    def __init__(self, h: np.ndarray, f: np.ndarray, owner: np.ndarray, count: np.ndarray):
        # the rare keys that share all 64 bits of h can't have bits of their own
        order = np.argsort(h, kind="stable")
        twice = np.zeros(len(h), bool)
        twice[order[1:]] = h[order[1:]] == h[order[:-1]]
        self.same = {(int(a), int(b)): int(c) for a, b, c in zip(h[twice], f[twice], owner[twice])}
        h, f, owner, count = h[~twice], f[~twice], owner[~twice], count[~twice]
        self.hash = PerfectHash(h)
        at = self.hash.index(h)
        self.f, self.owner, self.count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.uint32)
        self.f[at], self.owner[at], self.count[at] = f, owner, np.minimum(count, 0xFFFFFFFF)

    def owners(self, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lines are repeated ones, and the document that keeps each."""
        at = self.hash.index(h)
        found = at >= 0
        found[found] = self.f[at[found]] == f[found]
        owner = np.where(found, self.owner[np.where(found, at, 0)] if len(self.owner) else 0, 0)
        for i, key in enumerate(zip(h.tolist(), f.tolist())) if self.same else ():
            if key in self.same:
                found[i], owner[i] = True, self.same[key]
        return found, owner


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(h.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def line_hashes(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each document's distinct line keys of min_chars code points or more, as hash and fingerprint."""

    def make():
        def one(ids, texts):
            lines = Lines(texts, min_chars)
            _, first = np.unique(mixed(lines.h.view(np.uint64)) ^ lines.of.astype(np.uint64), return_index=True)
            return lines.h[first], lines.f[first], [ids[i] for i in lines.of[first].tolist()]

        return one

    return map_texts(df, LINES, make)


def repeated_lines(hashes: DataFrame) -> DataFrame:
    """Lines of two documents or more: the smallest id keeps them. A null id is one more document, and keeps nothing."""
    some = hashes.groupBy("h", "f").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    return some.where("owner is not null and (owner < other or unnamed)").select("h", "f", "owner", "n")


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """Rows of shard number and image."""

    def number(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards)), *b.columns], ["shard", *b.schema.names])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = Shard(*(rows[c].to_numpy() for c in ("h", "f", "owner", "n")))
        return pa.table({"shard": [key[0].as_py()], "image": [pickle.dumps(shard, 5)]}, schema=pa.schema([("shard", pa.int64()), ("image", pa.binary())]))

    return lines.mapInArrow(number, "shard long, h long, f long, owner long, n long").groupBy("shard").applyInArrow(run, "shard long, image binary")


_OPEN: dict = {}


def _opened(name: str, sent) -> dict[int, Shard]:
    """The shards of a broadcast, unpacked once in a worker process."""
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = {s: pickle.loads(image) for s, image in sent.value}
    return _OPEN[name]


def _without(texts: list[str], lines: Lines, drop: np.ndarray) -> tuple[list[int], list[str]]:
    """How many lines go, and the texts without them. drop: for each of lines.at."""
    gone = np.zeros(len(lines.text), bool)
    gone[lines.at[drop]] = True
    dropped = np.bincount(lines.text[gone], minlength=len(texts)).tolist()
    ends = np.cumsum(lines.counts).tolist()
    out = []
    for i, (t, n) in enumerate(zip(texts, dropped)):
        if n:
            off = gone[ends[i] - int(lines.counts[i]) : ends[i]].tolist()
            t = "\n".join([x for x, o in zip(t.split("\n"), off) if not o])
        out.append(t)
    return dropped, out


RESULT = "doc_id long, n_lines long, n_dropped long, text string"


def dedup_lines(df: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Whole texts (null: empty, one empty line) without the lines that an earlier document holds.

    A line's key is the line, stripped of blanks and with A-Z in lower case. A key of min_chars code points or more found in at least
    two documents stays only in the one with the smallest id; rows with equal ids are one document, and null ids are one that keeps
    no such line. Every row stays. With carry, a column row holds all columns of the input.

    Arrays of up to held_bytes, by the count of repeated lines, are held whole by each task; of a larger index each task holds one
    shard, and lines' hashes (never texts) go to the shards in salted parts. Lines are hashed together for about SLICE_CHARS bytes of
    texts, at some 30 bytes of memory for one; a longer text is hashed whole.
    """
    hashes = line_hashes(id_text(df, id_col, text_col), min_chars)
    lines = written(repeated_lines(hashes), "lines")
    n = lines.count()
    shards = max(1, -(-n // SHARD_LINES))
    docs = carried(df, id_col, text_col) if carry else id_text(df, id_col, text_col)
    if n * LINE_BYTES > held_bytes:
        images = written(build_shards(lines, shards), "shards")
        discard(lines)
        return _routed(docs, images, shards, min_chars)
    spark = df.sparkSession
    name = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast([(r.shard, bytes(r.image)) for r in build_shards(lines, shards).collect()])
    discard(lines)

    def make():
        index = _opened(name, sent)

        def one(ids, texts):
            lines = Lines(texts, min_chars)
            drop = np.zeros(len(lines.h), bool)
            where = shard_of(lines.h, shards)
            named = np.array([i is not None for i in ids], bool)
            number = np.array([i or 0 for i in ids], np.int64)
            for s, shard in index.items():
                here = np.flatnonzero(where == s)
                found, owner = shard.owners(lines.h[here], lines.f[here])
                of = lines.of[here]
                drop[here] = found & (~named[of] | (number[of] != owner))
            dropped, kept = _without(texts, lines, drop)
            return ids, lines.counts, dropped, kept

        return one

    return map_texts(docs, RESULT, make)


def _routed(docs: DataFrame, images: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """Lines' hashes go to the shards with their row and line numbers, and each row gets back the numbers of the lines that it loses.

    Rows are numbered and written, so rows with equal or null ids are rows of their own, and no id gathers many."""
    numbered = written(docs.withColumn("number", F.monotonically_increasing_id()), "numbered")

    def make():
        def one(numbers, texts, ids):
            lines = Lines(texts, min_chars)
            line = lines.at - (np.cumsum(lines.counts) - lines.counts)[lines.of]
            of = lines.of.tolist()
            return [numbers[i] for i in of], shard_of(lines.h, shards), lines.h, lines.f, [ids[i] for i in of], line

        return one

    schema = "number long, shard long, h long, f long, doc_id long, line int"
    probes = written(map_texts(numbered.select("number", "text", "doc_id"), schema, make), "probes")
    most = probes.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // PROBES))
    salted = probes.withColumn("salt", F.pmod(F.xxhash64("number", "line"), F.lit(salts)))
    spread = images.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    out = pa.schema([("number", pa.int64()), ("line", pa.int32())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return out.empty_table()
        shard = pickle.loads(right["image"][0].as_py())
        found, owner = shard.owners(left["h"].to_numpy(), left["f"].to_numpy())
        ids = left["doc_id"].combine_chunks()
        lost = found & (ids.is_null().to_numpy(zero_copy_only=False) | (ids.fill_null(0).to_numpy() != owner))
        return left.select(["number", "line"]).filter(pa.array(lost)).cast(out)

    lost = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(run, "number long, line int")
    lost = written(lost.groupBy("number").agg(F.collect_list("line").alias("lost")), "lost")
    discard(probes, images)
    joined = numbered.join(lost, "number", "left").select("doc_id", "text", "lost", *(["row"] if "row" in docs.columns else []))

    def drop():
        def one(ids, texts, lost):
            split = [t.split("\n") for t in texts]
            gone = [set(own or ()) for own in lost]
            return ids, [len(x) for x in split], [len(g) for g in gone], ["\n".join([x for i, x in enumerate(lines) if i not in g]) if g else t for t, lines, g in zip(texts, split, gone)]

        return one

    return map_texts(joined, RESULT, drop)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, k, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)),
r AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (r.key IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN r USING (key) GROUP BY doc_id
"""
