"""Packing token ids into sequences: first-fit decreasing over a tournament tree of bin capacities, in random groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import id_text, map_texts, table, written
from loomgraph.llm.tokens import pieces, vocabulary

#: Documents that are packed together, on average.
GROUP_DOCS = 2048
#: Numbers of sequences from here on are those that one full piece fills.
FULL = 1 << 62
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
RESULT = PIECES + ", sequence_id bigint, offset bigint"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each item. Sizes are 1 to capacity; equal sizes keep their order.

    Each inner node of the tree holds the largest capacity left below it, so the first bin that fits is found by one descent.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], places[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, places


def cut_pieces(df: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Encodes whole texts (null: empty), each followed by end_id, and cuts them into pieces of length ids and a rest."""

    def make():
        coder, end = pieces(tokenizer, special_as_text), np.array([end_id], "<u4").tobytes()

        def one(ids, texts):
            rows = []
            for name, b in zip(ids, coder.ids(texts)):
                b += end
                total = len(b) // 4
                rows += [(name, i, min(length, total - i), zlib.crc32(b[4 * i : 4 * (i + length)]), total) for i in range(0, total, length)]
            return list(zip(*rows)) or [[]] * 5

        return one

    return map_texts(id_text(df, id_col, text_col), PIECES, make)


def pack_sequences(df: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """One row for each piece: which ids of which document, and its place in a sequence of at most length ids.

    A piece of length ids fills a sequence by itself, as first-fit decreasing would have it, and needs no group. So a document of any
    length brings one shorter rest at most. Documents are dealt at random into groups of about group_docs, and each group's rests are
    packed on their own: only numbers are shuffled, and no key gathers more than a group. Pieces, which are numbers only, are written to
    the shared folder and counted there. Null ids and repeated rows are packed as rows of their own; a null or empty text has its end id
    only. An empty table gives no rows.
    """
    cut = cut_pieces(df, tokenizer, length, end_id, id_col, text_col, special_as_text).withColumn("number", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    full, rests = cut.where(F.col("length") == length), cut.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group_docs))
    dealt = rests.withColumn("pack", F.pmod(F.xxhash64("doc_id", "number"), F.lit(groups))).drop("number")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("pack").sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, places = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(places))

    alone = full.withColumns({"sequence_id": F.lit(FULL) + F.col("number"), "offset": F.lit(0).cast("long")}).drop("number")
    return dealt.groupBy("pack").applyInArrow(run, RESULT).unionByName(alone)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
