"""The hashes of spans on texts of a regular build, which linear hashes confuse."""

from __future__ import annotations

import numpy as np

from loomgraph.llm import lines, near_dups
from loomgraph.llm.words import span_hashes

DOCS = "doc_id long, text string"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def pair(n=1024):
    one = thue_morse(n)
    return one, one.translate(str.maketrans("ab", "ba"))


def hashed(texts, seed=0):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    return span_hashes(data, ends - [len(t) for t in texts], ends, seed)


def test_regular_texts_have_hashes_of_their_own():
    texts = [t for n in (16, 64, 256, 1024, 4096) for t in pair(n)]
    texts += ["a" * n for n in range(200)] + ["ab" * n for n in range(1, 200)] + [chr(97 + i) + "x" * 8 * j for i in range(20) for j in range(1, 20)]
    texts += ["\x00" * n for n in range(1, 100)] + ["x" * 8 * i + "y" * 8 + "x" * 8 * (40 - i) for i in range(40)]  # pieces that change places
    assert len(texts) == len(set(texts))
    for seed in (0, 1):
        assert len(np.unique(hashed(texts, seed))) == len(texts)


def test_two_hashes_are_independent():
    """Bits of both hashes, and of their difference, are even, and unlike ones of 16 bits meet as often as by chance."""
    texts = [f"{i:0200b}" for i in range(20000)]
    a, b = hashed(texts), hashed(texts, 1)
    for x in (a, b, a ^ b, a - b):
        ones = ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).mean(0)
        assert abs(ones - 0.5).max() < 0.03
    low = lambda x: (x & np.uint64(0xFFFF)).astype(np.int64)
    _, counts = np.unique(low(a), return_counts=True)
    meet = (counts * (counts - 1) // 2).sum()
    same = np.unique((low(a) << 16) | low(b), return_counts=True)[1]
    assert 2500 < meet < 3600 and (same * (same - 1) // 2).sum() <= 2  # n² / 2 / 2**16 = 3052 pairs in one, 0.05 in both


def test_a_span_alone_and_among_others():
    whole = hashed(["abc", "defghijk", "", "lmnopqrstuvw"])
    assert [hashed([t])[0] for t in ("abc", "defghijk", "", "lmnopqrstuvw")] == whole.tolist()


def test_line_dedup_keeps_regular_lines(spark):
    docs = spark.createDataFrame([(1, pair()[0]), (2, pair()[1]), (3, pair()[0])], DOCS)
    for held in (lines.HELD_BYTES, 0):
        kept = {r.doc_id: r.text for r in lines.dedup_lines(docs, held_bytes=held).collect()}
        assert kept == {1: pair()[0], 2: pair()[1], 3: ""}


def test_near_duplicates_keep_regular_texts_apart(spark):
    docs = spark.createDataFrame([(1, pair()[0]), (2, pair()[1]), (3, pair()[0])], DOCS)
    classes = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 1}
