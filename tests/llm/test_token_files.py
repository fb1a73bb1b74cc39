from __future__ import annotations

import random
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import packing, token_files
from loomgraph.llm.common import table, work_path
from loomgraph.llm.tokens import Pieces, pieces, vocabulary

SF = "/root/testdata/sf0.001"
ODD = "ab Cz' sltvedrm09.,\n\t  \x85\xa0²½ⅧΣσçÉéİßǅ中́ͅ漢١😀\x1c​_-'ſK<|endoftext|>"

SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "é<|endoftext|>é", "  <|startoftext|>  "]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(spark, name):
    coder, rnd = pieces(vocabulary(name)), random.Random(3)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 16))) for _ in range(4000)] + ["", "ΑΣ ΑΣ.", "a" * 5000, *SPECIAL]
    texts += ["".join(rnd.choice([*SPECIAL, *ODD]) for _ in range(8)) for _ in range(500)]
    texts += [r.text for r in table(spark, SF, "documents").collect()]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.ids(texts)] == library(name, texts)
    plain = Tokenizer.from_file(vocabulary(name))
    plain.encode_special_tokens = True
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in pieces(vocabulary(name), True).ids(texts)] == want
    assert [len(np.frombuffer(b, "<u4")) for b in coder.ids(["<|endoftext|>"])] == [1]


def library(name, texts):
    """The ids by an untouched tokenizer of the library."""
    return [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_code_point(name):
    """Characters that Python's Unicode doesn't have yet among them."""
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"x{c}y 1{c}" for c in points[i : i + 48]) for i in range(0, len(points), 48)]
    assert Pieces(vocabulary(name)).ids(texts) == [np.array(ids, "<u4").tobytes() for ids in library(name, texts)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=200), st.sampled_from(["<u2", "<u4"]))
def test_segment_round_trip(lengths, kind):
    ends = np.cumsum(lengths)
    ids = np.arange(int(ends[-1])).astype(kind)
    s = token_files.Segment(token_files.pack(ends, ids))
    assert s.ends().tolist() == ends.tolist() == [s.select(k) for k in range(len(lengths))]
    assert all(s.document(k).tolist() == ids[(ends[k] - lengths[k]) : ends[k]].tolist() for k in range(len(lengths)))


def test_damaged_segments():
    image = token_files.pack(np.array([2]), np.array([1, 2], "<u2"))
    for bad in (image[:-1], b"XXXX" + image[4:], image + b"x"):
        with pytest.raises(ValueError):
            token_files.Segment(bad)


def test_files_read_back(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 1000)
    docs = table(spark, SF, "documents")
    rows = token_files.op1_token_files(spark, SF).orderBy("doc_id").collect()
    start, docs = 0, docs.orderBy("doc_id").collect()
    for r, d, ids in zip(rows, docs, library("byte_bpe_50k.json", [d.text for d in docs]), strict=True):
        ids = [*ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), crc(ids))
        start += len(ids)


def test_odd_rows(spark):
    rows = [(None, "x"), (3, None), (3, ""), (1, "a b"), (1, "a b"), (2, "z" * 50_000)]
    docs = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, start string, image int")
    path = work_path(spark, "odd")
    token_files.write_token_files(docs, path, vocabulary("byte_bpe_50k.json"))
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 3] and [r.n_tokens for r in got[-2:]] == [1, 1]
    path = work_path(spark, "none")
    token_files.write_token_files(docs.limit(0), path, vocabulary("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_first_fit_decreasing(sizes):
    bins, places = packing.first_fit_decreasing(np.array(sizes, np.int64), 64)
    left, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, free in enumerate(left) if free >= sizes[i]), None)
        if b is None:
            b = len(left)
            left.append(64)
        want[i] = (b, 64 - left[b])
        left[b] -= sizes[i]
    assert {i: (int(b), int(p)) for i, (b, p) in enumerate(zip(bins, places))} == want


def plain_pieces(rows, length):
    ids = library("word_bpe_49k.json", [t or "" for _, t in rows])
    return sorted((str(i), k, min(length, len(own) + 1 - k), crc([*own, 2][k : k + length]), len(own) + 1) for (i, _), own in zip(rows, ids) for k in range(0, len(own) + 1, length))


@pytest.mark.parametrize("length", [4096, 100])
def test_packing(spark, length):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()] + [(None, "x"), (None, None), (7, ""), (7, ""), (2**60 + 1, "w " * 20_000), (8, "a <|endoftext|> b"), (9, "w " * 4095)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pack int")
    got = packing.pack_sequences(docs, vocabulary("word_bpe_49k.json"), length=length, group_docs=64).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == plain_pieces(rows, length)
    at: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= length
    groups: dict[int, list[int]] = {}
    for r in got:
        if r.length < length:
            groups.setdefault(r.sequence_id >> 32, []).append(r.length)
    assert 2 <= len(groups) <= 5 and packing.FULL >> 32 not in groups
    for g, own in groups.items():
        bins, _ = packing.first_fit_decreasing(np.array(own), length)
        assert len({r.sequence_id for r in got if r.sequence_id >> 32 == g}) == bins.max() + 1
    assert packing.pack_sequences(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_groups_are_of_documents(spark):
    docs = spark.createDataFrame([(i, "some words of a long document " * 400) for i in range(2)], "doc_id long, text string")
    rows = packing.pack_sequences(docs, vocabulary("word_bpe_49k.json"), length=8, group_docs=1).collect()
    rests = [r for r in rows if r.length < 8]
    assert len(rows) > 400 and len(rests) == 2
    for i in range(2):
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in own) == own[0].doc_tokens and len({r.start for r in own}) == len(own)
    assert len({r.sequence_id for r in rows}) >= len(rows) - 1
