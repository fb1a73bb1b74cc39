"""FLAC against a plain reader, bit by bit, and WARC archives."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import zstandard

from loomgraph.llm import common, flac, warc
from loomgraph.llm.common import table, work_path

SF = "/root/testdata/sf0.001"


class Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v


def plain_decode(media: bytes) -> bytes:
    total, _, points, at = flac._stream_head(media)
    out = []
    b = Bits(media, at)
    for number, (sample, offset, n) in enumerate(points):
        assert sample == len(out) and b.at == 8 * (at + offset)
        begin = b.at // 8
        b.at += 8 * len(flac.frame_head(number, n))
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0
        if kind == 0:
            x = [b.signed(8)] * n
        elif kind == 1:
            x = [b.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [b.signed(8) for _ in range(order)]
            shift, c = 0, list(flac.FIXED[order]) if kind < 32 else []
            if kind >= 32:
                precision, shift = b.take(4) + 1, b.signed(5)
                c = [b.signed(precision) for _ in range(order)]
            assert b.take(2) == 0
            parts = 1 << b.take(4)
            for p in range(parts):
                k = b.take(4)
                for _ in range(n // parts - (order if p == 0 else 0)):
                    q = 0
                    while not b.take(1):
                        q += 1
                    u = q << k | b.take(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(a * v for a, v in zip(c, x[::-1])) >> shift))
        out += x
        b.at += -b.at % 8
        crc = 0
        for byte in media[begin : b.at // 8]:
            crc ^= byte << 8
            for _ in range(8):
                crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
        assert b.take(16) == crc
    assert len(out) == total and b.at == 8 * len(media)
    return bytes(v + 128 for v in out)


def payloads():
    rnd = random.Random(1)
    texts = ["", "a", "x" * 3000, "Ünïcödé " * 40, "the cat sat. " * 90, "".join(rnd.choice("ab \n€😀") for _ in range(2000))]
    wave = bytes(int(128 + 100 * __import__("math").sin(i / 9)) for i in range(2048))
    texts.append("many frames " * 13_000)
    return [flac.payload_of(t) for t in texts] + [rnd.randbytes(1088), wave, bytes([0, 255] * 32) + bytes(960), bytes(1024) + b"\xff" * 64]


def test_streams_against_a_plain_reader():
    made = flac.encode(payloads())
    assert [plain_decode(m) for m in made] == payloads() == flac.decode(made)
    kinds = {m[flac._stream_head(m)[3] + len(flac.frame_head(0, min(flac.BLOCK, len(p))))] >> 1 for m, p in zip(made, payloads())}
    assert {0, 1} <= kinds and any(k >= 32 for k in kinds)  # constant, verbatim and linear subframes occur


def test_samples_from_any_offset():
    rnd, made = random.Random(3), flac.encode(payloads())
    for m, p in zip(made, payloads()):
        for _ in range(20):
            start = rnd.randrange(len(p))
            n = rnd.choice([0, 1, 64, 1024, 1500, len(p)])
            assert flac.read_samples([m], [start], [n]) == [p[start : start + n]]
    starts = [rnd.randrange(len(p)) for p in payloads()]
    assert flac.read_samples(made, starts, [700] * len(made)) == [p[s : s + 700] for p, s in zip(payloads(), starts)]
    many = made[6]
    _, _, points, at = flac._stream_head(many)
    cut = many[: at + points[5][1]] + bytes(points[6][1] - points[5][1]) + many[at + points[6][1] :]
    assert flac.read_samples([cut], [6 * flac.BLOCK], [10]) == [payloads()[6][6 * flac.BLOCK :][:10]]  # a damaged frame elsewhere doesn't matter
    with pytest.raises(ValueError):
        flac.read_samples([cut], [5 * flac.BLOCK], [10])


def test_long_unary_runs():
    quiet = bytes([128] * 1000 + [255] + [128] * 23)
    assert flac.decode(flac.encode([quiet])) == [quiet]


def test_damage_is_found():
    (media,) = flac.encode([flac.payload_of("some words " * 50)])
    for i in (0, 30, 60, len(media) - 30, len(media) - 1):
        with pytest.raises((ValueError, IndexError, struct.error)):
            flac.decode([media[:i] + bytes([media[i] ^ 0x55]) + media[i + 1 :]])
    with pytest.raises(ValueError):
        flac.encode([b"abc"])


def test_coded_numbers():
    for n in (0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000):
        assert flac._coded_number(n) == chr(n).encode("utf-8", "surrogatepass")


def test_media_query(spark):
    docs = spark.createDataFrame([(1, None, "n"), (1, "", "n"), (None, "words\n" * 900, "n"), (2, "a", "n")], "doc_id long, text string, media string")
    rows = {(r.doc_id, r.n_bytes): r for r in flac.describe_media(flac.encode_flac(docs)).collect()}
    assert set(rows) == {(1, 0), (None, 5400), (2, 1)}
    text = ("words\n" * 900).encode()
    assert rows[None, 5400].payload_sha256 == hashlib.sha256(text + bytes(-5400 % 64)).hexdigest()
    blocks = flac.decode_blocks(flac.encode_flac(docs)).where("doc_id is null").orderBy("block").collect()
    assert [r.sample_offset for r in blocks] == list(range(0, 5440, flac.BLOCK)) and b"".join(r.pcm for r in blocks)[:5400] == text
    assert flac.describe_media(flac.encode_flac(docs.limit(0))).count() == 0
    stored = flac.write_media(flac.encode_flac(docs), work_path(spark, "media"))
    assert stored.count() == 4 and set(map(str, flac.describe_media(stored).collect())) == set(map(str, rows.values()))
    real = {r.doc_id: r for r in flac.op10_flac(spark, SF).collect()}
    for d in table(spark, SF, "documents").collect():
        assert real[d.doc_id].payload_sha256 == hashlib.sha256(flac.payload_of(d.text)).hexdigest()


def pages(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (None, None, "same"), (5, "u\r\n5", None), (6, "u6", ""), (6, "u6b", ""), (None, "q", "lone"), (9, "long", "ä" * 200_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


@pytest.mark.parametrize("repeated", [300_000, 0])
def test_archives(spark, monkeypatch, repeated):
    monkeypatch.setattr(warc, "ARCHIVE", 500)
    monkeypatch.setattr(warc, "REPEATED", repeated)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "SMALL_ROWS", 1)
    path = work_path(spark, "warc")
    warc.write_archives(pages(spark), path)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload and len(r.payload)) for r in warc.read_archives(spark, path).collect()), key=str)
    want = [(1, "revisit", 2, 4, None), (2, "response", None, 4, 4), (None, "revisit", 2, 4, None), (5, "revisit", 6, 0, None), (6, "response", None, 0, bytearray()), (6, "response", None, 0, bytearray()), (None, "response", None, 4, 4), (9, "response", None, 400_000, 400_000)]
    assert [tuple(x or 0 if i == 4 else x for i, x in enumerate(r)) for r in got] == sorted([tuple(0 if i == 4 and not x else x for i, x in enumerate(r)) for r in want], key=str)
    records = warc.read_archives(spark, path).collect()
    by_id = {r.record_id: r for r in records}
    assert len(by_id) == 8 and all(by_id[r.refers_to_record].page_id == r.refers_to and by_id[r.refers_to_record].record_type == "response" for r in records if r.refers_to)
    empty = work_path(spark, "warc")
    warc.write_archives(pages(spark).limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0
    short = work_path(spark, "warc")
    warc.write_archives(pages(spark), short, min_bytes=1)
    assert warc.read_archives(spark, short).where("payload_bytes = 0 and record_type = 'response'").count() == 3


def test_damaged_archives():
    record = warc.record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z")
    parsed = warc.parse_record(record)
    assert parsed["payload"] == b"payload" and parsed["page_id"] == 1
    for bad in (record[:-1], record.replace(b"payload", b"pAyload"), record.replace(b"WARC-Date", b"X-Date"), record.replace(b"WARC/1.1", b"WARX/1.1"), record.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    coder = zstandard.ZstdCompressor(write_checksum=True)
    image = struct.pack("<II", warc.SKIPPABLE, 0) + coder.compress(record) + coder.compress(record)
    assert len(warc.read_archive(image)) == 2
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.read_archive(image[:-3])
    packed = zstandard.ZstdCompressor().compress(b"some dictionary " * 20)
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"some dictionary " * 20), write_checksum=True)
    assert len(warc.read_archive(struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + coder.compress(record))) == 1
