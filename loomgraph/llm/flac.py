"""FLAC streams of 8-bit mono samples as media columns: Rice-coded residuals of fixed and linear predictors.

Frames of many streams are handled side by side in numpy, one lane a frame. Every frame has a seek point, so a reader finds any
sample offset, and the decoder all frames, without decoding what comes before.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import id_text, map_texts, table, work_path

BLOCK, RATE, PAD = 2048, 8000, 64
#: Order and bits of the linear predictor's coefficients; partitions of a frame's residuals as a power of two; Rice parameters tried.
ORDER, PRECISION, PARTITIONS, PARAMETERS = 4, 12, 2, 9
#: Coefficients of the format's fixed predictors, the latest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MEDIA = "doc_id bigint, n_bytes bigint, media binary"


def _crc_table(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        c = ((c << 1) ^ np.where(c >> (bits - 1) & 1, poly, 0)) & ((1 << bits) - 1)
    return c


@lru_cache(4)
def _crc16_by_distance(length: int) -> np.ndarray:
    """What a byte adds to a checksum if so many bytes follow it; one row for each distance."""
    first = _crc_table(0x8005, 16)
    rows = [first]
    for _ in range(length - 1):
        rows.append((rows[-1] << 8 & 0xFFFF) ^ first[rows[-1] >> 8])
    return np.array(rows, np.uint16)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksums of pieces of data, of at least one byte each; a checksum is linear, so its bytes' shares are joined by xor."""
    longest = int(lengths.max())
    shares = _crc16_by_distance(1 << (longest - 1).bit_length()).reshape(-1)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + inside
    after = np.repeat(lengths, lengths) - 1 - inside
    return np.bitwise_xor.reduceat(shares[(after << 8) + data[at]], np.cumsum(lengths) - lengths)


@lru_cache(1)
def _crc8_table() -> list[int]:
    return _crc_table(0x07, 8).tolist()


@lru_cache(100_000)
def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _crc8_table()[c ^ b]
    return c


def _coded_number(n: int) -> bytes:
    """UTF-8's scheme, carried on to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail, most = [], 0x3F
    while n > most or not tail:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        most >>= 1
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *tail[::-1]])


@lru_cache(100_000)
def frame_head(number: int, n: int) -> bytes:
    head = bytes([0xFF, 0xF8, (7 + (BLOCK // 256).bit_length() << 4 if n == BLOCK else 0x70), 0x02]) + _coded_number(number)
    if n != BLOCK:
        head += struct.pack(">H", n - 1)
    return head + bytes([crc8(head)])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (rounded), shift and residuals of each row by autocorrelation and the Levinson-Durbin recursion."""
    f, n = x.shape
    y = x.astype(np.float32)
    auto = np.stack([np.einsum("ij,ij->i", y[:, : n - j], y[:, j:]) for j in range(ORDER + 1)], 1).astype(np.float64)
    error = auto[:, 0] * (1 + 1e-6) + 1e-3
    a = np.zeros((f, ORDER))
    for i in range(ORDER):
        k = (auto[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], auto[:, i:0:-1])) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error *= np.maximum(1 - k * k, 1e-9)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.abs(a).max(1) + 1e-9)), 0, 14).astype(np.int32)
    most = (1 << (PRECISION - 1)) - 1
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -most, most).astype(np.int32)
    guess = np.zeros((f, n - ORDER), np.int32)
    for j in range(ORDER):
        guess += q[:, j : j + 1] * x[:, ORDER - 1 - j : n - 1 - j]
    residual = np.zeros((f, n), np.int32)
    residual[:, ORDER:] = x[:, ORDER:] - (guess >> shift[:, None])
    return q, shift, residual


def _rice(folded: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of folded residuals (0 before their order), each partition's best parameter, and the bits of all codes."""
    f, n = folded.shape
    parts = folded.reshape(f, 1 << PARTITIONS, -1)
    counts = np.full((f, 1 << PARTITIONS), parts.shape[2])
    counts[:, 0] -= order
    bits = np.stack([(parts >> k).sum(2, dtype=np.int64) + counts * (k + 1) for k in range(PARAMETERS)], 2)
    return bits.argmin(2), bits.min(2).sum(1)


def _fold(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + (width - 1 - j)] = values >> j & 1


def encode_frames(x: np.ndarray, heads: list[bytes]) -> list[bytes]:
    """Rows of equally many samples (a multiple of 64) become frames; the smallest of the subframe kinds is taken for each."""
    f, n = x.shape
    x = x.astype(np.int32)
    tries = [x]
    for _ in range(4):
        tries.append(np.diff(tries[-1], axis=1))
    size = np.stack([np.abs(d[:, 4 - o :]).sum(1) for o, d in enumerate(tries)], 1)
    order = size.argmin(1)
    residual = np.zeros((f, n), np.int32)
    for o in range(5):
        if (rows := np.flatnonzero(order == o)).size:
            residual[rows, o:] = tries[o][rows]
    del tries
    folded = _fold(residual)
    params, cost = _rice(folded, order)
    q, shift, residual = _linear(x)
    linear_folded = _fold(residual)
    linear_params, linear_cost = _rice(linear_folded, np.full(f, ORDER))
    cost, linear_cost = cost + 8 * order, linear_cost + 8 * ORDER + 9 + PRECISION * ORDER
    linear = linear_cost < cost
    folded[linear], params[linear], order[linear] = linear_folded[linear], linear_params[linear], ORDER
    cost = np.minimum(cost, linear_cost) + 6 + (4 << PARTITIONS)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (cost >= 8 * n)
    coded = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * n, cost)) + 8
    head = np.array([len(h) for h in heads])
    size = head + (body + 7) // 8 + 2
    start = np.cumsum(size) - size
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    at = 8 * (start + head)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(linear, 31 + ORDER, 8 + order)))
    _put(bits, at, kind << 1, 8)
    at = at + 8
    low = x & 0xFF
    _put(bits, at[constant], low[constant, 0], 8)
    if verbatim.any():
        _put(bits, (at[verbatim, None] + 8 * np.arange(n)).reshape(-1), low[verbatim].reshape(-1), 8)
    rows = np.flatnonzero(coded)
    if rows.size:
        at, order, linear, folded, params = at[rows], order[rows], linear[rows], folded[rows], params[rows]
        for j in range(ORDER):
            on = order > j
            _put(bits, at[on] + 8 * j, low[rows[on], j], 8)
        at = at + 8 * order
        lp = rows[linear]
        _put(bits, at[linear], np.full(len(lp), PRECISION - 1), 4)
        _put(bits, at[linear] + 4, shift[lp], 5)
        for j in range(ORDER):
            _put(bits, at[linear] + 9 + PRECISION * j, q[lp, j] & ((1 << PRECISION) - 1), PRECISION)
        at = at + np.where(linear, 9 + PRECISION * ORDER, 0)
        _put(bits, at, np.full(len(rows), PARTITIONS), 6)
        at = at + 6
        each = n >> PARTITIONS
        k = np.repeat(params, each, axis=1).astype(np.int32)
        quotient = folded >> k
        length = quotient + 1 + k
        there = np.arange(n) >= order[:, None]
        length[~there] = 0
        length[:, ::each] += 4
        ends = np.cumsum(length, axis=1) + at[:, None]
        for j in range(1 << PARTITIONS):
            _put(bits, ends[:, j * each] - length[:, j * each], params[:, j], 4)
        ends, k, folded = ends[there], k[there], folded[there]
        bits[ends - k - 1] = 1
        for j in range(int(k.max(initial=0))):
            on = k > j
            bits[ends[on] - 1 - j] = folded[on] >> j & 1
    data = np.packbits(bits)
    where = np.arange(int(head.sum())) - np.repeat(np.cumsum(head) - head, head) + np.repeat(start, head)
    data[where] = np.frombuffer(b"".join(heads), np.uint8)
    sums = crc16(data, start, size - 2)
    data[start + size - 2], data[start + size - 1] = sums >> 8, sums & 0xFF
    whole = data.tobytes()
    return [whole[i:j] for i, j in zip(start.tolist(), (start + size).tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose length is a positive multiple of 64; byte b is the sample b - 128."""
    by_length: dict[int, list[tuple[int, int, bytes]]] = {}
    frames: list[list[bytes]] = []
    for i, p in enumerate(payloads):
        if not p or len(p) % PAD:
            raise ValueError("a payload has a positive multiple of 64 bytes")
        parts = range(0, len(p), BLOCK)
        frames.append([b""] * len(parts))
        for j, at in enumerate(parts):
            by_length.setdefault(min(BLOCK, len(p) - at), []).append((i, j, p[at : at + BLOCK]))
    for n, some in by_length.items():
        x = np.frombuffer(b"".join(b for _, _, b in some), np.uint8).reshape(-1, n).astype(np.int32) - 128
        for (i, j, _), frame in zip(some, encode_frames(x, [frame_head(j, n) for _, j, _ in some])):
            frames[i][j] = frame
    out = []
    for p, own in zip(payloads, frames):
        block = min(BLOCK, len(p))
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + (RATE << 44 | 7 << 36 | len(p)).to_bytes(8) + hashlib.md5(signed).digest()
        at, points = 0, []
        for j, size in enumerate(sizes):
            points.append(struct.pack(">QQH", j * BLOCK, at, min(BLOCK, len(p) - j * BLOCK)))
            at += size
        out.append(b"".join([b"fLaC", b"\0", len(info).to_bytes(3), info, b"\x83", (18 * len(points)).to_bytes(3), *points, *own]))
    return out


def _stream_head(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples, MD5, seek points (sample, offset, samples) and the place of the first frame."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4])
        block = media[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3:
            points = list(struct.iter_unpack(">QQH", block))
        at += 4 + size
    packed = int.from_bytes(info[10:18])
    if packed >> 36 & 0xFF != 7:
        raise ValueError("8-bit mono streams only")
    total = packed & ((1 << 36) - 1)
    if sum(p[2] for p in points) != total:
        raise ValueError("a stream without a seek point for each frame")
    return total, info[18:34], points, at


def _check_head(media: bytes, at: int, n: int, number: int) -> int:
    """The head's length, once its fields and checksum are right."""
    first = media[at + 4]
    more = 0 if first < 0x80 else 7 - (first ^ 0xFF).bit_length()
    size = 5 + more + (2 if media[at + 2] >> 4 == 7 else 0) + 1
    head = media[at : at + size]
    if crc8(head[:-1]) != head[-1] or head != frame_head(number, n):
        raise ValueError("a frame's head is damaged")
    return size


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams; every checksum, length and MD5 is verified.

    Reads what this module's encoder writes: 8-bit mono, frame heads as frame_head() makes them, and a seek point for each frame. Other
    valid streams (wasted bits, unencoded residuals, other frame heads, fewer seek points) raise ValueError, too.
    """
    heads = [_stream_head(m) for m in streams]
    out = _frames(streams, heads, [(0, len(points)) for _, _, points, _ in heads])
    for own, (_, md5, _, _) in zip(out, heads):
        if hashlib.md5(own.tobytes()).digest() != md5:
            raise ValueError("a stream's MD5 is wrong")
    return [(own ^ 0x80).tobytes() for own in out]


def read_samples(streams: list[bytes], starts: list[int], counts: list[int]) -> list[bytes]:
    """So many bytes of each stream's payload from a sample offset on (fewer where it ends before). The seek table leads to the frames
    that hold them; only those are decoded, and their checksums verified."""
    heads, picks = [_stream_head(m) for m in streams], []
    for (_, _, points, _), start, n in zip(heads, starts, counts):
        firsts = [p[0] for p in points]
        picks.append((max(0, bisect_right(firsts, start) - 1), bisect_left(firsts, start + n)) if n > 0 else (0, 0))
    out = []
    for own, (_, _, points, _), (i, _), start, n in zip(_frames(streams, heads, picks), heads, picks, starts, counts):
        skip = start - points[i][0]
        out.append((own[skip : skip + max(n, 0)] ^ 0x80).tobytes())
    return out


def _frames(streams: list[bytes], stream_heads: list[tuple], picks: list[tuple[int, int]]) -> list[np.ndarray]:
    """The samples of each stream's frames from one number to another (exclusive), as signed bytes in unsigned ones."""
    base, starts, ends, heads, lengths, totals = 0, [], [], [], [], []
    for media, (_, _, points, at), (i, j) in zip(streams, stream_heads, picks):
        for number in range(i, j):
            _, offset, n = points[number]
            starts.append(base + at + offset)
            ends.append(base + at + points[number + 1][1] if number + 1 < len(points) else base + len(media))
            heads.append(_check_head(media, at + offset, n, number))
            lengths.append(n)
        totals.append(sum(p[2] for p in points[i:j]))
        base += len(media)
    if not lengths:
        return [np.zeros(0, np.uint8) for _ in streams]
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    start, end, head, n = (np.array(v, np.int64) for v in (starts, ends, heads, lengths))
    sums = crc16(data, start, end - start - 2)
    if not (sums == (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).all():
        raise ValueError("a frame's checksum is wrong")
    whole = (_decode_frames(data, start + head, n) & 0xFF).astype(np.uint8)
    return np.split(whole, np.cumsum(totals)[:-1])


def _decode_frames(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All frames' samples, joined; at: where each frame's subframe begins, in bytes. Lanes go from long to short frames."""
    window = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))

    def take(bit: np.ndarray, width) -> np.ndarray:
        w = window[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)
        return (w >> np.uint64(1) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    kind = data[at] >> 1
    if (data[at] & 0x81).any():
        raise ValueError("wasted bits aren't supported")
    lanes = np.argsort(-n, kind="stable")
    at, kind, length = 8 * (at[lanes] + 1), kind[lanes].astype(np.int64), n[lanes]
    linear, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if not (linear | fixed | (kind <= 1)).all():
        raise ValueError("an unknown kind of subframe")
    order = np.where(linear, kind - 31, np.where(fixed, kind - 8, 0))
    most, longest = int(order.max()), int(length[0])
    x = np.zeros((longest + most, len(at)), np.int32)  # a step's samples lie side by side; the first rows stay 0
    out = lambda: np.concatenate([x[most : most + m, i] for i, m in zip(np.argsort(lanes), n.tolist())])
    for i in np.flatnonzero(kind <= 1).tolist():
        own = data[at[i] // 8 : at[i] // 8 + (1 if kind[i] == 0 else int(length[i]))].astype(np.int8)
        x[most : most + length[i], i] = own
    rows = np.flatnonzero(kind > 1)
    if not rows.size:
        return out()
    at, order, length, linear = at[rows], order[rows], length[rows], linear[rows]
    c, shift, got = np.zeros((most, len(rows)), np.int32), np.zeros(len(rows), np.int32), np.zeros((longest + most, len(rows)), np.int32)
    for j in range(most):
        on = order > j
        got[most + j, on] = take(at[on] + 8 * j, 8).astype(np.uint8).view(np.int8)
    at = at + 8 * order
    precision = take(at, 4) + 1
    shift[linear] = take(at + 4, 5)[linear]
    for j in range(most):
        on = linear & (order > j)
        v = take(at[on] + 9 + precision[on] * j, precision[on])
        c[j, on] = v - ((v >> (precision[on] - 1)) << precision[on])
        for o in range(j + 1, 5):
            c[j, ~linear & (order == o)] = FIXED[o][j]
    at = at + np.where(linear, 9 + precision * order, 0)
    wide = take(at, 2) + 4
    each = length >> take(at + 2, 4)
    at = at + 6
    if (wide > 5).any() or (each < np.maximum(order, 1)).any():
        raise ValueError("a residual's head is damaged")
    k = np.zeros(len(rows), np.int64)
    borders = sorted({s for e in np.unique(each).tolist() for s in range(0, longest, e)})
    active = np.searchsorted(-length, -np.arange(longest), "left").tolist()  # lanes longer than the step
    for s in range(longest):
        a = active[s]
        if borders and borders[0] == s or s <= most:
            new = np.flatnonzero(((s % each[:a] == 0) & (s >= order[:a])) | (s == order[:a]))
            if borders and borders[0] == s:
                borders.pop(0)
            k[new] = take(at[new], wide[new])
            if (k[new] == (1 << wide[new]) - 1).any():
                raise ValueError("unencoded residuals aren't supported")
            at[new] += wide[new]
        lane = slice(0, a) if s >= most else np.flatnonzero(s >= order[:a])
        p, kk = at[lane], k[lane]
        w = window[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        top = (w >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(top)[1].astype(np.int64)
        if (top == 0).any():  # long runs of zeros are followed word by word
            for i in np.flatnonzero(top == 0).tolist():
                bit, zeros = int(p[i]), 0
                while not data[bit >> 3] >> (7 - (bit & 7)) & 1:
                    bit, zeros = bit + 1, zeros + 1
                q[i] = zeros
            rest = take(p + q + 1, kk)
        else:
            rest = ((w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        u = (q << kk) | rest
        at[lane] = p + q + 1 + kk
        value = ((u >> 1) ^ -(u & 1)).astype(np.int32)
        guess = np.zeros(len(value), np.int32)
        for j in range(most):
            guess += c[j, lane] * got[most + s - 1 - j, lane]
        got[most + s, lane] = value + (guess >> shift[lane])
    x[:, rows] = got
    return out()


def payload_of(text: str) -> bytes:
    b = text.encode()
    return b + bytes(-len(b) % PAD or (0 if b else PAD))


def encode_flac(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's whole text (null: empty) as UTF-8, zeros up to a positive multiple of 64, in a FLAC media column; n_bytes is unpadded.

    Every row stays, with null ids and repeats; an empty table gives no rows; other columns of the input don't matter.
    """

    def make():
        def one(ids, texts):
            return ids, [len(t.encode()) for t in texts], encode([payload_of(t) for t in texts])

        return one

    return map_texts(id_text(df, id_col, text_col), MEDIA, make, 4_000_000)


def _map_media(media: DataFrame, schema: str, one) -> DataFrame:
    """one(ids, sizes, streams) gives the columns of schema for some rows of a media table."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from loomgraph.llm.common import slices

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(2), 4_000_000):
                columns = one(*(c.slice(i, j - i).to_pylist() for c in b.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def decode_blocks(media: DataFrame) -> DataFrame:
    """PCM blocks (unsigned bytes) of a media table, each with the sample offset at which it starts."""

    def one(ids, sizes, streams):
        rows = [(i, at // BLOCK, at, min(BLOCK, len(p) - at), p[at : at + BLOCK]) for i, p in zip(ids, decode(streams)) for at in range(0, len(p), BLOCK)]
        return list(zip(*rows)) or [[]] * 5

    return _map_media(media, "doc_id bigint, block bigint, sample_offset bigint, n_samples bigint, pcm binary", one)


def feature(payload: bytes) -> str:
    """Peak, root mean square and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    up = x >= 0
    return f"peak={int(np.abs(x).max())};rms={float(np.sqrt((x * x).mean())):.4f};crossings={int((up[1:] != up[:-1]).sum())}"


def describe_media(media: DataFrame) -> DataFrame:
    """Sizes, digests and features of a media table's rows, from the samples that its bytes decode to; the last samples are found by the
    seek table."""

    def one(ids, sizes, streams):
        payloads = decode(streams)
        sha = [hashlib.sha256(p).hexdigest() for p in payloads]
        tails = read_samples(streams, [len(p) - PAD for p in payloads], [PAD] * len(payloads))
        return ids, sizes, [len(p) for p in payloads], sha, [zlib.crc32(t) for t in tails], [len(m) for m in streams], [hashlib.sha256(m).hexdigest() for m in streams], [feature(p) for p in payloads]

    return _map_media(media, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", one)


def write_media(media: DataFrame, path: str) -> DataFrame:
    """Stores a media table below path and reads it back. Pages are in Zstandard, which takes in seek tables and copies."""
    media.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": 9}).parquet(path)
    return media.sparkSession.read.schema(MEDIA).parquet(path)


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(write_media(encode_flac(table(spark, sf_dir, "documents")), work_path(spark, "media")))
