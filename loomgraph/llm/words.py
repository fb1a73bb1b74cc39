"""Words and word shingles of many texts at once, as bytes and numpy arrays.

A word is a longest run of digits, lower-cased letters A-Z and characters beyond ASCII.
"""

from __future__ import annotations

import numpy as np

_LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII character that isn't part of a word into a space. UTF-8's other bytes are word bytes.
NORMAL = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in _LOW)


def normal(text: str) -> bytes:
    """The words of a text, each followed by one space."""
    words = text.encode("utf-8", "surrogatepass").translate(NORMAL).split()
    return b" ".join(words) + b" " if words else b""


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd numbers by which the eight bytes of a piece are multiplied first, and what the keys of places start from: one of each for a hash.
_ODD, _FROM = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x165667B19E3779F9, 0x27D4EB2F165667C5)
_TAILS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans of bytes. Every eight bytes are mixed with a key of their place, and the results are summed and mixed with the
    length: no step but the sum is linear, so texts of a regular build collide no more than others. Seeds 0 and 1 mix different numbers, with
    keys of their own, so a collision of one says nothing about the other."""
    length = ends - starts
    pieces = (length + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))[at] & _TAILS[np.minimum(np.repeat(ends, pieces) - at, 8)]
    keys = mixed((np.arange(1, int(pieces.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(_ODD[0])) ^ np.uint64(_FROM[seed]))
    parts = mixed((eight * np.uint64(_ODD[seed])) ^ keys[place])
    sums = np.zeros(len(starts), np.uint64)
    full = pieces > 0
    if full.any():
        sums[full] = np.add.reduceat(parts, first[full])
    return mixed(sums ^ mixed(length.astype(np.uint64) + np.uint64(_FROM[1 - seed])))


def word_hashes(normals: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of normalised texts, and how many words each text has."""
    data = np.frombuffer(b"".join(normals), np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    counts = np.array([b.count(b" ") for b in normals], np.int64)
    return span_hashes(data, starts, ends), counts


def runs(normals: list[bytes], lengths: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of as many words as any of lengths says, whole ones only, and the text of each."""
    hashes, counts = word_hashes(normals)
    found, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    text, last = np.repeat(np.arange(len(counts)), counts), np.repeat(np.cumsum(counts), counts)
    at, out = np.arange(len(hashes)), np.zeros(len(hashes), np.uint64)
    for j in range(max(lengths, default=0)):
        there = at + j < last[at]
        at, out = at[there], out[there]
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j])
        if j + 1 in lengths:
            found.append(mixed(out + np.uint64(j + 1)))
            texts.append(text[at])
    return np.concatenate(found), np.concatenate(texts)


def shingles(normals: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs of so many words, text by text, and each text's number of them; a shorter text with words has one."""
    hashes, counts = word_hashes(normals)
    if not len(hashes):
        return hashes, counts
    first = np.cumsum(counts) - counts
    own = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first, own)
    last = np.repeat(first + counts, own)
    out = np.zeros(len(at), np.uint64)
    for j in range(words):
        here = np.minimum(at + j, len(hashes) - 1)
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < last, hashes[here], np.uint64(0)))
    return out, own
