"""Text of simple PDF files: content streams, plain or deflated, whose strings are in one-byte encodings."""

from __future__ import annotations

import re
import zlib

STREAM = re.compile(rb"obj\s*<<((?:(?!endobj|stream).)*+)stream\r?\n", re.S)
#: A string in parentheses (brackets inside guarded, or one pair deep), one in hexadecimal digits, or an operator.
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*+\))*+\)|<[0-9A-Fa-f\s]*>|[A-Za-z'\"*]+|\[|\]|-?\d*\.?\d+", re.S)
GUARDED = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
#: What letters after a backslash stand for.
LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    plain = GUARDED.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else LETTERS.get(m[1], m[1]), token[1:-1])
    return plain.decode("latin-1")


def _shown(content: bytes) -> str:
    """The strings that text operators show; a new line where the operators move to one."""
    out, held, inside = [], [], False
    for m in TOKEN.finditer(content):
        t = m[0]
        if t in (b"BT", b"ET"):
            inside, held = t == b"BT", []
        elif not inside:
            continue
        elif t[:1] in b"(<":
            held.append(_string(t))
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            out.append(("\n" if t in b"'\"" and out else "") + "".join(held))
            held = []
        elif t in (b"Td", b"TD", b"T*", b"Tm") and out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out).rstrip("\n")


def pdf_text(data: bytes) -> str:
    """The text of all content streams, in the file's order, nothing between them. ValueError for files that are no PDF, are encrypted, or
    show no such text (images of pages, and fonts with multi-byte codes, need a real extractor)."""
    if not data.lstrip()[:5] == b"%PDF-" or b"/Encrypt" in data:
        raise ValueError("no PDF that can be read")
    parts = []
    for m in STREAM.finditer(data):
        end = data.find(b"endstream", m.end())
        content = data[m.end() : end if end >= 0 else len(data)]
        if b"/FlateDecode" in m[1]:
            try:
                content = zlib.decompressobj().decompress(content)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        if b"BT" in content:
            parts.append(_shown(content))
    if not any(p.strip() for p in parts):
        raise ValueError("no text in the PDF")
    return "".join(parts)
