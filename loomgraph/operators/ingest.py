"""From documents to chunks: guards, page joins, splitting, part labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import is_blank

SIZE, OVERLAP = 30_000, 200
SEPARATORS = ("\n\n", "\n", " ")
#: Texts become Python objects in slices of about this many bytes, and their parts go out with them.
SLICE = 1_000_000


def guard_reason(text: Column | str = "text") -> Column:
    """Why a document is left out, or null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNull(), "missing").when(F.length(c) == 0, "empty").when(F.startswith(c, F.lit("ERROR:")), "error").when(is_blank(c), "blank")


def guarded(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents that pass, and those that don't with a reason."""
    marked = docs.withColumn("reason", guard_reason(text))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def joined_pages(pages: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """The pages of each document in order, without anything between them."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "").alias(text))


def _checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("an overlap is smaller than a part")


def chunk_fixed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Documents of more than size characters as parts of size that overlap; others whole. Rows: key, part (from 1), parts, text."""
    _checked(size, overlap)
    stride = size - overlap
    n = F.when(F.length(text) > size, F.ceil((F.length(text) - overlap) / F.lit(stride))).otherwise(F.lit(1)).cast("int")
    rows = docs.select(F.col(key), F.col(text).alias("whole"), n.alias("parts")).select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    own = F.when(F.col("parts") == 1, F.col("whole")).otherwise(F.substring("whole", (F.col("part") - 1) * stride + 1, F.lit(size)))
    return rows.select(key, "part", "parts", own.alias("text"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Parts of at most size characters in order, that cut after a paragraph, a line or a word where there is one past the overlap."""
    _checked(size, overlap)
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        for s in SEPARATORS:
            cut = text.rfind(s, at + overlap + 1, end)
            if cut >= 0:
                end = cut + len(s)
                break
        out.append(text[at:end])
        at = end - overlap
    return [*out, text[at:]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the batches whose texts, the second column, are of about SLICE bytes; of one row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
            yield b.slice(start, stop - start)
            start = stop


def chunk_by_separators(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """As chunk_fixed, but cuts at separators; the cuts depend on those before, so this runs on slices of Arrow batches."""
    _checked(size, overlap)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            parts = [split_text(t or "", size, overlap) for t in b.column(1).to_pylist()]
            counts = [len(p) for p in parts]
            rows = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([k for n in counts for k in range(1, n + 1)], pa.int32()), pa.array(counts, pa.int32()).take(rows), pa.array([x for p in parts for x in p], pa.string())], [key, "part", "parts", "text"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, part int, parts int, text string")


def recursive_spans(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = (*SEPARATORS, "")) -> list[tuple[int, int]]:
    """Where the parts of a text begin and end, by recursive splitting and merging.

    A stretch is cut before each of the first separator that it holds (the empty one cuts everywhere). Pieces shorter than size that follow
    each other are merged into parts of size at most, the next part beginning with as many whole pieces of the last one as overlap holds;
    a longer piece ends such a row, and is split by the separators that are left, or is a part itself if none is. White space at a part's
    ends goes, and so do parts of nothing else. A stack takes the place of recursion.
    """
    _checked(size, overlap)
    out: list[tuple[int, int]] = []

    def merged(row: list[tuple[int, int]]) -> None:
        first = total = 0
        for at, (a, b) in enumerate(row):
            if total + b - a > size and at > first:
                trimmed(row[first][0], a)
                while first < at and (total > overlap or total + b - a > size):
                    total -= row[first][1] - row[first][0]
                    first += 1
            total += b - a
        if first < len(row):
            trimmed(row[first][0], row[-1][1])

    def trimmed(a: int, b: int) -> None:
        part = text[a:b]
        left, right = len(part) - len(part.lstrip()), len(part) - len(part.rstrip())
        if left < b - a:
            out.append((a + left, b - right))

    def pieces(a: int, b: int, level: int) -> tuple[list[tuple[int, int]], int]:
        while separators[level] and text.find(separators[level], a, b) < 0 and level + 1 < len(separators):
            level += 1
        sign, cuts = separators[level], [a]
        if not sign:
            return [(i, i + 1) for i in range(a, b)], level + 1
        at = text.find(sign, a, b)
        while at >= 0:
            if at > cuts[-1]:
                cuts.append(at)
            at = text.find(sign, at + len(sign), b)
        return list(zip(cuts, [*cuts[1:], b])), level + 1

    def rest(found: list[tuple[int, int]], level: int) -> list[tuple[str, list[tuple[int, int]], int]]:
        """Rows to merge and long pieces to split, in order."""
        steps, row = [], []
        for a, b in found:
            if b - a < size:
                row.append((a, b))
            else:
                steps += [("merge", row, 0)] * bool(row) + [("split", [(a, b)], level)]
                row = []
        return steps + [("merge", row, 0)] * bool(row)

    todo = [("split", [(0, len(text))], 0)] if text else []
    while todo:
        kind, row, level = todo.pop()
        if kind == "merge":
            merged(row)
        elif level >= len(separators):
            trimmed(*row[0])
        else:
            todo += reversed(rest(*pieces(*row[0], level)))
    return out


def chunk_recursively(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Documents of more than size characters as the parts of recursive_spans(); others whole, nulls as empty. Rows: key, part (from 1),
    parts, text. A document of white space only has no part, if it is that long."""
    _checked(size, overlap)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for name, t in zip(b.column(0), b.column(1).to_pylist()):  # a document's parts at once
                t = t or ""
                parts = [t[i:j] for i, j in recursive_spans(t, size, overlap)] if len(t) > size else [t]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, b.column(0).type), pa.array(range(1, n + 1), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(parts, pa.string())], [key, "part", "parts", "text"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, part int, parts int, text string")


def labelled(chunks: DataFrame, source: Column | str) -> DataFrame:
    """Parts of split documents say which they are, before their text; the label comes on top of the size."""
    source = F.lit(source) if isinstance(source, str) else source
    label = F.format_string("[Part %d of %d from %s] ", "part", "parts", source)
    return chunks.withColumn("text", F.when(F.col("parts") > 1, F.concat(label, F.col("text"))).otherwise(F.col("text")))


def oversize(text: Column | str = "text", size: int = SIZE) -> Column:
    return F.length(text) > 2 * size
