"""A quality classifier: a generalised additive model with pairwise interactions over features of texts.

Shallow trees are boosted in turn, feature by feature, then pair by pair; each tree only adds to the feature's lookup table, so a
document's score is a sum of one cell from each table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import carried, id_text, map_texts, table
from loomgraph.llm.words import word_hashes, normal

#: Labelled documents that the model is fitted on, at most about; bins of a feature; bins of each side of a pair.
SAMPLE, BINS, PAIR_BINS = 20_000, 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SHRINK = 120, 40, 6, 0.1, 2.0
FEATURES = ("bytes", "words", "lines", "upper", "digit", "exclaim", "bar", "symbol", "mark", "space", "beyond", "word_length", "longest_word", "distinct", "repeats", "commonest", "words_a_line", "same_line", "sentence")

_CLASSES = np.zeros((8, 256), np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#$%&*<>@\\^_`{}~=+/[]", b".,;:?'\"()-", b" \t\r\n")):
    _CLASSES[_i, list(_chars)] = 1
_CLASSES[7, 128:] = 1


def features(texts: list[str]) -> np.ndarray:
    """A row of numbers for each text; an empty text's are 0."""
    out = np.zeros((len(texts), len(FEATURES)))
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    data = np.frombuffer(b"".join(coded), np.uint8)
    n, first = sizes[some], (np.cumsum(sizes) - sizes)[some]
    shares = np.stack([np.add.reduceat(c[data].astype(np.int64), first) for c in _CLASSES], 1) / n[:, None]
    newlines = np.add.reduceat((data == 10).astype(np.int64), first)
    stops = np.add.reduceat((data == 46).astype(np.int64), first)
    normals = [normal(texts[i]) for i in some]
    hashes, words = word_hashes(normals)
    of = np.repeat(np.arange(len(some)), words)
    lengths = np.diff(np.concatenate([[-1], np.flatnonzero(np.frombuffer(b"".join(normals), np.uint8) == 32)])) - 1
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([new, [len(h)]]))
    distinct = np.bincount(o[new], minlength=len(some))
    commonest, longest = np.zeros(len(some)), np.zeros(len(some))
    np.maximum.at(commonest, o[new], runs)
    np.maximum.at(longest, of, lengths)
    twice = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=len(some)) if len(of) else np.zeros(len(some))
    w = np.maximum(words, 1)
    same = np.array([1 - len(set(x)) / len(x) for x in (texts[i].split("\n") for i in some)])
    columns = [np.log1p(n), np.log1p(words), np.log1p(newlines), *shares[:, :3].T, *shares[:, 3:6].T, shares[:, 6], shares[:, 7]]
    columns += [np.bincount(of, lengths, len(some)) / w, longest, distinct / w, twice / w, commonest / w, words / (newlines + 1), same, words / (stops + 1)]
    out[some] = np.stack(columns, 1)
    return out


@dataclass
class Model:
    """edges: where each feature's bins end. tables: what each bin adds. pairs: two features, the edges of each, and a table."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, f], "right")]
        for f, g, e, d, t in self.pairs:
            total += t[np.searchsorted(e, x[:, f], "right"), np.searchsorted(d, x[:, g], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins)) if len(v) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a tree of up to four leaves gives each bin, from the gradient and the weight that bins hold."""
    bounds = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(3):
        best, cut = 1e-9, None
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = _gain(cg[k] - cg[a], ch[k] - ch[a]) + _gain(cg[b] - cg[k], ch[b] - ch[k]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                if gain.max() > best:
                    best, cut = gain.max(), int(k[gain.argmax()])
        if cut is None:
            break
        bounds = sorted([*bounds, cut])
    out = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of each side makes four leaves; its gain, and what it gives each cell."""
    best, out = 0.0, np.zeros(g.shape)
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return best, out

    def quarters(c):
        a, left, top, whole = c[i, j], c[i, -1], c[-1, j], c[-1, -1]
        return a, left - a, top - a, whole - left - top + a

    gains = sum(_gain(a, b) for a, b in zip(quarters(cg), quarters(ch)))
    at = np.unravel_index(gains.argmax(), gains.shape)
    x, y = int(at[0]) + 1, int(at[1]) + 1
    for rows in (slice(0, x), slice(x, None)):
        for cols in (slice(0, y), slice(y, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + SHRINK)
    return float(gains.max()), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on the log loss. Without both labels the score is the labels' mean, or one half without any."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    edges = [_edges(x[:, f], BINS) for f in range(x.shape[1])]
    model = Model(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.base)
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    for _ in range(ROUNDS):
        for b, t in zip(binned, model.tables):
            p = 1 / (1 + np.exp(-total))
            step = RATE * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
            t += step
            total += step[b]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-total))

    def sums(f: int, g: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(coarse[f]) + 1, len(coarse[g]) + 1
        at = cells[f] * shape[1] + cells[g]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(((-_pair_tree(*sums(f, g, p))[0], f, g) for f in range(x.shape[1]) for g in range(f)))[:PAIRS]
    model.pairs = [(f, g, coarse[f], coarse[g], np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))) for _, f, g in ranked]
    for _ in range(PAIR_ROUNDS):
        for f, g, _, _, t in model.pairs:
            p = 1 / (1 + np.exp(-total))
            step = RATE * _pair_tree(*sums(f, g, p))[1]
            t += step
            total += step[cells[f], cells[g]]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on about sample labelled documents at most, those whose ids have the smallest hashes; rows without an id or a label don't count.
    Of an id's labels the smallest one counts, and of its rows that with the smallest features, so repeated ids are one document.

    The sampled labels are broadcast (sample rows of two numbers), and only features of those documents reach the driver.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"))
    share = min(1.0, sample / max(1, rows.count()))
    rows = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53) < share)
    joined = id_text(docs, id_col, text_col).join(F.broadcast(rows), "doc_id").select("doc_id", "text", "y")
    each = map_texts(joined, "doc_id long, y long, x array<double>", lambda: lambda ids, texts, y: (ids, y, list(features(texts))))
    found = each.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    y = found["y"].to_numpy().astype(float)
    x = np.array(found["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the sums' order, and so the model, doesn't hang on the tasks' order
    return fit(x[order], y[order])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """How likely each whole text (null: empty) is of quality 1. Every row stays, with null ids and repeats; an empty table gives none. A text
    is measured whole, at about 100 bytes of memory for a word of it."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        known = sent.value
        return lambda ids, texts: (ids, known.score(features(texts)))

    return map_texts((carried if carry else id_text)(df, id_col, text_col), "doc_id long, score double", make)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = train(docs.where(~fold), table(spark, sf_dir, "labels").where(~fold))
    return score(docs, model).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
