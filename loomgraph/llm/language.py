"""Language mixtures of documents: expectation-maximisation over words, whose likelihoods come from n-grams of bytes.

The languages of a document are chosen by penalised likelihood: those with less than half a word go first, and of the rest the one with
the least share is left out as long as that doesn't cost more likelihood than a parameter is worth. Fits go on until shares stand still.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import carried, id_text, map_texts, table
from loomgraph.llm.words import normal

#: Labelled documents of each language that the n-gram tables are counted on, about; cells of a table for each length of n-gram.
SAMPLE, CELLS, LENGTHS = 4000, 1 << 15, (3, 4)
#: A word's n-grams overlap, so their evidence counts in part; what a language's parameter costs, times log(words). A fit ends when no
#: share moves by more than STILL, or after STEPS.
TEMPER, PENALTY, STILL, STEPS = 0.5, 1.0, 1e-3, 100
#: Scripts without blanks between words (Thai to Burmese, kana, Han): their runs are cut into words of four characters.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{4})")
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>, has_letter boolean"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # a row for each cell of each length, a column for each language


def grams(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the cells of the n-grams that lie in one word and its two borders, and where they end."""
    out = []
    space = data == 32
    for j, n in enumerate(LENGTHS):
        if len(data) < n:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        code = np.zeros(len(data) - n + 1, np.uint64)
        broken = np.zeros(len(code), bool)
        for i in range(n):
            part = slice(i, len(data) - n + 1 + i)
            code = code * np.uint64(257) + data[part]
            if 0 < i < n - 1:
                broken |= space[part]
        ends = np.flatnonzero(~broken)
        cells = (code[ends] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
        out.append((cells.astype(np.int64) + j * CELLS, ends + n - 1))
    return out


def _bytes(text: str) -> bytes:
    return normal(text.lower() if text.isascii() else UNSPACED.sub(r" \1 ", text.lower()))


def count_grams(df: DataFrame) -> DataFrame:
    """df: lang and text. How often each cell occurs in each language."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(CELLS * len(LENGTHS), np.int64))
                for cells, _ in grams(np.frombuffer(b" " + _bytes(text or ""), np.uint8)):
                    own += np.bincount(cells, minlength=len(own))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "cell", "n"])

    return df.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from about sample documents of each language, those with the smallest hashes of their ids; rows without a label or an id
    aren't used. The driver gets one table of bounded size for each language, and no texts."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and doc_id is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model((), np.zeros((CELLS * len(LENGTHS), 0), np.float32))
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample / n))))
    chosen = rows.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53) < share[F.col("lang")]).select("lang", "text")
    found = count_grams(chosen).toArrow()
    languages = tuple(sorted(counts))
    sums = np.zeros((CELLS * len(LENGTHS), len(languages)))
    which = np.array([languages.index(x) for x in found["lang"].to_pylist()], np.int64)
    sums[found["cell"].to_numpy(), which] = found["n"].to_numpy()
    parts = sums.reshape(len(LENGTHS), CELLS, -1) + 0.3
    return Model(languages, np.log(parts / parts.sum(1, keepdims=True)).reshape(-1, len(languages)).astype(np.float32))


def _mix(e: np.ndarray, first: np.ndarray, of: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document's languages and its log likelihood; start: shares to begin with, where 0 stays 0. Documents whose shares
    stand still drop out, and only the words of the others go on."""
    share, n = start.copy(), np.diff(np.concatenate([first, [len(of)]]))
    going, words, begin, owner = np.arange(len(n)), e, first, of
    for step in range(STEPS):
        old = share[going]
        r = words * old[owner]
        r /= r.sum(1, keepdims=True)
        share[going] = new = np.add.reduceat(r, begin, axis=0) / n[going, None]
        moving = np.abs(new - old).max(1) > STILL
        if not moving.any():
            break
        if step % 4 == 3 and not moving.all():
            words = words[moving[owner]]
            going = going[moving]
            begin = np.cumsum(n[going]) - n[going]
            owner = np.repeat(np.arange(len(going)), n[going])
    return share, np.add.reduceat(np.log((e * share[of]).sum(1)), first)


def mixtures(texts: list[str], model: Model) -> np.ndarray:
    """The shares of languages in each text; rows of texts without words are 0."""
    coded = [_bytes(t) for t in texts]
    out = np.zeros((len(texts), len(model.languages)))
    data = np.frombuffer(b" " + b"".join(coded), np.uint8)
    ends = np.flatnonzero(data == 32)[1:]
    if not len(ends) or not model.languages:
        return out
    word = np.searchsorted(ends, np.arange(len(data)))  # the border after a word is part of it
    total = np.zeros((len(ends), len(model.languages)), np.float32)
    for cells, at in grams(data):
        if len(cells):
            w = word[at]
            begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            total[w[begin]] += np.add.reduceat(model.logs[cells], begin, axis=0)
    counts = np.array([c.count(b" ") for c in coded])
    some = np.flatnonzero(counts)
    of = np.repeat(np.arange(len(some)), counts[some])
    first = np.cumsum(counts[some]) - counts[some]
    e = np.exp(np.maximum(TEMPER * (total - total.max(1, keepdims=True)), -60)).astype(np.float64)
    share, likely = _mix(e, first, of, np.full((len(some), e.shape[1]), 1 / e.shape[1]))
    cost = PENALTY * np.log(counts[some] + 1)
    share, likely = _without(share * counts[some][:, None] < 0.5, e, first, of, share, likely)
    going = np.arange(len(some))
    for _ in range(e.shape[1] - 1):
        going = going[(share[going] > 0).sum(1) > 1]
        if not len(going):
            break
        positive = np.where(share[going] > 0, share[going], np.inf)
        fewer = share[going].copy()
        fewer[np.arange(len(going)), e.shape[1] - 1 - positive[:, ::-1].argmin(1)] = 0  # of equal ones the last by name
        fewer += np.where((share[going] > 0) & (fewer > 0), 1e-6, 0)
        fewer /= fewer.sum(1, keepdims=True)
        rows = np.isin(of, going) if len(going) < len(some) else slice(None)
        n = counts[some][going]
        own, l2 = _mix(e[rows], np.cumsum(n) - n, np.repeat(np.arange(len(going)), n), fewer)
        better = l2 + cost[going] >= likely[going]
        share[going[better]], likely[going[better]] = own[better], l2[better]
        going = going[better]
    out[some] = share
    return out


def _without(gone: np.ndarray, e: np.ndarray, first: np.ndarray, of: np.ndarray, share: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares and likelihoods of the documents without the languages marked, of which a document has others."""
    rows = np.flatnonzero((gone & (share > 0)).any(1) & ~gone.all(1))
    if len(rows):
        fewer = np.where(gone[rows], 0, share[rows])
        n = np.diff(np.concatenate([first, [len(of)]]))[rows]
        own = _mix(e[np.isin(of, rows)], np.cumsum(n) - n, np.repeat(np.arange(len(rows)), n), fewer / fewer.sum(1, keepdims=True))
        share, likely = share.copy(), likely.copy()
        share[rows], likely[rows] = own
    return share, likely


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The language with the largest share (the first by name of equal ones), that share, and all languages of the chosen set.

    A text that is null or has no letter is und with score 0, and so is every text if nothing was learned; has_letter tells them apart.
    Every row stays, with null ids and repeats. A text is looked at whole, at about 50 bytes of memory for one of it, and 40 for a word and
    language. With carry, a column row holds all columns of the input.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # CELLS * len(LENGTHS) * 4 bytes a language

    def make():
        known = sent.value

        def one(ids, texts):
            letters = [any(map(str.isalpha, t)) for t in texts]
            share = mixtures(texts, known)
            langs, scores, sets = [], [], []
            for ok, s in zip(letters, share):
                if not ok or not s.any():
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    sets.append([])
                    continue
                best = int(s.argmax())
                langs.append(known.languages[best])
                scores.append(min(1.0, float(s[best])))
                sets.append([{"lang": known.languages[i], "share": float(s[i])} for i in np.argsort(-s, kind="stable").tolist() if s[i] > 0])
            return ids, langs, scores, sets, letters

        return one

    return map_texts((carried if carry else id_text)(df, id_col, text_col), RESULT, make)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~fold))
    found = identify(docs, model)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", F.transform("languages", lambda x: x["lang"]).alias("languages"))
