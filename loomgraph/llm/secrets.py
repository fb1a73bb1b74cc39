"""Secret scans: patterns, and the guess cost of values in credential contexts.

The cost of a value is the least sum, over all its segmentations into dictionary words, dates, repeats, keyboard walks and brute-force
spans, of what each segment takes to guess, as a logarithm to base 10. A repeat costs what its unit costs, by the same rule, and the
number of times. A value that is hard to guess is a secret.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from math import log10

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import id_text, map_texts, table
from loomgraph.llm.tokens import vocabulary

KINDS = ("assign", "access", "hex", "guess")
#: A value that takes 10 to this power guesses is a secret.
MIN_COST = 9.0
#: What every higher cost is given as: nobody guesses so long, and a segmentation that costs so much needn't be gone on with. Values whose
#: cost a task remembers.
BEYOND, KNOWN = 40.0, 50_000
RESULT = "doc_id long, spans array<struct<kind: string, start: long, end: long, cost: double>>"

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private)[_-]?key|auth|credentials?)[\"']?[\x20\t]*(?:=>|[:=])[\x20\t]*"
    r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"']+))",
    re.I | re.A,
)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HEXED = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential")
#: The rows of a keyboard, lower and upper; and letters for which others stand.
ROWS = (("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"), ("~!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?"))
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)", re.A)
#: Distinct runs of so many characters bound a value's cost from below.
GRAM = 8


@lru_cache(1)
def _keys() -> dict[str, tuple[int, int]]:
    """Row and place of each key."""
    return {c: (r, i) for rows in ROWS for r, row in enumerate(rows) for i, c in enumerate(row)}


#: Ways to a touching key: a row's next ones, and those above and below, each row lying half a key further right.
NEAR = {(0, 1), (0, -1), (-1, 0), (-1, 1), (1, 0), (1, -1)}


@lru_cache(2)
def words_by_rank(path: str) -> dict[str, int]:
    """Whole words of a public vocabulary; its order of merges is one of frequency."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    words = sorted((i, w[:-4]) for w, i in vocab.items() if w.endswith("</w>") and len(w) > 6 and w[:-4].isascii() and w[:-4].isalpha())
    return {w: rank for rank, (_, w) in enumerate(words, 1)}


TWO = log10(2)


def _class(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


class Guesses:
    """Costs of values by a dictionary of words and their ranks."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)
        self.known: dict[str, float] = {}

    def cost(self, value: str) -> float:
        """Log10 of guesses by the cheapest segmentation, of a value of any length; each segment more doubles the guesses. Costs of BEYOND
        and more are all given as BEYOND."""
        if (cost := self.known.get(value)) is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            cost = self.known[value] = BEYOND if self._is_beyond(value) else _Places(value, self).least()
        return cost

    def _is_beyond(self, value: str) -> bool:
        """Whether a bound from below says so: a word has few distinct runs of GRAM characters and costs log10(2) beside the others, any
        other segment costs more for each, and a repeat adds GRAM - 1 for at least as much."""
        most = (BEYOND / TWO + 1) * (self.longest + GRAM - 1)
        grams: set[str] = set()
        for i in range(len(value) - GRAM + 1 if len(value) > most else 0):
            grams.add(value[i : i + GRAM])
            if len(grams) > most:
                return True
        return False


class _Places:
    """A value's places: the segments that begin there, and the runs they lie in.

    A run is a longest stretch with a period of at most half its length, and no shorter one that divides it. Units that are repeated lie
    in runs, and two units of a run that begin a whole number of periods apart are equal; so a unit is priced once for each run and
    place within the period. Powers of a unit cost what it does and their number of times, unless they have a cheaper segmentation of
    their own (a word such as papa); those are looked for until none is found that the others don't explain. Runs are found in time that
    grows with the square of what is left of a value beside its longest run, and a value with many distinct runs of characters
    doesn't get here. In memory a character takes about 200 bytes.
    """

    def __init__(self, value: str, guesses: Guesses):
        self.value, self.guesses = value, guesses
        self.lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        self.plain = self.lower.translate(LEET)
        self.single = [_class(c) for c in value]
        self.known: dict[str, list[tuple[int, float]]] = {}
        self.runs = _runs(value)
        self.at = self._covered()
        self.unit: dict[tuple[int, int], float] = {}
        self.powers: dict[tuple[int, int], list[tuple[int, float]]] = {}

    def _covered(self) -> list[tuple[int, ...]]:
        """The runs that each place lies in or ends; neighbours share what they have in common."""
        begin, end, now, out = {}, {}, (), []
        for r, (a, b, _) in enumerate(self.runs):
            begin.setdefault(a, []).append(r)
            end.setdefault(b + 1, set()).add(r)
        for k in range(len(self.value) + 1):
            if k in begin or k in end:
                now = (*(r for r in now if r not in end.get(k, ())), *begin.get(k, ()))
            out.append(now)
        return out

    def least(self) -> float:
        while True:
            priced: dict[str, float] = {}
            for r, (start, end, p) in enumerate(self.runs):  # by period, as a unit's cost depends on shorter ones
                for k in range(start, min(start + p, end - 2 * p + 1)):
                    if (cost := priced.get(unit := self.value[k : k + p])) is None:
                        cost = priced[unit] = self.costs(k, k + p, BEYOND)[-1]
                    self.unit[r, k - start] = cost
            if not self._new_powers():
                return min(BEYOND, self.costs(0, len(self.value), BEYOND)[-1])

    def _new_powers(self) -> bool:
        found_any = False
        for r, (start, end, p) in enumerate(self.runs):
            for k in range(start, min(start + p, end - 4 * p + 1)):
                most, unit = (end - k) // (2 * p), self.unit[r, k - start]
                if unit >= BEYOND:
                    continue
                costs, own = self.costs(k, k + most * p, min(BEYOND, unit + log10(most) + 1e-9)), []
                for m in range(2, most + 1):
                    explained = min([unit + log10(m), *(c + log10(m * p // n) for n, c in own if m * p % n == 0)])
                    if costs[m * p] < explained - 1e-12:
                        own.append((m * p, costs[m * p]))
                if own != self.powers.get((r, k - start), []):
                    self.powers[r, k - start] = own
                    found_any = True
        return found_any

    def segments(self, i: int) -> list[tuple[int, float]]:
        """How long words, dates and keyboard walks from a place are, and what they cost. They are remembered by the text ahead."""
        ahead = self.value[i : i + max(self.guesses.longest, 10) + 1]
        if (out := self.known.get(ahead)) is not None:
            return out
        value, lower, plain, n, ranks, keys = self.value, self.lower, self.plain, len(self.value), self.guesses.ranks, _keys()
        out = []
        for j in range(i + 3, min(n, i + self.guesses.longest) + 1):
            word, at, swapped = lower[i:j], ranks.get(lower[i:j]), 0
            if at is None and plain[i:j] != word:
                at = ranks.get(plain[i:j])
                swapped = sum(a != b for a, b in zip(word, plain[i:j]))
            if at is not None:
                own = value[i:j]
                cased = 0 if own == word else TWO if own in (word.upper(), word.capitalize()) else sum(c.isupper() for c in own) * TWO
                out.append((j - i, log10(at) + cased + swapped * TWO))
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if m := DATE.fullmatch(value, i, j):
                    out.append((j - i, log10(365 * 60 if j - i > 4 else 120) + (log10(4) if m[1] or m[2] else 0)))
        turns, way, j = 0, None, i
        for j in range(i + 1, n + 1):
            if j == n or (a := keys.get(value[j - 1])) is None or (b := keys.get(value[j])) is None or (step := (b[0] - a[0], b[1] - a[1])) not in NEAR:
                break
            turns += step != way
            way = step
            cost = log10(94) + log10(j + 1 - i) + turns * log10(4)
            if cost >= BEYOND:
                break
            if j - i >= 2:
                out.append((j + 1 - i, cost))
        if j - i < len(ahead) or i + len(ahead) == n:  # a longer walk depends on more than that
            self.known[ahead] = out
        return out

    def costs(self, i: int, stop: int, limit: float) -> list[float]:
        """The least cost of value[i:k] for each k from i to stop; those of limit and more are infinite, and aren't gone on from."""
        inf, runs, single = float("inf"), self.runs, self.single
        brute, other = [inf] * (stop - i + 1), [inf] * (stop - i + 1)  # by whether the last segment is a brute-force one, which may go on
        least = [inf] * (stop - i + 1)
        repeats: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for k in range(i, stop + 1):
            at = k - i
            if repeats:
                for r in self.at[k]:
                    start, _, p = runs[r]
                    if asked := repeats.get((r, (k - start) % p)):
                        other[at] = min(other[at], _ended(asked, k, p))
            now = least[at] = min(brute[at], other[at]) if at else 0.0
            if now >= limit:
                least[at] = inf
                continue
            if k == stop:
                break
            before = now + TWO if at else 0.0
            if (cost := (min(brute[at], other[at] + TWO) if at else 0.0) + single[k]) < brute[at + 1]:
                brute[at + 1] = cost
            for n, cost in self.segments(k):
                if k + n <= stop and before + cost < other[at + n]:
                    other[at + n] = before + cost
            for r in self.at[k]:
                start, end, p = runs[r]
                end = min(end, stop)
                if k + 2 * p <= end:
                    key = (r, (k - start) % p)
                    if (unit := self.unit.get(key, inf)) < limit:
                        asked = repeats.setdefault(key, [])
                        # an earlier one that is cheaper at this one's first end is so at all later ends
                        if not any(c + log10((k - a) // p + 2) <= before + unit + TWO for a, c in asked):
                            asked.append((k, before + unit))
                    for n, cost in self.powers.get(key, ()):
                        for e in range(k + 2 * n, end + 1, n):
                            other[e - i] = min(other[e - i], before + cost + log10((e - k) // n))
        return least


def _ended(asked: list[tuple[int, float]], k: int, p: int) -> float:
    """The least cost of the repeats that end at k: asked has where each begins, in order, and its cost but for the number of times. Those
    that can't be the least at any later end are removed."""
    best, first, own = float("inf"), -1, float("inf")
    for begin, cost in asked:
        if k - begin >= 2 * p and (whole := cost + log10((k - begin) // p)) < best:
            best, first, own = whole, begin, cost
    if len(asked) > 1 and first >= 0:
        asked[:] = [(b, c) for b, c in asked if b == first or b < first and c < own or k - b < 2 * p]
    return best


def _runs(value: str) -> list[tuple[int, int, int]]:
    """Start, end and period of each run, by period."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    out: list[tuple[int, int, int]] = []
    n = len(value)
    p, last = 1, n // 2
    while p <= last:
        same = codes[:-p] == codes[p:]
        if np.count_nonzero(same) >= p:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
            parts = [(s, e) for s, e, d in out if p % d == 0]
            for a, b in edges.reshape(-1, 2).tolist():
                if b - a >= p and not any(s <= a and b + p <= e for s, e in parts):
                    out.append((a, b + p, p))
                    # a run of a longer period shares less than both periods with this one, and its own length is two of its periods
                    last = min(last, n - (b + p - a) + p)
        p += 1
    return out


def find(text: str, guesses: Guesses, min_cost: float = MIN_COST) -> list[tuple[str, int, int, float | None]]:
    """Spans of kind, start, end (code points) and cost, by start and then kind."""
    coded = text.encode("utf-8", "surrogatepass")
    folded = coded.translate(_FOLD)
    found: list[tuple[str, int, int, float | None]] = []
    if any(h in folded for h in _HINTS):
        found += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        for m in CONTEXT.finditer(text):
            group = next(g for g in (1, 2, 3) if m[g] is not None)
            value = m[group].rstrip(".,;:!?)]}>") if group == 3 else m[group]
            if value and (cost := guesses.cost(value)) >= min_cost:
                found.append(("guess", m.start(group), m.start(group) + len(value), cost))
    if b"AKIA" in coded:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"x" * 16 in coded.translate(_HEXED):
        found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, words: str, min_cost: float = MIN_COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secret spans of each row's whole text (null: empty, without spans); rows with null or equal ids all stay.

    words: the path of a vocabulary file whose whole words, in its order, are the dictionary.
    """

    def make():
        guesses = Guesses(words_by_rank(words))
        names = ("kind", "start", "end", "cost")
        return lambda ids, texts: (ids, [[dict(zip(names, s)) for s in find(t, guesses, min_cost)] for t in texts])

    return map_texts(id_text(df, id_col, text_col), RESULT, make)


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter("spans", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("guess"))
