"""Decontamination, line dedup, secrets, languages, quality, near-duplicates and the pipeline."""

from __future__ import annotations

import collections
import functools
import glob
import hashlib
import itertools
import math
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest

from loomgraph.llm import common, decontaminate, language, lines, near_dups, quality, queries, secrets
from loomgraph.llm.common import table
from loomgraph.llm.tokens import vocabulary
from loomgraph.llm.words import normal, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def odd_docs(spark):
    line, other = "A long enough line", "  a LONG enough line\t"
    rows = [(5, line + "\nown words here"), (2, other + "\n" + other), (None, line), (2, line), (9, None), (8, ""), (7, "short\nshort"), (6, "short\n" + "y" * 100_000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, h int")


@pytest.mark.parametrize("held", [10**9, 0])
def test_line_dedup(spark, held):
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.md5(r.text.encode()).hexdigest()[:4] and r.text[:12]) for r in lines.dedup_lines(odd_docs(spark), held_bytes=held).collect())
    assert got == collections.Counter([(5, 2, 1, "own words he"), (2, 2, 0, "  a LONG eno"), (None, 1, 1, ""), (2, 1, 0, "A long enoug"), (9, 1, 0, ""), (8, 1, 0, ""), (7, 2, 0, "short\nshort"), (6, 2, 0, "short\nyyyyyy")])
    assert lines.dedup_lines(odd_docs(spark).limit(0), held_bytes=held).count() == 0
    carried = lines.dedup_lines(odd_docs(spark), held_bytes=held, carry=True).select("row.*")
    assert carried.columns == odd_docs(spark).columns and carried.count() == 8


def test_line_dedup_by_shards_against_sql(spark, monkeypatch):
    """The way that a large corpus takes: several shards, salted probes, rows by number."""
    monkeypatch.setattr(lines, "SHARD_LINES", 300)
    monkeypatch.setattr(lines, "PROBES", 500)
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = lines.dedup_lines(table(spark, sf, "documents"), held_bytes=0).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got) == sorted(con.execute(lines.ORACLE).fetchall())


def test_perfect_hash():
    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20_000)
    h = lines.PerfectHash(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert lines.PerfectHash(keys[:0]).index(keys[:3]).tolist() == [-1] * 3
    f = keys[::-1].copy()
    shard = lines.Shard(np.concatenate([keys, keys[:2]]), np.concatenate([f, f[:2] + 1]), np.arange(len(keys) + 2), np.full(len(keys) + 2, 2))
    assert shard.owners(keys, f)[1].tolist() == list(range(len(keys)))
    assert shard.owners(keys[:2], f[:2] + 1)[1].tolist() == [20_000, 20_001]
    assert not shard.owners(keys + 1, f ^ 12345)[0].any()


def plain_hits(doc, items, w=10):
    words = normal(doc or "").split()
    hit, found = set(), set()
    for item, text in items:
        own = normal(text or "").split()
        n = min(w, len(own))
        for i in range(len(own) - n + 1) if n else ():
            for k in range(len(words) - n + 1):
                if words[k : k + n] == own[i : i + n]:
                    hit.update(range(k, k + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("chars", [10**6, 10])
def test_decontamination(spark, chars):
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14)))) for i in range(12)] + [(3, "Äb C-d"), (77, None), (None, "zz"), (78, "!!")]
    docs = [(i, "".join(rnd.choice(["a ", "b ", "B-", "Äb, c! D ", "x"]) for _ in range(rnd.randint(0, 60)))) for i in range(40)] + [(None, None), (1, "a a"), (2, "")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, spans int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, item int")
    got = decontaminate.digest(decontaminate.scan(d, b, chars=chars)).collect()
    known = [(i, t) for i, t in items if i is not None]
    want = [(i, *plain_hits(t, known)) for i, t in docs]
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == collections.Counter((i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest()) for i, n, h, f in want)
    assert decontaminate.scan(d, b.limit(0), chars=chars).where("size(spans) > 0").count() == 0
    assert decontaminate.scan(d.limit(0), b, chars=chars).count() == 0


@pytest.mark.parametrize("chars", [10**6, 10])
def test_items_without_an_id_hit_as_in_sql(spark, chars):
    docs = [(1, "x Some words y"), (2, "other text"), (3, "some words and other text"), (4, "none")]
    items = [(None, "some words"), (None, "words and"), (7, "other text"), (None, None), (None, "!!")]
    con = duckdb.connect()
    for name, rows in (("documents (doc_id BIGINT, text VARCHAR)", docs), ("benchmark (item_id BIGINT, text VARCHAR)", items)):
        con.execute(f"CREATE TABLE {name}")
        con.executemany(f"INSERT INTO {name.split()[0]} VALUES (?, ?)", rows)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.scan(d, b, chars=chars)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(decontaminate.ORACLE).fetchall())
    assert [r.n_hit for r in sorted(got)] == [2, 2, 5, 0] and [r.n_items for r in sorted(got)] == [1, 1, 2, 0]


def test_one_lot_of_items_at_a_time(spark, monkeypatch):
    items = [(i, f"item number{i} words") for i in range(20)]
    docs = [(i, f"an item number{i} words, item number{(i + 1) % 20} words") for i in range(20)] + [(99, "none")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, *items], "item_id long, text string")
    sent, send = [], spark.sparkContext.broadcast

    def one(lot):
        assert not any(s._jbroadcast.isValid() for s in sent) and (isinstance(lot, decontaminate.Mask) or sum(len(t) for _, t in lot) <= 150 + 20)
        sent.append(send(lot))
        return sent[-1]

    monkeypatch.setattr(spark.sparkContext, "broadcast", one)
    got = {r.doc_id: r["items"] for r in decontaminate.scan(d, b, chars=150).collect()}
    assert len(sent) >= 3
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted([str(i), str((i + 1) % 20)]) for i in range(20)} | {99: []}


def test_a_mask_knows_every_window_and_little_else():
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n))
    items = tuple((str(i), text(rnd.randint(1, 60))) for i in range(300))
    mask = decontaminate.Mask(sum(len(t) for _, t in items))
    mask.add(items, 10)
    assert mask.lengths <= set(range(1, 11))
    held = [normal(text(50) + " " + w.decode() + text(3)) for _, t in items[:100] for w in sorted(decontaminate.windows(t))[:3]]
    assert mask.suspects(held).all() and not mask.suspects([b"", normal("q")]).any()
    long_only = decontaminate.Mask(10**5)
    long_only.add(tuple(i for i in items if len(i[1].split()) >= 10), 10)
    assert long_only.suspects([normal(text(300)) for _ in range(200)]).mean() < 0.05


def test_very_long_texts(spark):
    """A text of a megabyte, with a passage at its end, through the operators that look at whole texts."""
    long = "Plain words of a text that goes on and on. " * 25_000
    docs = spark.createDataFrame([(1, long + "the passage to be found here", "x"), (2, long, "x"), (3, "w" * 1_000_000, "x")], "doc_id long, text string, row string")
    items = spark.createDataFrame([(1, "the passage to be found")], "item_id long, text string")
    for chars in (10**6, 5):
        got = {r.doc_id: r for r in decontaminate.scan(docs, items, chars=chars).collect()}
        assert got[1].spans[0].start == len(long) and got[1]["items"] == ["1"] and not got[2].spans and got[3].n_words == 1
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_hit_spans_map_to_the_text(spark):
    d = spark.createDataFrame([(1, "İx… One, TWO three? äöü")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two THREE")], "item_id long, text string")
    s = decontaminate.scan(d, b).first().spans[0]
    assert "İx… One, TWO three? äöü"[s.start : s.end] == "One, TWO three"


def plain_secrets(t):
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def test_secret_patterns(spark):
    guesses, rnd = secrets.Guesses(secrets.words_by_rank(vocabulary("word_bpe_49k.json"))), random.Random(5)
    parts = ["token", "ToKen", "ſecret", "api_key", "apiKey", "K", ":", "=", " ", '"', "'", "AKIA", "A1B2C3D4E5F6G7H8", "ab12", "0123456789abcdef", "é😀", "\n", "x.", "Password", "==", "-_/+"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s[:3] for s in secrets.find(t, guesses) if s[0] != "guess"] == plain_secrets(t), t
    rows = {r.doc_id: r for r in secrets.op2_secrets(spark, SF).collect()}
    for d in table(spark, SF, "documents").collect():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_secrets(d.text))
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def plain_cost(ranks):
    """The least over every segmentation, each segment by every kind, from the definition."""
    log, two = math.log10, math.log10(2)
    spot = {c: (r, i) for rows in secrets.ROWS for r, row in enumerate(rows) for i, c in enumerate(row)}

    @functools.cache
    def kind(t):
        costs = [sum(log(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000) for c in t)]
        low = t.lower()
        if low in ranks:
            costs.append(log(ranks[low]) + (0 if t == low else two if t in (low.upper(), low.capitalize()) else sum(map(str.isupper, t)) * two))
        elif (plain := low.translate(secrets.LEET)) in ranks:
            costs.append(log(ranks[plain]) + sum(a != b for a, b in zip(low, plain)) * two + (0 if t == low else two if t in (low.upper(), low.capitalize()) else sum(map(str.isupper, t)) * two))
        if m := secrets.DATE.fullmatch(t):
            costs.append(log(21900 if len(t) > 4 else 120) + (log(4) if m[1] or m[2] else 0))
        if len(t) > 2 and all(c in spot for c in t):
            ways = [(spot[b][0] - spot[a][0], spot[b][1] - spot[a][1]) for a, b in itertools.pairwise(t)]
            if all(w in secrets.NEAR for w in ways):
                costs.append(log(94) + log(len(t)) + log(4) * (1 + sum(a != b for a, b in itertools.pairwise(ways))))
        return min(costs + [whole(t[:p]) + log(len(t) // p) for p in range(1, len(t)) if t == t[:p] * (len(t) // p)])

    @functools.cache
    def whole(t):
        cuts = (c for k in range(len(t)) for c in itertools.combinations(range(1, len(t)), k))
        return min(sum(kind(t[a:b]) for a, b in zip((0, *c), (*c, len(t)))) + two * len(c) for c in cuts)

    return whole


def test_guess_costs_against_all_segmentations():
    ranks = {"the": 1, "them": 40, "haha": 300, "pass": 7, "word": 9, "password": 2, "sun": 30, "sunset": 500, "emu": 90}
    plain, guesses, rnd = plain_cost(ranks), secrets.Guesses(ranks), random.Random(1)
    parts = [["a", "b"], ["h", "a", "ha", "haha"], ["q", "w", "e", "r", "t", "y", "f"], ["1", "9", "2019", "12", "-", "/", "3", "1999-1-2"], ["the", "Them", "em", "P4ss", "w0rd", "WORD", "x", "é"], ["sun", "set", "SUN", "aaZ9k", "!"]]
    for n in range(900):
        own = rnd.choice([*parts, sum(parts, [])])
        t = ""
        while len(t) < rnd.randint(0, 12):
            t += rnd.choice(own)
        t = t[:11] if n % 10 else t[:12]
        if t:
            assert abs(guesses.cost(t) - plain(t)) < 1e-9, t
    assert plain("aaaaaaaaaaaa") == guesses.cost("aaaaaaaaaaaa")


def interval_cost(ranks, t):
    """As plain_cost, for longer values: the least cost of every part, shorter ones first, by all cuts in two. Brute-force characters that
    meet are one segment."""
    guesses, n = secrets.Guesses(ranks), len(t)
    two, single = math.log10(2), np.array([0, *np.cumsum([secrets._class(c) for c in t])])
    best = np.full((n + 1, n + 1), np.inf)
    atoms = {(i, i + m): cost for i in range(n) for m, cost in secrets._Places(t[i : i + 60], guesses).segments(0)}
    for size in range(1, n + 1):
        for i in range(n - size + 1):
            j, part = i + size, t[i : i + size]
            least = min(single[j] - single[i], atoms.get((i, j), np.inf))
            for p in range(1, size // 2 + 1):
                if size % p == 0 and part[p:] == part[:-p]:
                    least = min(least, best[i, i + p] + math.log10(size // p))
            if size > 1:
                least = min(least, (best[i, i + 1 : j] + best[i + 1 : j, j]).min() + two)
            best[i, j] = least
    return best[0, n]


@pytest.mark.parametrize("n", [60, 200])
def test_guess_costs_of_repeats(n):
    """Units of any length, units within units, and powers with a price of their own."""
    ranks = {"the": 1, "them": 40, "haha": 2, "hahaha": 3, "pass": 7, "word": 9, "password": 2, "aaaa": 1, "sun": 30, "abab": 5}
    guesses, rnd = secrets.Guesses(ranks), random.Random(n)
    unit = lambda k: "".join(rnd.choice(["a", "b", "ha", "aaa", "ab", "the", "sun", "1", "pass"]) for _ in range(k))
    for k in range(14):
        t = "".join(unit(rnd.randint(1, 9)) * rnd.randint(1, 5) for _ in range(4)) if k % 2 else unit(rnd.randint(1, 20))
        t = (t * n)[:n] + unit(k % 3)
        assert abs(guesses.cost(t) - min(secrets.BEYOND, interval_cost(ranks, t))) < 1e-9, t


def test_guess_costs_of_long_values():
    guesses, log = secrets.Guesses(secrets.words_by_rank(vocabulary("word_bpe_49k.json"))), math.log10
    unit = "Zk8!pQ2#vL" + "hello" * 9 + "passwordmonkey2019"  # of 73 characters
    for t, least in (("a" * 2048, log(26) + log(2048)), (unit * 28, guesses.cost(unit) + log(28)), ("x9$Kq!" * 30_000, guesses.cost("x9$Kq!") + log(30_000))):
        assert guesses.cost(unit) < secrets.BEYOND and abs(guesses.cost(t) - least) < 1e-9
    start = time.process_time()
    guesses.cost("b" * 2048)
    assert time.process_time() - start < 0.5


def test_guess_costs(spark):
    guesses = secrets.Guesses(secrets.words_by_rank(vocabulary("word_bpe_49k.json")))
    cost = guesses.cost
    assert cost("") == 0
    for weak in ("password", "Passw0rd1", "qwertyuiop", "aaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabc", "summer2019", "12/05/1999", "asdfghjkl", "aaZ9kaaZ9kaaZ9k", "summersummersummersummer", "monkeybananasmonkeybananas", "*" * 5000):
        assert cost(weak) < secrets.MIN_COST, weak
    for strong in ("x9$Kq!2mZp", "24be64439e3e49cf46b2d7c9", "Tr0ub4dor&3xK", hashlib.sha256(b"x").hexdigest() * 2, "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(99))):
        assert cost(strong) > secrets.MIN_COST, strong
    assert cost("monkeybananas" * 2) == cost("monkeybananas") + math.log10(2)
    assert cost("qwertyqwerty") < cost("qwertyuhbnml")
    found = secrets.find('pwd = "x9$Kq!2mZp w", password: summer2019, auth: Zk8!pQ2#vL', guesses)
    assert [s[:3] for s in found] == [("guess", 7, 19), ("guess", 50, 60)]
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "token=" + "Qz7" * 40_000, 1), (2, "secret: " + "ab1" * 300_000, 1)], "doc_id long, text string, spans int")
    # Qz7 40,000 times costs 8.44; ab1 300,000 times costs 3.83 and log10(300,000), 9.31 in all
    assert sorted(len(r.spans) for r in secrets.scan(docs, vocabulary("word_bpe_49k.json")).collect()) == [0, 0, 1, 3]
    assert secrets.scan(docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def test_languages(spark):
    rows = language.op6_language(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    docs = table(spark, SF, "documents")
    model = language.fit(docs)
    by = {r.lang: r.text for r in docs.collect() if len(r.text) > 800}
    odd = [(1, by["fr"][:800] + "\n" + by["de"][:800], 1), (2, None, 1), (3, "123 !?", 1), (None, by["es"], 1), (4, "", 1), (5, by["en"] * 30, 1)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(odd, "doc_id long, text string, languages int"), model).collect()}
    assert {x.lang for x in got[1].languages} == {"fr", "de"} and all(0.3 < x.share < 0.7 for x in got[1].languages)
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0 and got[None].lang_pred == "es" and got[5].lang_pred == "en"
    nothing = language.fit(docs.limit(0))
    assert language.identify(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0


def plain_mixture(text, model):
    """Expectation-maximisation and the choice of languages in plain loops."""
    words, n_lang = language._bytes(text).split(), len(model.languages)
    if not words:
        return [0.0] * n_lang
    logs = []
    for w in words:
        own = [0.0] * n_lang
        for cells, _ in language.grams(np.frombuffer(b" " + w + b" ", np.uint8)):
            for c in cells.tolist():
                own = [a + float(b) for a, b in zip(own, model.logs[c])]
        best = max(own)
        logs.append([math.exp(max(language.TEMPER * (v - best), -60)) for v in own])

    def fitted(share):
        for _ in range(language.STEPS):
            new = [0.0] * n_lang
            for e in logs:
                total = sum(a * b for a, b in zip(e, share))
                new = [x + a * b / total / len(logs) for x, a, b in zip(new, e, share)]
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved <= language.STILL:
                break
        return share, sum(math.log(sum(a * b for a, b in zip(e, share))) for e in logs)

    share, likely = fitted([1 / n_lang] * n_lang)
    kept = [s if s * len(words) >= 0.5 else 0.0 for s in share]
    if sum(kept) and kept != share:
        share, likely = fitted([s / sum(kept) for s in kept])
    while sum(s > 0 for s in share) > 1:
        least = -min((s, -i) for i, s in enumerate(share) if s > 0)[1]
        fewer = [0.0 if i == least else s + 1e-6 if s > 0 else 0.0 for i, s in enumerate(share)]
        own, less = fitted([s / sum(fewer) for s in fewer])
        if less + language.PENALTY * math.log(len(words) + 1) < likely:
            break
        share, likely = own, less
    return share


def test_mixtures_against_plain_loops():
    rnd = random.Random(11)
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 60, (language.CELLS * 2, 3)) * (rng.random((language.CELLS * 2, 3)) < 0.4) + 0.3
    model = language.Model(("a", "b", "c"), np.log(counts / counts.sum(0)).astype(np.float32))
    texts = ["", "!", "one", *("".join(rnd.choice(["ab", "cd ", "ef", " ", "漢字仮名交文字列", "é. "]) for _ in range(rnd.randint(1, 90))) for _ in range(60))]
    got = language.mixtures(texts, model)
    for t, row in zip(texts, got):
        assert np.allclose(row, plain_mixture(t, model), atol=5e-3), t


def test_texts_without_blanks_may_be_mixtures(spark):
    rows = [(i, "".join(random.Random(i).choice("漢字仮名交文列語" if i % 2 else "かきくけこさしす") for _ in range(400)), "zh" if i % 2 else "ja") for i in range(40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    share = language.mixtures([rows[1][1] + rows[2][1], rows[3][1]], model)
    assert 0.4 < share[0, 0] < 0.6 and share[1, 1] == 1


def test_ties_of_languages(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["b", "a", "b", "a"])], "doc_id long, text string, lang string")
    rows = language.identify(docs, language.fit(docs)).collect()
    assert {r.lang_pred for r in rows} == {"a"} and all(0 < r.score <= 1 for r in rows)


def test_quality_scores_are_sums_of_table_cells(spark):
    """Each score by plain loops over the model's tables, and features by plain counting."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels)
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    rows = docs.limit(150).collect()
    got = {r.doc_id: r.score for r in quality.score(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), model).collect()}
    for r, x in zip(rows, quality.features([r.text for r in rows])):
        total = model.base
        for f in range(len(x)):
            total += model.tables[f][sum(bool(e <= x[f]) for e in model.edges[f])]
        for f, g, e, d, t in model.pairs:
            total += t[sum(bool(v <= x[f]) for v in e), sum(bool(v <= x[g]) for v in d)]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-9
        data, words = r.text.encode(), normal(r.text).split()
        named = dict(zip(quality.FEATURES, x))
        assert named["bytes"] == pytest.approx(math.log1p(len(data))) and named["words"] == pytest.approx(math.log1p(len(words)))
        assert named["digit"] == pytest.approx(sum(48 <= b <= 57 for b in data) / len(data)) and named["beyond"] == pytest.approx(sum(b >= 128 for b in data) / len(data))
        assert named["distinct"] == pytest.approx(len(set(words)) / max(len(words), 1)) and named["longest_word"] == max(map(len, words), default=0)
        assert named["commonest"] == pytest.approx(max(collections.Counter(words).values(), default=0) / max(len(words), 1))


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in quality.op5_quality(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and r.held_out]
    good, bad = [r.score for r in rows if labels[r.doc_id]], [r.score for r in rows if not labels[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9
    docs, few = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert {r.score for r in quality.score(docs, quality.train(docs, few.limit(0))).collect()} == {0.5}
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "\n\n", 1), (2, "!", 1), (3, "w " * 90_000, 1)], "doc_id long, text string, score int")
    model = quality.train(docs, few)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.score(odd.limit(0), model).count() == 0
    x = quality.features(["some words here, some words there.\n", "", "A B"])
    assert np.isfinite(x).all() and not x[1].any()


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    s = quality.fit(x[:3000], y[:3000]).score(x[3000:])
    assert ((s > 0.5) == y[3000:]).mean() > 0.9


def test_shingles():
    hashes, counts = shingles([normal(t) for t in ("a b c d e f", "", "A, b", "a b c d e", "b")])
    assert counts.tolist() == [2, 0, 1, 1, 1] and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = rng.integers(1, 12, 200), rng.integers(0, 12, 200)
    of = np.concatenate([np.zeros(200, int), np.ones((b > 0).sum(), int)])
    s = near_dups.signatures(of, np.concatenate([h, h[b > 0]]), np.concatenate([a, b[b > 0]]), 3, 20_000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015
    assert np.isinf(s[2]).all() and np.isfinite(s[:2]).all()


def plain_bags(docs):
    return {i: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)) if w) for i, t in docs.items() for w in [normal(t or "").split()]}


def plain_classes(docs):
    bag = plain_bags(docs)
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        same = sum((bag[a] & bag[b]).values())
        if (docs[a] or "") == (docs[b] or "") or same and same >= 0.8 * (sum(bag[a].values()) + sum(bag[b].values()) - same):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in docs}


def edited(rnd, words, share):
    return " ".join(rnd.choice("qrst") * 4 if rnd.random() < share else w for w in words)


@pytest.mark.parametrize("block, hot", [(256, 1000), (8, 1)])
def test_near_duplicates(spark, monkeypatch, block, hot):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rnd = random.Random(6)
    base = [[f"w{rnd.randint(0, 999)}" for _ in range(120)] for _ in range(3)]
    docs = {i: edited(rnd, base[i % 3], rnd.choice([0, 0.005, 0.02, 0.05, 0.1])) for i in range(90)}
    docs |= {100: None, 101: "", 102: "!!", 103: "one two", 104: "One, two!", 105: "x y " * 300, 106: "x y " * 290, 107: "x y " * 100}
    rows = [(i, t, 1) for i, t in docs.items()] + [(7, docs[7], 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys int").repartition(3)
    got = near_dups.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == plain_classes(docs)
    bag = plain_bags(docs)
    for r in got:
        assert (r.n_links == 0) == (r.linked_to is None) == (r.similarity is None)
        if r.n_links:
            same = sum((bag[r.doc_id] & bag[r.linked_to]).values())
            assert abs(r.similarity - same / (sum(bag[r.doc_id].values()) + sum(bag[r.linked_to].values()) - same)) < 1e-3 and r.similarity >= 0.8
    kept = near_dups.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_classes(docs).values()))


def test_near_duplicates_of_a_whole_table(spark):
    """Against all pairs that share a shingle, exactly: no link is lost at these sizes."""
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    bag, at = plain_bags(docs), collections.defaultdict(set)
    for i, own in bag.items():
        for s in own:
            at[s].add(i)
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n_links = 0
    for i, own in bag.items():
        for j in {j for s in own for j in at[s] if j > i}:
            same = sum((own & bag[j]).values())
            if same >= 0.8 * (sum(own.values()) + sum(bag[j].values()) - same):
                n_links += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in near_dups.op4_near_duplicates(spark, "/root/testdata/sf0.01").collect()}
    assert n_links > 50 and got == {i: root(i) for i in docs}


def test_near_duplicates_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, "some words that are the same here"), (None, "some words that are the same here"), (4, "other words")], "doc_id long, text string")
    assert near_dups.near_duplicates(df.limit(0)).count() == 0
    got = near_dups.near_duplicates(df).collect()
    lone = {r.class_id for r in got if r.doc_id is None}
    assert sorted(str(r.doc_id) for r in near_dups.keep_one(df).collect()) == ["4", "None"]
    assert len(lone) == 1 and min(lone) >= 1 << 62 and {r.class_id for r in got if r.doc_id == 4} == {4}


def test_near_duplicates_of_texts_under_one_id(spark):
    rnd = random.Random(8)
    a, b = ([f"{c}{rnd.randint(0, 999)}" for _ in range(120)] for c in "vw")
    rows = [(7, " ".join(a)), (7, " ".join(b)), (7, " ".join(b)), (8, " ".join(a[:-1])), (9, " ".join(b[:-1])), (9, "lone words"), (9, "LONE words")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int").repartition(3)
    kept = sorted((r.doc_id, normal(r.text)) for r in near_dups.keep_one(df).collect())
    assert kept == sorted((i, normal(t)) for i, t in (rows[0], rows[1], rows[5]))
    assert sorted((r.doc_id, r.class_id) for r in near_dups.near_duplicates(df).collect()) == [(7, 7)] * 3 + [(8, 7), (9, 7), (9, 9), (9, 9)]


def test_blocks_only_links_between_classes():
    import pyarrow as pa

    rows = {"side": [2, 2, 2], "node": [1, 2, 3], "label": [1, 2, 3], "keys": [[5, 1], [5, 2], [5, 1]], "cells": [list(range(10))] * 3}
    a, b, alike = near_dups._block_links(5, pa.table(rows), 0.8)
    assert sorted(zip(a, b)) == [(2, 1), (3, 1)] and alike == [1.0, 1.0]
    rows = {k: v[:2] if k != "keys" else [[5, 1], [5, 1]] for k, v in rows.items()}
    assert near_dups._block_links(1, pa.table(rows), 0.8)[0] == []  # they share an earlier bucket
    rows["keys"] = [[5, 1], [6, 2]]
    assert near_dups._block_links(None, pa.table(rows), 0.8)[0] == []
    rows["keys"] = [[5, 1], [6, 1]]
    assert near_dups._block_links(None, pa.table(rows), 0.8)[0] == [2]


@pytest.mark.parametrize("weight", [0.0, 1.0, 1e9])
def test_blocks_of_chains_and_of_buckets_find_the_same(spark, monkeypatch, weight):
    """Three buckets of a chain, where links join classes only through the last."""
    monkeypatch.setattr(near_dups, "BLOCK", 2)
    bags = {n: list(range(n * 100, n * 100 + 20)) for n in range(8)} | {6: list(range(500, 519)), 7: list(range(501, 521))}
    keys = {0: [10, 20], 1: [10, 21], 2: [11, 21], 3: [11, 22], 4: [12, 22], 5: [12, 23], 6: [12, 23], 7: [12, 24]}
    base = spark.createDataFrame([(n, k) for n, k in keys.items()], "node long, keys array<long>")
    bag = spark.createDataFrame([(n, c, len(c)) for n, c in bags.items()], "node long, cells array<int>, n int")
    open_ = spark.createDataFrame([(k, n, n) for n, own in keys.items() for k in own if sum(k in o for o in keys.values()) > 1], "key long, node long, label long")
    monkeypatch.setattr(near_dups, "CHAINED", weight)
    got = {tuple(sorted((r.a, r.b))) for r in near_dups._linked_by_blocks(open_, base, bag, 0.8, None).collect()}
    joined = {frozenset(p) for p in got}
    assert joined <= {frozenset((5, 6)), frozenset((5, 7)), frozenset((6, 7))} and len(joined) >= 2


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    df = spark.createDataFrame([(k, i) for k, n in ((1, 10), (2, 2), (3, 5), (4, 1)) for i in range(n)], "k int, i int")
    few = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, v string")
    counts = df.groupBy("k").count().withColumnRenamed("count", "n")
    hot = common.hot_keys(counts, "k", 1000)
    assert sorted(r.k for r in hot.collect()) == [1, 3] and common.hot_keys(counts, "k", 10**9) is None and common.hot_keys(counts, "k", 18) is None
    for h in (hot, None):
        assert sorted(map(tuple, common.by_key(df, few, "k", h).collect())) == sorted([(1, i, "a") for i in range(10)] + [(2, 0, "b"), (2, 1, "b"), (4, 0, "d")])
        assert common.by_key(df, few.select("k"), "k", h, "left_semi").count() == 13


def test_no_work_tables_stay(spark):
    from loomgraph.sources import scratch

    before = set(scratch._MADE)
    df = spark.createDataFrame([(i, f"some words of a text that is number {i // 2} here and there") for i in range(40)], "doc_id long, text string")
    near_dups.near_duplicates(df).collect()
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0][:-24] for p in set(scratch._MADE) - before}
    assert "near-members" not in left and "near-cells" not in left


def test_only_the_result_s_work_table_stays(spark, monkeypatch):
    """With blocks, chains and frequent keys: every folder is listed."""
    from loomgraph.sources import scratch

    for name, value in (("BLOCK", 8), ("BLOCK_CELLS", 2000)):
        monkeypatch.setattr(near_dups, name, value)
    before = set(scratch._MADE)
    rows = near_dups.near_duplicates(table(spark, "/root/testdata/sf0.01", "documents"))
    left = set(scratch._MADE) - before
    assert len(left) == 1 and "/near-classes-" in left.pop()
    assert rows.count() == 1000


def test_repeated_ids_are_sampled_once(spark):
    docs = spark.createDataFrame([(i % 4, f"text {i % 4} of some words, again") for i in range(400)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 5, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda x, y: seen.append((x.shape, y.tolist())) or fit(x, y)
        model = quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert seen == [((4, len(quality.FEATURES)), [0.0] * 4)]
    assert quality.score(docs, model).count() == 401


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == list(p.COLUMNS)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everything = {r.doc_id for r in table(spark, SF, "documents").collect()}
    assert kept["language"] == everything == kept["lines"]
    after = {r.doc_id: r.text for r in lines.dedup_lines(table(spark, SF, "documents")).collect()}
    assert kept["near_duplicates"] == set(plain_classes(after).values())
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    windows = {w for _, t in items for w in decontaminate.windows(t)}
    clean = {i for i in kept["near_duplicates"] if not any(b" " + w in b" " + normal(after[i]) for w in windows)}
    assert kept["benchmark"] == clean
    packed = p.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == clean


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a b", None, "s", 3), (1, "a b", None, "s", 3), (2, "", "en", None, 0), (3, "word " * 100_000, "en", "s", 500_000)], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.selectExpr("*", "1 as row", "2 as number", "3 as digest", "4 as id", "5 as near__id", "6 as spans", "7 as pack")
    for start in (docs, clashing, docs.limit(0)):
        out = start
        for _, stage in p.STAGES:
            out = stage(spark, out, SF)
        out.collect()


def test_pipeline_without_labels(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    bare = [(1, "plain words here", None, "s", 16), (2, "\u0436", None, "s", 1), (3, "12 !?", None, "s", 5), (4, None, None, "s", 0)]
    lone = [(None, "plain words here", "en", "s", 16), (None, "other words there", None, "s", 17), (None, "12", "en", "s", 2)]
    und = [(1, "plain words here", "und", "s", 16), (2, "12", "und", "s", 2)]
    for rows, n in ((bare, 2), (lone, 2), (und, 1)):
        kept = p.identify_language(spark, spark.createDataFrame(rows, schema), SF)
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows[:n]))
        out = kept
        for _, stage in p.STAGES[1:]:
            out = stage(spark, out, SF)
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in rows[:n])


def test_a_mask_filled_by_tasks(spark):
    """Bits and lengths are those of items put in at once, whatever the segments; no items leave it empty."""
    items = [(f"i{k}", " ".join(f"w{k}x{j % (k + 3)}" for j in range(k % 40))) for k in range(500)] + [("n", None), ("e", ""), ("p", "?!"), ("i7", "Again, again")]
    rows = spark.createDataFrame(items, "item string, text string").repartition(7)
    size = 20_000_000  # several segments
    want = decontaminate.Mask(size)
    want.add([(i, t or "") for i, t in items], 10)
    got = decontaminate.Mask(size).fill(rows, 10)
    assert len(got.bits) == got.size >> 3 > 2 << decontaminate.SEGMENT_BITS >> 3
    assert got.lengths == want.lengths and (got.bits == want.bits).all() and want.bits.any()
    none = decontaminate.Mask(10).fill(rows.limit(0), 10)
    assert not none.bits.any() and not none.lengths and not none.suspects([b"a b "]).any()
