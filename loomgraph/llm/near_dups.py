"""Near-duplicate documents by BagMinHash signatures of their word shingles, banding, and exact overlaps of multisets.

BagMinHash: the weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) ..., and each shingle has an independent Poisson process in
each block, at a rate in proportion to the block's length. After its first point a process goes on as those of its two halves: the point
falls into either with equal chance, and the other half waits anew from then on; and so down to intervals of length 1. It is a hierarchy
of processes, of which only those are opened that lie below the document's weight and can still be early enough. A point has a time and a
component, and counts for a document if its interval lies below the weight. A component's value is its first point's time, so two
documents agree in it with a probability that is their weighted Jaccard similarity. Processes end once they are later than all components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.common import by_key, counted, discard, hot_keys, map_texts, passing, table, written
from loomgraph.llm.words import mixed, normal, shingles

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 28, 5
#: Texts of a block, on average, and numbers of their bags (4 bytes each), on average and beside one text; numbers searched at once.
BLOCK, BLOCK_CELLS, TOKENS = 512, 1_000_000, 300_000
#: What a row dealt for a chain costs, in rows dealt for buckets.
CHAINED = 1.0
#: Texts whose digests are broadcast to find them in the corpus; more are found by a shuffle. Texts whose keys a task remembers.
NAMED, SKETCHED = 300_000, 20_000
_GOLD = 0x9E3779B97F4A7C15


def bags(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of texts: the text's number, the hash, and how often it occurs there."""
    hashes, counts = shingles([normal(t) for t in texts], words)
    of = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.zeros(0, np.int64)
    return of[first], hashes[first], np.diff(np.concatenate([first, [len(of)]]))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _parts(values: np.ndarray, key: int) -> np.ndarray:
    return mixed(values ^ np.uint64(key))


def signatures(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, components: int) -> np.ndarray:
    """n rows of components: the times of first points; rows of texts without shingles are infinite."""
    times = np.full(n * components, np.inf)
    blocks = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(of)), blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    length = np.maximum(low, 1)
    seed = mixed(hashes[which] + block.astype(np.uint64) * np.uint64(_GOLD))
    doc, weight = of[which], weights[which].astype(np.int64)
    # of each process: when its next point comes, and for which component
    time, part = _wait(seed, components * length), _part(seed, components)
    while len(doc):
        ready = low + length <= weight
        np.minimum.at(times, doc[ready] * components + part[ready], time[ready])
        unit = length == 1
        wide = ~unit & (time < times.reshape(n, components).max(1)[doc])
        seed = _parts(seed, 5)
        d, w, t, a, half, s = doc[wide], weight[wide], time[wide], low[wide], length[wide] // 2, seed[wide]
        upper = (_parts(s, 1) & np.uint64(1)).astype(np.int64)
        first, second = _parts(s, 2), _parts(s, 3)  # the half that has the point, and the other, which waits anew from then on
        halves = [(d, w, t, a + upper * half, half, first, part[wide]), (d, w, t + _wait(second, components * half), a + (1 - upper) * half, half, second, _part(second, components))]
        time = time + _wait(seed, components * length)
        fields = zip((doc, weight, time, low, length, seed, _part(seed, components)), *halves)
        doc, weight, time, low, length, seed, part = (np.concatenate([v[unit], x, y]) for v, x, y in fields)
        alive = (time < times.reshape(n, components).max(1)[doc]) & (low < weight)
        doc, weight, time, low, length, seed, part = (v[alive] for v in (doc, weight, time, low, length, seed, part))
    return times.reshape(n, components)


def _part(seed: np.ndarray, components: int) -> np.ndarray:
    return (_parts(seed, 4) % np.uint64(components)).astype(np.int64)


def _wait(seed: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return -np.log(_uniform(_parts(seed, 6))) / rate


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    values = times.view(np.uint64).reshape(len(times), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD), values.shape[:2])
    for j in range(rows):
        keys = mixed(keys ^ values[:, :, j]) + np.uint64(j + 1)
    return mixed(keys).view(np.int64)


def sketch(df: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """df: doc_id, text and the text's digest. The keys of each text's bands (none where it has no words).

    Texts stay where they are; a task remembers the keys of its latest texts, so copies are sketched once a task, or little more."""

    def make():
        seen: dict[bytes, np.ndarray] = {}

        def one(ids, texts, digests):
            new = {d: t for d, t in zip(digests, texts) if d not in seen}
            own = {d: seen[d] for d in digests if d in seen}
            if len(seen) + len(new) > SKETCHED:
                seen.clear()
            if new:
                of, hashes, weights = bags(list(new.values()), words)
                keys = band_keys(signatures(of, hashes, weights, len(new), bands * rows), bands, rows)
                some = np.bincount(of, minlength=len(new)) > 0
                seen.update((d, k if s else []) for d, k, s in zip(new, keys, some))
            return ids, digests, [own[d] if d in own else seen[d] for d in digests]

        return one

    return map_texts(df, "doc_id long, digest binary, keys array<long>", make)


def cells(df: DataFrame, words: int) -> DataFrame:
    """df: node and text. The text's multiset as a set: a 32-bit number for each shingle and each of its occurrences, and their count.

    Of two texts of n shingles, n * n / 2**32 numbers agree by chance: less than one in 10,000 of them up to 400,000 shingles.
    """

    def make():
        def one(ids, texts):
            of, hashes, weights = bags(texts, words)
            each = np.repeat(np.arange(len(of)), weights)
            copy = np.arange(len(each)) - np.repeat(np.cumsum(weights) - weights, weights)
            made = (mixed(hashes[each] + copy.astype(np.uint64) * np.uint64(_GOLD)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            found = [np.unique(c) for c in np.split(made, np.cumsum(np.bincount(of[each], minlength=len(texts)))[:-1])]
            return ids, found, [len(c) for c in found]

        return one

    return map_texts(df, "node long, cells array<int>, n int", make)


def components(edges: DataFrame, name: str) -> DataFrame:
    """The smallest node of each edge's component, by spreading of smallest labels and jumps to labels' labels.

    Nodes with very many edges, and labels with very many nodes, are joined apart from the others, so none gathers in one task.
    """
    both, n = counted(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    hubs = hot_keys(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", n)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    old = None
    while True:
        seen = by_key(both, labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b", hubs)
        spread = seen.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        near, n = counted(labels.join(spread, "node").select("node", "label", F.least("label", "seen").alias("next")), f"{name}-near")
        large = hot_keys(near.groupBy("next").agg(F.count(F.lit(1)).alias("n")), "next", n)
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        found = by_key(near, jump, "next", large).select("node", "label", F.least("next", "far").alias("next"))
        moves = Observation()
        found = written(found.observe(moves, F.count(F.when(F.col("label") != F.col("next"), 1)).alias("n")), f"{name}-labels")
        labels = found.select("node", F.col("next").alias("label"))
        discard(near, *([old] if old is not None else []))
        old = found
        if not moves.get["n"]:
            discard(both)
            return labels


def _alike(pairs: DataFrame, n_pairs: int, bag: DataFrame, similarity: float) -> DataFrame:
    """pairs: lead and node. Those whose bags overlap enough, and their similarity; sizes alone rule out many before any bag moves.

    A lead of very many pairs has its bag sent in as many copies as tasks that its pairs are dealt to, about HOT_ROWS to each.
    """
    of = written(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / common.HOT_ROWS).cast("int")), "near-leads")
    hot = hot_keys(of, "lead", n_pairs)
    size = bag.select("node", F.col("n").alias("size"))
    leads = of.join(size.withColumnsRenamed({"node": "lead", "size": "lead_size"}), "lead").select("lead", "salts", "lead_size")
    near = by_key(pairs, leads, "lead", hot).join(size, "node").where(F.least("size", "lead_size") >= similarity * F.greatest("size", "lead_size"))
    near = near.select("lead", "node", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    spread = of.join(bag.select(F.col("node").alias("lead"), F.col("cells").alias("x")), "lead").select("lead", "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = near.join(bag.select("node", F.col("cells").alias("y")), "node").join(spread, ["lead", "salt"])
    shared = F.size(F.array_intersect("x", "y"))
    alike = both.withColumn("similarity", shared / (F.size("x") + F.size("y") - shared))
    return alike.where(F.col("similarity") >= similarity).select(F.col("lead").alias("a"), F.col("node").alias("b"), "similarity")


def _labelled(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """df: node and more. Each node's class so far; a node without links is its own."""
    named = df if labels is None else df.join(labels, "node", "left")
    return named.withColumn("label", F.col("node") if labels is None else F.coalesce("label", "node"))


def _still_open(buckets: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold more than one class."""
    several = buckets.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l < m").select("key")
    return by_key(buckets, several, "key", hot, "left_semi")


def _block_links(key: int | None, rows: pa.Table, similarity: float) -> tuple[list[int], list[int], list[float]]:
    """Links between the two blocks of a task (or inside the one), no more than join classes: each row's bag is counted against all
    of the first block at once. Only pairs that share a bucket and aren't of one class count; in the blocks of one bucket (key), only if
    it is the first that they share."""
    side = rows["side"].to_numpy()
    first, second = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    node, label = rows["node"].to_pylist(), rows["label"].to_numpy()
    keys = np.stack(rows["keys"].to_numpy())
    bags_ = rows["cells"].to_numpy()
    sizes = np.array([len(c) for c in bags_])
    band = 0 if key is None else int(np.flatnonzero(keys[0] == key)[0])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for some in np.split(first, np.flatnonzero(np.diff(np.cumsum(sizes[first]) // TOKENS)) + 1):
        tokens, owner = np.concatenate([bags_[i] for i in some]), np.repeat(np.arange(len(some)), sizes[some])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for j in second.tolist():
            bucket = (keys[some] == keys[j]).any(1) if key is None else ~(keys[some, :band] == keys[j, :band]).any(1)
            wanted = (label[some] != label[j]) & bucket
            wanted &= np.minimum(sizes[some], sizes[j]) >= similarity * np.maximum(sizes[some], sizes[j])
            if not wanted.any():
                continue
            low, high = np.searchsorted(tokens, bags_[j], "left"), np.searchsorted(tokens, bags_[j], "right")
            n = high - low
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            shared = np.bincount(owner[at], minlength=len(some))
            alike = shared / (sizes[some] + sizes[j] - shared)
            for i in np.flatnonzero(wanted & (alike >= similarity)).tolist():
                a, b = root(int(label[some[i]])), root(int(label[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out[0].append(node[some[i]])
                    out[1].append(node[j])
                    out[2].append(float(alike[i]))
    return out


def _blocks(member: DataFrame, key: str) -> DataFrame:
    """For each key of member (key, label, size): the most frequent class, its number of blocks, that of the others', and how many rows
    dealing the members to all pairs of blocks takes."""
    counts = member.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cells"))
    found = counts.groupBy(key).agg(F.max_by(F.struct("label", "n", "cells"), F.struct("n", "label")).alias("major"), F.sum("n").alias("n"), F.sum("cells").alias("cells"))
    blocks = lambda n, cells: F.greatest(F.ceil(n / F.lit(float(BLOCK))), F.ceil(cells / F.lit(float(BLOCK_CELLS)))).cast("int")
    rest = F.col("n") - F.col("major.n")
    found = found.select(key, F.col("major.label").alias("major"), F.col("major.n").alias("n_major"), rest.alias("n_rest"), blocks(F.col("major.n"), F.col("major.cells")).alias("majors"), blocks(rest, F.col("cells") - F.col("major.cells")).alias("others"))
    rows = F.col("n_rest") * (F.col("others") + F.col("majors")) + F.col("n_major") * F.col("others")
    return found.select(key, "major", "majors", "others", rows.alias("dealt"), (F.col("n_rest") + F.col("n_major")).alias("n"))


def _linked_by_blocks(open_: DataFrame, base: DataFrame, bag: DataFrame, similarity: float, hot: DataFrame | None) -> DataFrame:
    """open_: key, node and label of buckets that hold several classes. All pairs of a bucket that aren't of one class, in tasks of two
    blocks of about BLOCK texts and BLOCK_CELLS numbers at most.

    Buckets with a common class make a chain. Near copies share many buckets, and are dealt best as one group for their chain; a long
    chain of unlike texts is dealt best bucket by bucket. Each chain is dealt in the way that takes fewer rows. The most frequent class
    of a group has no pairs inside: its blocks only meet those of the others.
    """
    member = written(open_.join(bag.select("node", F.col("n").alias("size")), "node"), "near-sizes")
    head = member.groupBy("key").agg(F.min("label").alias("a"))
    ties = by_key(member.select("key", "label"), head, "key", hot).where("label <> a").select("a", F.col("label").alias("b")).distinct()
    chain = head.join(components(ties, "near-chains").select(F.col("node").alias("a"), F.col("label").alias("gid")), "a").select("key", "gid")
    chain = written(chain, "near-chain")
    grouped, n = counted(by_key(member, chain, "key", hot).select("gid", "node", "label", "size").distinct(), "near-grouped")
    groups, buckets = written(_blocks(grouped, "gid"), "near-groups"), written(_blocks(member, "key").join(chain, "key"), "near-buckets")
    cheaper = buckets.groupBy("gid").agg(F.sum("dealt").alias("by_bucket")).join(groups.select("gid", "dealt"), "gid").withColumn("whole", F.col("dealt") * CHAINED <= F.col("by_bucket")).select("gid", "whole")
    plan = written(cheaper, "near-plan")
    large = hot_keys(groups, "gid", n)
    whole = by_key(grouped, groups.join(plan.where("whole"), "gid").select("gid", "major", "majors", "others"), "gid", large).withColumnRenamed("gid", "part")
    single = by_key(member, buckets.join(plan.where("not whole"), "gid").select("key", "major", "majors", "others"), "key", hot).withColumnRenamed("key", "part")
    columns = ("part", "node", "label", "major", "majors", "others")
    member = whole.select(F.lit(True).alias("whole"), *columns).unionByName(single.select(F.lit(False).alias("whole"), *columns))
    # blocks of the others are 0, 1, ..., those of the most frequent class -1, -2, ...
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    member = member.withColumn("block", F.when(F.col("label") == F.col("major"), -1 - dealt("majors")).otherwise(dealt("others")))
    meets = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(-F.col("majors"), F.col("others") - 1))
    each = member.select("whole", "part", "node", "label", "block", F.explode(meets).alias("other"))
    each = each.select("whole", "part", "node", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
    # in a block that meets itself every row is on both sides; with another, the lower block is the first side
    full = each.join(bag.select("node", "cells"), "node").join(base.select("node", "keys"), "node")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b, alike = _block_links(None if key[0].as_py() else key[1].as_py(), rows, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(alike, pa.float64())})

    return full.groupBy("whole", "part", "i", "j").applyInArrow(run, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id; class_id, the smallest id of all documents that links lead to; n_links, the links that were found
    from the row's text to others; linked_to and similarity, the document of the most similar of those, null without links.

    Equal texts (null: empty) are of one class. Different texts are linked if they share a band and the weighted Jaccard similarity of
    their bags of shingles (of so many words; all words of a shorter text are one) is at least similarity. At 0.8, 28 bands of 5 rows
    miss a pair with a probability of 1.5e-5. Texts without words have no links. Different texts under one id are documents of their own,
    so unlike ones are of two classes, even if both go by that id. Null ids: a text that has no other id goes by a number from 2**62 on.
    A text's bag and sketch are made at once in memory, about 100 bytes for a word of it.

    A bucket never gives all its pairs. First its member that shares most buckets is compared with the others; that joins groups of
    copies. What is left of buckets that hold several classes is compared in blocks, inside tasks of bounded size, and gives no more
    links than join classes. So every pair of a bucket is compared, or of one class already.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))
    found, hot = _classes(docs, words, similarity, bands, rows)
    return by_key(docs.select("doc_id", "digest"), found.drop("named_by"), "digest", hot).select("doc_id", "class_id", "n_links", "linked_to", "similarity")


def _classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame | None]:
    """docs: doc_id, text, digest. For each distinct text: digest, class_id, the digest of the class's text that goes by that id (of
    several such texts, the smallest digest), and its links; and the digests of texts with very many copies."""
    with passing() as kept:
        found = sketch(docs.select("doc_id", "text", "digest"), words, bands, rows)
        base = found.groupBy("digest").agg(F.min(_own_id("doc_id", "digest")).alias("id"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"))
        base = written(base.withColumn("node", F.monotonically_increasing_id()), "near-texts")  # a number for each text, whatever its id
        copies = hot_keys(base, "digest", base.agg(F.sum("n")).first()[0] or 0)
        labels, links = _links(docs, base, words, similarity)
        ends, n = counted(links.select("a", "b", "similarity").union(links.select("b", "a", "similarity")), "near-ends")
        often = hot_keys(ends.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", n)
        ends = by_key(ends, base.select(F.col("node").alias("b"), F.col("id").alias("to")), "b", often)
        best = ends.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"), F.max("similarity").alias("similarity"), F.min_by("to", F.struct(-F.col("similarity"), "to")).alias("linked_to"))
        linked = base.select("node", "id", "digest").join(labels, "node")
        head = linked.groupBy("label").agg(F.min(F.struct("id", "digest")).alias("head"))
        classes = written(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(head, "label"), "near-heads")
        in_class = by_key(linked, classes.drop("n"), "label", hot_keys(classes, "label", n))
        named = base.select("digest", "id", "node").join(in_class.select("node", "head"), "node", "left").join(best, "node", "left")
        named = named.select("digest", F.coalesce("head.id", "id").alias("class_id"), F.coalesce("head.digest", "digest").alias("named_by"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "linked_to", "similarity")
        found = written(named, "near-classes")
        kept.append(found)
        return found, copies


def _links(docs: DataFrame, base: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """base: digest, id, keys, node. The class of each node that has links, and the links."""
    explode = base.select("node", F.explode("keys").alias("key"))
    large = written(explode.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    hot = hot_keys(large, "key", large.agg(F.sum("n")).first()[0] or 0)
    member = written(by_key(explode, large, "key", hot), "near-members")
    score, n = counted(member.groupBy("node").agg(F.sum("n").alias("score")), "near-scores")
    nodes = base.select("digest", "id", "node").join(score, "node", "left_semi")
    nodes = F.broadcast(nodes) if n <= NAMED else nodes
    # only the row that a text is named by, so that copies, however many, don't meet in a task
    named = docs.select(_own_id("doc_id", "digest").alias("id"), "digest", "text")
    texts = named.join(nodes, ["digest", "id"]).dropDuplicates(["node"]).select("node", "text")
    bag = written(cells(texts, words), "near-cells")
    scored = member.drop("n").join(score.join(base.select("node", "id"), "node"), "node")
    lead = written(scored.groupBy("key").agg(F.max_by("node", F.struct("score", -F.col("id"), "node")).alias("lead")), "near-lead")
    led = written(by_key(member.drop("n"), lead, "key", hot).where("node <> lead"), "near-led")
    pairs, n_pairs = counted(led.select("lead", "node").distinct(), "near-pairs")
    links = written(_alike(pairs, n_pairs, bag, similarity), "near-links")
    labels = components(links, "near")
    rest = written(_labelled(led.select("key", "node"), labels), "near-rest")
    open_, n = counted(_still_open(rest, hot), "near-open")
    if n:
        more, n = counted(_linked_by_blocks(open_, base, bag, similarity, hot), "near-links")
        if n:
            links = links.unionByName(more)
            of = lambda end: _labelled(more.select("a", "b", F.col(end).alias("node")), labels).select("a", "b", F.col("label").alias(f"of_{end}"))
            classes = of("a").join(of("b"), ["a", "b"]).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
            joined = components(classes, "near-classes").select(F.col("node").alias("label"), F.col("label").alias("whole"))
            linked, n = counted(_labelled(base.select("node").join(labels.select("node").union(more.select("a")).union(more.select("b")).distinct(), "node", "left_semi"), labels), "near-linked")
            many = hot_keys(linked.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", n)
            whole = linked.select("label").distinct().join(joined, "label", "left").select("label", F.coalesce("whole", "label").alias("whole"))
            labels = written(by_key(linked, written(whole, "near-wholes"), "label", many).select("node", F.col("whole").alias("label")), "near-labels")
    discard(large, member, score, bag, lead, led, pairs, rest, open_)  # early, as the rest are small
    return labels, links


def _own_id(doc_id: str | Column, digest: str | Column) -> Column:
    """The id, or where it is null a number from 2**62 on that goes with the text."""
    return F.coalesce(doc_id, F.shiftrightunsigned(F.xxhash64(digest), 2).bitwiseOR(F.lit(1 << 62)))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of df, whole, of each class: of its smallest id, and of several texts with that id that with the smallest digest; of
    rows with the same id and text, one. Columns of df may have any names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"))
    found, _ = _classes(docs, **how)
    kept = found.where(F.col("digest") == F.col("named_by")).select(F.col("class_id").alias("id"), "digest")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.unhex(F.md5(text)).alias("digest"), _own_id(F.col(id_col).cast("long"), F.unhex(F.md5(text))).alias("id"))
    own = rows.join(kept, ["id", "digest"], "left_semi")
    return own.dropDuplicates(["id", "digest"]).select("row.*")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
