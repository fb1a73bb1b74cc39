"""Hard-negative mining by dual-tree search: exact largest inner products, and those in a band below a positive's.

A ball tree, fitted on a bounded sample, deals all rows to leaves; each leaf's radius is that of all its rows. Anchors of a leaf are a
group. For balls of centres a, b and radii r, s all inner products lie within |a| s + |b| r + r s of <a, b>, so a group meets only those
subtrees of candidates whose interval can still hold something wanted. Group and leaf meet in a task, where both get trees of their own,
pairs of nodes are pruned in the same way, and pairs of leaves are scored exactly. What is wanted is narrowed first by each group's own
leaf: its k-th best score so far bounds what other leaves must offer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import discard, table, written

POSITIVES, NEGATIVES = 5, 5
#: Rows that the tree is fitted on; rows of a leaf, on average, and leaves at most; rows of a leaf, and anchors, that meet in a task.
SAMPLE, LEAF_ROWS, LEAVES, CELL_ROWS, ANCHORS = 20_000, 4096, 2048, 65_536, 65_536
#: Rows of the leaves of a task's own trees; candidates that are scored at once.
NEAR, SCORED = 128, 16_384
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_EXACT = float(1 << 53)


class Tree:
    """A ball tree: nodes in an order in which parents come first; rows of a node are order[start:end]."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.start, self.end, self.kids, self.centre, self.radius, self.way, self.cut = [], [], [], [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            i, j, parent, side = todo.pop()
            own = x[self.order[i:j]]
            node, centre = len(self.start), own.mean(0) if j > i else np.zeros(x.shape[1])
            away = np.sqrt(((own - centre) ** 2).sum(1))
            self.start.append(i)
            self.end.append(j)
            self.kids.append([-1, -1])
            self.centre.append(centre)
            self.radius.append(float(away.max(initial=0.0)))
            if parent >= 0:
                self.kids[parent][side] = node
            way, cut = np.zeros(x.shape[1]), 0.0
            if j - i > leaf and self.radius[-1] > 0:
                # towards the row that is farthest from the one that is farthest from the centre
                far = own[away.argmax()]
                way = own[((own - far) ** 2).sum(1).argmax()] - far
                along = own @ way
                cut = float(np.median(along))
                low = along < cut if (along < cut).any() else along <= cut
                if 0 < low.sum() < j - i:
                    self.order[i:j] = np.concatenate([self.order[i:j][low], self.order[i:j][~low]])
                    cut = cut if (along < cut).any() else np.nextafter(cut, np.inf)
                    middle = i + int(low.sum())
                    todo += [(i, middle, node, 0), (middle, j, node, 1)]
            self.way.append(way)
            self.cut.append(cut)
        self.start, self.end, self.kids = np.array(self.start), np.array(self.end), np.array(self.kids)
        self.centre, self.radius, self.way, self.cut = np.array(self.centre), np.array(self.radius), np.array(self.way), np.array(self.cut)
        self.leaves = np.flatnonzero(self.kids[:, 0] < 0)
        self.norm = np.sqrt((self.centre**2).sum(1))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of each row."""
        at = np.zeros(len(x), np.int64)
        while len(open_ := np.flatnonzero(self.kids[at, 0] >= 0)):
            node = at[open_]
            right = (x[open_] * self.way[node]).sum(1) >= self.cut[node]
            at[open_] = self.kids[node, right.astype(np.int64)]
        return at

    def widened(self, radius: dict[int, float]) -> None:
        """Radii of all rows, of which those of leaves are given; a leaf without rows can't hold anything (-1)."""
        self.radius[:] = -1.0
        for node in range(len(self.start) - 1, -1, -1):
            if self.kids[node, 0] < 0:
                self.radius[node] = radius.get(node, -1.0)
            else:
                own = [r + float(np.sqrt(((self.centre[k] - self.centre[node]) ** 2).sum())) for k in self.kids[node] if (r := self.radius[k]) >= 0]
                self.radius[node] = max(own, default=-1.0)


def interval(dot: np.ndarray, a: np.ndarray, r: np.ndarray, b: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of inner products between balls: their centres' inner products and norms, and radii; widened for rounding."""
    reach = a * s + b * r + r * s
    reach = reach + 1e-9 * (np.abs(dot) + a * b + reach) + 1e-6
    return dot - reach, dot + reach


def surviving(tree: Tree, centre: np.ndarray, radius: float, low: float, high: float) -> list[int]:
    """The leaves that may hold a row whose inner product with a row of the ball is from low to high."""
    own = float(np.sqrt((centre**2).sum()))
    level, out = np.zeros(1, np.int64), []
    while len(level):
        level = level[tree.radius[level] >= 0]
        least, most = interval(tree.centre[level] @ centre, own, radius, tree.norm[level], tree.radius[level])
        level = level[(most >= low) & (least <= high)]
        leaf = tree.kids[level, 0] < 0
        out += level[leaf].tolist()
        level = tree.kids[level[~leaf]].ravel()
    return out


def node_pairs(a: Tree, b: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of two trees that may hold a wanted inner product. low, high: of each row of a."""
    least = np.array([low[a.order[i:j]].min(initial=np.inf) for i, j in zip(a.start, a.end)])
    most = np.array([high[a.order[i:j]].max(initial=-np.inf) for i, j in zip(a.start, a.end)])
    dots = a.centre @ b.centre.T
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(x):
        down, up = interval(dots[x, y], a.norm[x], a.radius[x], b.norm[y], b.radius[y])
        keep = (up >= least[x]) & (down <= most[x])
        x, y = x[keep], y[keep]
        ends = (a.kids[x, 0] < 0) & (b.kids[y, 0] < 0)
        done.append((x[ends], y[ends]))
        x, y = x[~ends], y[~ends]
        # the wider node is opened, if it is no leaf
        first = (a.kids[x, 0] >= 0) & ((a.radius[x] >= b.radius[y]) | (b.kids[y, 0] < 0))
        x, y = (
            np.concatenate([a.kids[x[first]].ravel(), np.repeat(x[~first], 2)]),
            np.concatenate([np.repeat(y[first], 2), b.kids[y[~first]].ravel()]),
        )
    return np.concatenate([p[0] for p in done]), np.concatenate([p[1] for p in done])


def packed(rows: list[list[int]]) -> list[bytes]:
    """Integers in as few bytes as the largest of a row takes, after one byte that says how many."""
    out = []
    for row in rows:
        v = np.array(row, np.int64)
        most = max(int(v.max(initial=0)), -1 - int(v.min(initial=0)))
        size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1))
        out.append(bytes([size]) + v.astype(f"<i{size}").tobytes())
    return out


def unpacked(images: list[bytes], width: int) -> np.ndarray:
    """Rows of width integers; shorter ones end in zeros."""
    out = np.zeros((len(images), width), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, image in enumerate(images):
        kinds.setdefault((image[0], len(image)), []).append(i)
    for (size, n), at in kinds.items():
        values = np.frombuffer(b"".join(images[i][1:] for i in at), f"<i{size}").reshape(len(at), (n - 1) // size)
        out[at, : values.shape[1]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly. Those that a long doesn't hold are an error."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    norms = [np.sqrt((v**2).sum(1)).max(initial=0.0) for v in (x, y)]
    if norms[0] * norms[1] < _EXACT / 2:  # so are all sums on the way
        return (x @ y.T).astype(np.int64)
    return np.array(a.astype(object) @ b.astype(object).T, dtype=np.int64)


def _first(scores: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest wanted scores; ties by place."""
    at = np.flatnonzero(wanted)
    if len(at) <= k:
        return at
    own = scores[at]
    bound = np.partition(own, len(own) - k)[len(own) - k]
    above, equal = at[own > bound], at[own == bound]
    return np.concatenate([above, equal[: k - len(above)]])


def met(left: pa.Table, right: pa.Table, width: int, k: int, band: tuple[int, int, int] | None) -> tuple[list, ...]:
    """The k best candidates for each anchor, of its label (band: None), or of other labels in the band below each of its positives.

    left: id, label, q, wants (positive's score, and what a score must reach); right: id, label, q. As anchor id, positive's score,
    candidate's id, score.
    """
    right = right.sort_by("id")
    ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
    names, own, wants = left["id"].to_numpy(), left["label"].to_numpy(), left["wants"].to_pylist()
    x, y = unpacked(left["q"].to_pylist(), width), unpacked(right["q"].to_pylist(), width)
    low = np.array([min((w["low"] for w in ws), default=np.inf) for ws in wants])
    high = np.array([max((np.inf if band is None else w["p"] * band[1] / band[2] for w in ws), default=-np.inf) for ws in wants])
    a, b = Tree(x.astype(np.float64), NEAR), Tree(y.astype(np.float64), NEAR)
    out: tuple[list, ...] = ([], [], [], [])
    of, to = node_pairs(a, b, low, high)
    for node in np.unique(of).tolist():
        some = a.order[a.start[node] : a.end[node]]
        columns = np.sort(np.concatenate([b.order[b.start[m] : b.end[m]] for m in to[of == node].tolist()]))  # by id
        for i in range(0, len(columns), SCORED):
            part = columns[i : i + SCORED]
            for row, scores in zip(some.tolist(), products(x[some], y[part])):
                same = labels[part] == own[row]
                for want in wants[row]:
                    p = want["p"]
                    good = scores >= want["low"]
                    if band is None:
                        good &= same & (ids[part] != names[row])
                    else:
                        good &= ~same & (scores >= -(-band[0] * p // band[2])) & (scores <= band[1] * p // band[2])
                    best = _first(scores, good, k)
                    out[0].extend([int(names[row])] * len(best))
                    out[1].extend([p] * len(best))
                    out[2].extend(ids[part][best].tolist())
                    out[3].extend(scores[best].tolist())
    return out


class _Search:
    """The rows dealt to the leaves of a tree, and passes over them."""

    def __init__(self, rows: DataFrame, n: int, width: int):
        """rows: id, label, q (longs), anchor. Ids are distinct."""
        self.spark, self.width = rows.sparkSession, width
        few = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SAMPLE)
        sample = few.select("q").toArrow()["q"].to_pylist()
        x = np.zeros((len(sample), width))
        for i, q in enumerate(sample):
            x[i, : len(q)] = q
        leaves = min(LEAVES, -(-n // LEAF_ROWS))
        tree = Tree(x, max(1, -(-len(x) // leaves)))
        sent = self.spark.sparkContext.broadcast(tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = sent.value
            for b in batches:
                q = packed(b.column(2).to_pylist())
                x = unpacked(q, width).astype(np.float64)
                leaf = tree.route(x)
                away = np.sqrt(((x - tree.centre[leaf]) ** 2).sum(1)) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(q, pa.binary()), b.column(3), pa.array(leaf), pa.array(away)], ["id", "label", "q", "anchor", "leaf", "away"])

        dealt = rows.select("id", "label", "q", "anchor").mapInArrow(run, "id long, label long, q binary, anchor boolean, leaf long, away double")
        self.rows = written(dealt, "negatives-rows")
        stats = self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).collect()  # one row a leaf
        tree.widened({r.leaf: r.away for r in stats})
        self.tree = self.spark.sparkContext.broadcast(tree)
        parts = [(r.leaf, -(-r.n // CELL_ROWS)) for r in stats]
        self.parts = F.broadcast(self.spark.createDataFrame(parts, "leaf long, parts long"))
        self.slots = max(1, -(-sum(r.anchors for r in stats) // ANCHORS))
        self.anchors = self.rows.where("anchor").drop("anchor")

    def best(self, wants: DataFrame | None, k: int, band: tuple[int, int, int] | None, own: bool) -> DataFrame:
        """wants: id, and wants of each anchor; None: everything. Own: in the anchors' own leaves, otherwise in all others that may hold
        something. Gives id, p, other, score, k at most for each id and p of each task."""
        if wants is None:
            asked = self.anchors.withColumn("wants", F.array(F.struct(F.lit(None).cast("long").alias("p"), F.lit(float("-inf")).alias("low"))))
        else:
            asked = self.anchors.join(wants, "id")
        if own:
            asked = asked.withColumn("to", F.col("leaf"))
        else:
            most = F.lit(float("inf")) if band is None else F.array_max(F.transform("wants", lambda w: w["p"])) * (band[1] / band[2])
            groups = asked.groupBy("leaf").agg(F.max("away").alias("away"), F.min(F.array_min(F.transform("wants", lambda w: w["low"]))).alias("low"), F.max(most).alias("high"))
            tree = self.tree

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for leaf, away, low, high in zip(*(c.to_pylist() for c in b.columns)):
                        found = [m for m in surviving(tree.value, tree.value.centre[leaf], away, low, high) if m != leaf]
                        yield pa.RecordBatch.from_arrays([pa.array([leaf] * len(found), pa.int64()), pa.array(found, pa.int64())], ["leaf", "to"])

            asked = asked.join(groups.mapInArrow(run, "leaf long, to long"), "leaf")
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        asked = asked.join(self.parts.withColumnRenamed("leaf", "to"), "to").select("to", part, F.pmod(F.xxhash64("id"), F.lit(self.slots)).alias("slot"), "id", "label", "q", "wants")
        slot = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.slots - 1).cast("long"))).alias("slot")
        there = self.rows.join(self.parts, "leaf").select(F.col("leaf").alias("to"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), slot, *(F.col(c).alias(c) for c in ("id", "label", "q")))
        width = self.width

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found = met(left, right, width, k, band) if len(left) and len(right) else ([],) * 4
            return pa.table([pa.array(c, pa.int64()) for c in found], names=["id", "p", "other", "score"])

        keys = ("to", "part", "slot")
        return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(meet, "id long, p long, other long, score long")


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int, int] = (80, 100, 100), id_col: str = "vec_id", vector_col: str = "q", label_col: str = "label") -> DataFrame:
    """For each anchor and each of its positives, its hard negatives.

    df: an id, a label and a vector of longs; anchor: a condition. A score is a row's inner product with an anchor; higher ones come first,
    ties by smaller id. The positives are an anchor's first other rows of its label; the negatives are the first rows of other
    labels whose score, times band[2], is from band[0] to band[1] times the positive's. All results are exact.

    Rows without id, label or vector, or with a null component, take no part. Of rows with equal ids the one with the smallest label, then
    vector, stands for all; shorter vectors end in zeros. A score that a long doesn't hold is an error. The driver and each task hold the
    tree: SAMPLE rows at fitting, then LEAVES leaves; a task holds CELL_ROWS candidates and ANCHORS anchors, more of either are dealt out.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull()))
    n, ids, width = rows.agg(F.count(F.lit(1)), F.countDistinct("id"), F.max(F.size("q"))).first()
    if ids < n:
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "q", "anchor")).alias("row")).select("id", "row.*")
    if not n:
        return df.sparkSession.createDataFrame([], RESULT)
    search = _Search(rows, ids, max(width, 1))
    few = written(search.best(None, positives, None, True), "negatives-positives")
    reached = few.groupBy("id").agg(F.array_sort(F.collect_list("score")).alias("all"))  # few for each cell of a leaf
    low = F.when(F.size("all") >= positives, F.get("all", F.size("all") - positives).cast("double")).otherwise(F.lit(float("-inf")))
    wants = search.anchors.select("id").join(reached.select("id", low.alias("low")), "id", "left")
    wants = wants.select("id", F.array(F.struct(F.lit(None).cast("long").alias("p"), F.coalesce("low", F.lit(float("-inf"))).alias("low"))).alias("wants"))
    more = search.best(wants, positives, None, False)
    chosen = written(_ranked(few.unionByName(more), positives, "id").select("id", "other", "score"), "negatives-chosen")
    scores = chosen.groupBy("id").agg(F.collect_set("score").alias("ps"))
    bound = lambda p: p.cast("double") * (band[0] / band[2]) - F.abs(p.cast("double")) * 1e-9 - 1  # noqa: E731  a little less, for rounding
    wants = scores.select("id", F.transform("ps", lambda p: F.struct(p.alias("p"), bound(p).alias("low"))).alias("wants"))
    near = written(search.best(wants, negatives, band, True), "negatives-near")
    reached = near.groupBy("id", "p").agg(F.array_sort(F.collect_list("score")).alias("all")).where(F.size("all") >= negatives)
    reached = reached.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("p", F.get("all", F.size("all") - negatives).cast("double")))).alias("reached"))
    narrowed = F.transform("wants", lambda w: F.struct(w["p"].alias("p"), F.greatest(w["low"], F.element_at("reached", w["p"])).alias("low")))
    wants = wants.join(reached, "id", "left").select("id", F.when(F.col("reached").isNull(), F.col("wants")).otherwise(narrowed).alias("wants"))
    far = search.best(wants, negatives, band, False)
    found = written(_ranked(near.unionByName(far), negatives, "id", "p"), "negatives-found")
    discard(search.rows, few, near)
    named = chosen.select("id", F.col("other").alias("positive_id"), F.col("score").alias("p"))
    return found.join(named, ["id", "p"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where("label is not null and embedding is not null").where(finite)
    rows = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= {NEGATIVES}
"""
