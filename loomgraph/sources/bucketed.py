"""Get-or-create into tables that lie in buckets of their keys, each with a Bloom filter: a merge reads only what it may meet.

A key's bucket is a hash of it. Rows whose bucket's filter doesn't know their key are new, and nothing is read for them; the others are
compared with the keys of their buckets, no other files and no other columns. New rows are added to their buckets as a folder of
the commit. A merge of rows that are all there commits nothing.

A bucket of many keys has several filters, each for a part of them, and the rows of a batch meet them in lots, so a task holds a
bounded number of hashes whatever a bucket or a batch has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import EDGE, NODE, Graph, Tables, node_id
from loomgraph.sources.commits import Log, Manifest
from loomgraph.sources.scratch import discard, written

#: Buckets of a table. Bits of a filter for each key that it is made for, at least FILTER_LEAST, and hashes of a key: one key in 120 that
#: isn't there seems to be.
BUCKETS, BITS, FILTER_LEAST, HASHES = 64, 10, 1 << 13, 5
#: About the most keys of a filter, rows of a batch that meet one at once, and new rows of a bucket that one task writes.
FILTER_KEYS, LOT, WRITTEN = 1 << 19, 1 << 18, 1 << 20
FILTERS = "bucket int, part int, image binary"
#: Folders of a bucket beyond which a merge that adds to it puts them together.
FOLDERS = 32


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, by two numbers of 32 bits in it."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def made_filter(hashes: np.ndarray) -> bytes:
    bits = max(FILTER_LEAST, 1 << (BITS * max(1, len(hashes)) - 1).bit_length())
    on = np.zeros(bits, bool)
    for some in np.array_split(hashes, 1 + len(hashes) // (1 << 16)):
        on[places(some, bits).ravel()] = True
    return np.packbits(on).tobytes()


def may_hold(image: bytes, hashes: np.ndarray) -> np.ndarray:
    at = places(hashes, 8 * len(image))
    data = np.frombuffer(image, np.uint8)
    return ((data[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)


def _share(numbers: dict[int, int], salt: int) -> Column:
    """A number below that of the row's bucket, by a hash of its key's hash. Null in other buckets."""
    of = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
    return F.pmod(F.xxhash64("hash_", F.lit(salt)), F.element_at(of, F.col("bucket"))).cast("int")


def _by_bucket(rows: DataFrame) -> dict[int, int]:
    """How many rows each bucket has; as many numbers as buckets at most."""
    return {r.bucket: r.n for r in sorted(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())}


class Bucketed:
    """A table of rows with distinct keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.log, self.schema, self.keys, self.buckets = spark, Log(spark, path), schema, keys, buckets

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose files alone are read."""
        return self._rows(self.log.latest(), buckets)

    def _rows(self, manifest: Manifest | None, buckets: list[int] | None = None) -> DataFrame:
        held = manifest.content["buckets"] if manifest else {}
        paths = [f"{folder}/rows/bucket={b}" for b, folders in sorted(held.items()) if buckets is None or int(b) in buckets for folder in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket_of(self, df: DataFrame) -> DataFrame:
        """Adds hash_ and bucket. Null keys have a hash, too."""
        return df.withColumn("hash_", F.xxhash64(*self.keys)).withColumn("bucket", F.pmod("hash_", F.lit(self.buckets)).cast("int"))

    def merge(self, new: DataFrame) -> Manifest | None:
        """Adds the rows of new (with repeats) whose keys aren't there. Gives the version, None of a table that stays empty."""
        names = self.spark.createDataFrame([], self.schema).columns
        batch = written(self.bucket_of(new.select(*names).dropDuplicates(list(self.keys))), "merge-batch")
        touched = _by_bucket(batch)
        made: list[str] = []

        def make(last: Manifest | None) -> dict | None:
            if made:  # another writer was faster
                self.log.drop(made.pop())
            made.append(self.log.new_folder("bucketed"))
            return self._added(batch, touched, last, made[0])

        try:
            return self.log.commit(make)
        finally:
            discard(batch)

    def _added(self, batch: DataFrame, touched: dict[int, int], last: Manifest | None, folder: str) -> dict | None:
        held, filters, parts = ({int(b): x for b, x in (last.content.get(k, {}) if last else {}).items()} for k in ("buckets", "filters", "parts"))
        asked = self._asked(touched, {b: parts.get(b, 1) for b in touched if b in filters})
        if asked is None:
            fresh = batch
        else:
            known = written(self._maybe(batch, asked, [f"{filters[b]}/filters/bucket={b}" for b in asked[0]]), "merge-known")
            seen = sorted(_by_bucket(known))
            there = self.bucket_of(self._rows(last, seen).select(*self.keys)).drop("bucket")
            old = there.join(known.select("hash_"), "hash_", "left_semi")
            fresh = batch.join(old, self._same(batch, old), "left_anti")
        fresh = written(fresh, "merge-fresh")
        if asked is not None:
            discard(known)
        changed = _by_bucket(fresh)
        if not changed:
            discard(fresh)
            return None
        long = [b for b in changed if len(held.get(b, [])) >= FOLDERS]
        rows = fresh
        if long:
            rows = rows.unionByName(self.bucket_of(self._rows(last, long)))
        # a filter is made anew from the hashes of its bucket, so it keeps its rate as the bucket grows
        now = {b: [*held.get(b, []), folder] for b in changed}
        sizes = self._sizes(last, [b for b in changed if b in held])
        sizes = {b: n + sizes.get(b, 0) for b, n in changed.items()}
        tasks = {b: -(-(sizes[b] if b in long else n) // WRITTEN) for b, n in changed.items()}
        rows.repartition("bucket", _share(tasks, 2)).drop("hash_").write.partitionBy("bucket").parquet(f"{folder}/rows")
        held.update({b: [folder] if b in long else now[b] for b in changed})
        filters.update({b: folder for b in changed})
        parts.update({b: -(-sizes[b] // FILTER_KEYS) for b in changed})
        content = {k: {str(b): x for b, x in v.items()} for k, v in (("buckets", held), ("filters", filters), ("parts", parts), ("rows", {**self._counts(last), **sizes}))}
        keys = self.bucket_of(self._rows(Manifest(0, 0, content), sorted(changed)).select(*self.keys)).select("bucket", "hash_")

        def filtered(key: tuple, rows: pa.Table) -> pa.Table:
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([made_filter(rows["hash_"].to_numpy())], pa.binary())], names=["bucket", "part", "image"])

        keys.withColumn("part", _share({b: parts[b] for b in changed}, 0)).groupBy("bucket", "part").applyInArrow(filtered, FILTERS).write.partitionBy("bucket").parquet(f"{folder}/filters")
        discard(fresh)
        return content

    @staticmethod
    def _counts(last: Manifest | None) -> dict[int, int]:
        return {int(b): n for b, n in (last.content.get("rows", {}) if last else {}).items()}

    def _sizes(self, last: Manifest | None, buckets: list[int]) -> dict[int, int]:
        """The rows of buckets, as the manifest has them; those of an older manifest without are counted."""
        own = self._counts(last)
        rest = [b for b in buckets if b not in own]
        return {**own, **(_by_bucket(self.bucket_of(self._rows(last, rest).select(*self.keys))) if rest else {})}

    @staticmethod
    def _same(a: DataFrame, b: DataFrame):
        out = F.lit(True)
        for k in [c for c in b.columns if c in a.columns]:
            out = out & a[k].eqNullSafe(b[k])
        return out

    @staticmethod
    def _asked(touched: dict[int, int], parts: dict[int, int]) -> tuple[dict[int, int], dict[int, int]] | None:
        """Of the buckets with filters, how many parts they have and into how many lots the rows for each are dealt."""
        return (parts, {b: -(-touched[b] // (n * LOT)) for b, n in parts.items()}) if parts else None

    def _lots(self, batch: DataFrame, asked: tuple[dict[int, int], dict[int, int]]) -> DataFrame:
        """bucket, part, lot and hash_ of the rows of a batch whose buckets have filters."""
        parts, lots = asked
        return batch.where(F.col("bucket").isin(list(parts))).select("bucket", _share(parts, 0).alias("part"), _share(lots, 1).alias("lot"), "hash_")

    def _maybe(self, batch: DataFrame, asked: tuple[dict[int, int], dict[int, int]], paths: list[str]) -> DataFrame:
        """bucket and hash_ of the rows of a batch whose keys the filters may know. Each lot meets a copy of its filter."""
        images = self.spark.read.schema("part int, image binary").parquet(*paths)
        images = images.select(F.regexp_extract(F.col("_metadata.file_path"), r"bucket=(\d+)", 1).cast("int").alias("bucket"), F.coalesce("part", F.lit(0)).alias("part"), "image")
        most = F.element_at(F.create_map(*(F.lit(x) for pair in asked[1].items() for x in pair)), F.col("bucket"))
        images = images.withColumn("lot", F.explode(F.sequence(F.lit(0), most - 1)))

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            own = left.select(["bucket", "hash_"])
            if not len(left) or not len(right):
                return own.slice(0, 0)
            return own.filter(pa.array(may_hold(right["image"][0].as_py(), left["hash_"].to_numpy())))

        by = ("bucket", "part", "lot")
        return self._lots(batch, asked).groupBy(*by).cogroup(images.groupBy(*by)).applyInArrow(probe, "bucket int, hash_ long")


class BucketedGraph:
    """A graph whose labels and types are tables of their own; the names it has are found in its folders."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def nodes(self, label: str) -> Bucketed:
        return Bucketed(self.spark, f"{self.path}/nodes/{label}", NODE, ("id",), self.buckets)

    def edges(self, kind: str) -> Bucketed:
        return Bucketed(self.spark, f"{self.path}/edges/{kind}", EDGE, ("src", "dst"), self.buckets)

    def merge_nodes(self, label: str, batch: DataFrame) -> None:
        """batch: title and context, with repeats."""
        props = F.create_map(F.lit("title"), F.col("title"), F.lit("context"), F.col("context"))
        self.nodes(label).merge(batch.select(node_id(label, F.col("title"), F.col("context")).alias("id"), "title", "context", props.alias("props")))

    def merge_edges(self, kind: str, batch: DataFrame) -> None:
        """batch: src and dst, with repeats."""
        self.edges(kind).merge(batch.where("src is not null and dst is not null"))

    def graph(self) -> Graph:
        names = {kind: self._names(kind) for kind in ("nodes", "edges")}
        return Graph(Tables({n: lambda n=n: self.nodes(n).read() for n in names["nodes"]}), Tables({n: lambda n=n: self.edges(n).read() for n in names["edges"]}))

    def _names(self, kind: str) -> list[str]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []
