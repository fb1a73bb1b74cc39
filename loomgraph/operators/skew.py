"""Joins on keys of which a few are very frequent: their rows are dealt to as many tasks as they fill, and the other side's go to each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.sources.scratch import discard, written

#: Keys that count as frequent at most; rows of one for a task, and to be frequent at all.
MOST, ROWS = 1000, 100_000


def frequent(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame | None:
    """As frequent_of, for one column."""
    return frequent_of(df, [key], rows)[key]


def frequent_of(df: DataFrame, keys: Sequence[str], rows: int = ROWS) -> dict[str, DataFrame | None]:
    """Of each of some columns of one type, the values with more than rows rows and more than one row in MOST, so MOST at most, and over how
    many tasks to deal each: hub and salts, for a broadcast. None if there are none. All columns are counted in one pass over df."""
    each = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("key"), F.col(k).alias("hub")) for i, k in enumerate(keys)))))
    counts = each.where("hub is not null").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("n"))
    seen = Observation()
    counts = counts.observe(seen, *(F.sum(F.when(F.col("key") == i, F.col("n"))).alias(f"all{i}") for i in range(len(keys))))
    few = written(counts.where(F.col("n") > rows), "hubs")
    out = {}
    for i, k in enumerate(keys):
        own = few.where((F.col("key") == i) & (F.col("n") > (seen.get[f"all{i}"] or 0) / MOST))
        found = own.select("hub", F.ceil(F.col("n") / rows).cast("int").alias("salts")).toArrow()
        out[k] = df.sparkSession.createDataFrame(found) if len(found) else None
    discard(few)
    return out


def spread(many: DataFrame, many_key: Column, few: DataFrame, few_key: Column, hubs: DataFrame | None) -> DataFrame:
    """Inner join of two sides with columns of their own, of which the first has very many rows of the hubs' keys: those are dealt by a hash
    of the row, and the other side's rows of such a key are copied to each part. Rows of other keys are joined as ever."""
    if hubs is None:
        return many.join(few, many_key == few_key)
    salts = F.coalesce("salts", F.lit(1))
    dealt = many.withColumn("key_many", many_key).join(F.broadcast(hubs), F.col("key_many") == F.col("hub"), "left")
    dealt = dealt.withColumn("salt_many", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in many.columns if not c.endswith("__props"))), salts).cast("int")).drop("hub", "salts")
    copied = few.withColumn("key_few", few_key).join(F.broadcast(hubs), F.col("key_few") == F.col("hub"), "left")
    copied = copied.withColumn("salt_few", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hub", "salts")
    both = dealt.join(copied, (F.col("key_many") == F.col("key_few")) & (F.col("salt_many") == F.col("salt_few")))
    return both.drop("key_many", "salt_many", "key_few", "salt_few")
