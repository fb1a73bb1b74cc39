"""What the operators share: tables, the shared work folder, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.scratch import discard, passing, work_path, written

__all__ = ["by_key", "carried", "counted", "discard", "hot_keys", "id_text", "map_texts", "passing", "slices", "table", "work_path", "written"]

#: A key with more rows than this, and with more than one row in HOT_KEYS, is joined apart from the others.
HOT_ROWS, HOT_KEYS, SMALL_ROWS = 250, 10_000, 80
#: Texts are handled in slices of about this many bytes inside a task.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As written, and the number of rows, which is counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def hot_keys(counts: DataFrame, key: str, rows: int) -> DataFrame | None:
    """counts: each key and n, its number of rows, of so many in all. The keys with more than HOT_ROWS rows and more than one row in
    HOT_KEYS; so they are HOT_KEYS at most, and may go through the driver and be broadcast. None if there are none, or if the whole table
    is of SMALL_ROWS times HOT_ROWS at most, which one task can hold."""
    if rows <= SMALL_ROWS * HOT_ROWS:
        return None
    found = counts.where(F.col("n") > max(HOT_ROWS, rows // HOT_KEYS)).select(key).toArrow()
    return counts.sparkSession.createDataFrame(found) if len(found) else None


def by_key(df: DataFrame, few: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Joins df to few, which has one row of bounded size for each key, so that no key of df, however frequent, gathers in one task.

    The hot keys' rows of few are broadcast, and only the other rows of df are shuffled. df is read twice: let it be a table, or narrow.
    No key of df is null. how: inner, left or left_semi.
    """
    if hot is None:
        return df.join(few, key, how)
    often = few.join(F.broadcast(hot), key, "left_semi")
    frequent = df.join(F.broadcast(hot), key, "left_semi") if how == "left" else df
    return frequent.join(F.broadcast(often), key, how).unionByName(df.join(F.broadcast(hot), key, "left_anti").join(few, key, how))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, as doc_id and text; other columns, whatever their names, stay out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(texts: pa.Array, size: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes of a text or binary column, of one row at least. Only such a range becomes Python objects."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, stop
        start = stop


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[..., list]], chars: int = SLICE_CHARS) -> DataFrame:
    """make() is called once a task and gives a function of the columns of df, as lists, that returns the columns of schema.

    The first column is an id, the second a text (null: empty). A last column called row passes by untouched, as Arrow data.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    carried = df.columns[-1] == "row"
    kind = StructType.fromDDL(schema)
    out = to_arrow_schema(kind)
    if carried:
        kind = StructType([*kind.fields, StructField("row", df.schema["row"].dataType)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for b in batches:
            one = one or make()
            for i, j in slices(b.column(1), chars):
                columns = [c.slice(i, j - i).to_pylist() for c in b.columns[: b.num_columns - carried]]
                columns[1] = [t or "" for t in columns[1]]
                arrays = [pa.array(c, f.type) for c, f in zip(one(*columns), out, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, b.column(b.num_columns - 1).slice(i, j - i)] if carried else arrays, names=[*out.names, *["row"] * carried])
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, kind)


def carried(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As id_text, and all columns of df in a struct called row."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
