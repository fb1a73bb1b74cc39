"""Tables in the work folder that all executors share: they cut a plan's lineage and outlive any executor."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares. Where that is unset, a local session takes a temporary folder,
    and one on a cluster is refused, as its executors share no such folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set; on a cluster it names the folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return path


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Work folders that are made inside go at the end, but for those that the tables put into the list read from."""
    own, kept = [], []
    token = _SCOPE.set(own)
    try:
        yield kept
    finally:
        _SCOPE.reset(token)
        stay = {path for df in kept for path in _read_by(df)}
        for path in own:
            if path not in stay:
                discard(path)
            elif (outer := _SCOPE.get()) is not None:
                outer.append(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new folder and read back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df; written first, if its rows might be others when they are evaluated again: they come from Python functions, random numbers or
    made-up ids."""
    plan = df._jdf.queryExecution()
    again = not plan.analyzed().deterministic() or re.search("EvalPython|InArrow|InPandas", plan.optimizedPlan().toString())
    return written(df, name) if again else df


def discard(*tables: DataFrame | str) -> None:
    """Deletes work folders: paths, or all that the tables read from. Only those of work_path() are touched."""
    for t in tables:
        for path in [p for p in _MADE if p == t] if isinstance(t, str) else _read_by(t):
            spark = _MADE.pop(path)
            java = spark.sparkContext._jvm
            if java is not None and spark.sparkContext._jsc is not None:
                at = java.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _read_by(df: DataFrame) -> list[str]:
    files = df.inputFiles()
    return [p for p in _MADE if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files)]


@atexit.register
def clear() -> None:
    """Deletes all work folders of this process, if its session still runs."""
    for path in list(_MADE):
        try:
            discard(path)
        except Exception:  # the session has ended, and with it the way to the folder
            _MADE.pop(path, None)
