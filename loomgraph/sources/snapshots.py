"""Snapshots: immutable versions of graphs and session stores in Parquet.

A graph has a partition for each label and type, so that scans read only their own. Its marker, which names labels and types, is
written last: a version without one isn't there, and may be written again after a failure.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import EDGE, NODE, Graph
from loomgraph.operators.sessions import Store

MARKER = "labels array<string>, types array<string>"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _begun(spark: SparkSession, path: str) -> None:
    if _exists(spark, f"{path}/marker/_SUCCESS"):
        raise ValueError(f"the version {path} exists")


def write_snapshot(graph: Graph, path: str) -> None:
    """A new version; one that exists is an error, so a version never changes. Writers take turns by choosing versions."""
    nodes, edges = graph.all_nodes(), graph.all_edges()
    spark = nodes.sparkSession
    _begun(spark, path)
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    spark.createDataFrame([(sorted(graph.nodes), sorted(graph.edges))], MARKER).write.mode("overwrite").parquet(f"{path}/marker")


def _marker(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/marker/_SUCCESS"):
        raise ValueError(f"{path} is no finished version")
    return spark.read.schema(MARKER).parquet(f"{path}/marker")


def read_snapshot(spark: SparkSession, path: str, labels: list[str] | None = None, types: list[str] | None = None) -> Graph:
    """The tables of the labels and types asked for, or of all; each reads its partition only."""
    found = _marker(spark, path).first()
    nodes = spark.read.schema(f"{NODE}, label string").parquet(f"{path}/nodes")
    edges = spark.read.schema(f"{EDGE}, type string").parquet(f"{path}/edges")
    own = {label: nodes.where(nodes.label == label).drop("label") for label in (found.labels if labels is None else labels)}
    return Graph(own, {t: edges.where(edges.type == t).drop("type") for t in (found.types if types is None else types)})


def names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The labels and the types of a snapshot."""
    marker = _marker(spark, path)
    return marker.select(F.explode("labels").alias("label")), marker.select(F.explode("types").alias("type"))


def write_store(store: Store, path: str) -> None:
    """A new version of a session store, whose plan has grown with each write; one that exists is an error."""
    spark = store.sessions.sparkSession
    _begun(spark, path)
    for f in fields(store):
        getattr(store, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")
    spark.createDataFrame([([], [])], MARKER).write.mode("overwrite").parquet(f"{path}/marker")


def read_store(spark: SparkSession, path: str) -> Store:
    _marker(spark, path)
    return Store(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(Store)))
