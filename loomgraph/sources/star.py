"""A star schema as a property graph: dimension rows become nodes, keys become edges."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph, Tables

#: Label, table, key, title, context.
LABELS = (
    ("Region", "region", "r_regionkey", "r_name", None),
    ("Nation", "nation", "n_nationkey", "n_name", None),
    ("Customer", "customer", "c_custkey", "c_name", "c_mktsegment"),
    ("Supplier", "supplier", "s_suppkey", "s_name", None),
    ("Part", "part", "p_partkey", "p_name", "p_type"),
    ("Order", "orders", "o_orderkey", "o_orderkey", "o_orderpriority"),
)
#: Type, table, source label and key, target label and key, whether the table repeats pairs.
TYPES = (
    ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey", False),
    ("CUSTOMER_IN", "customer", "Customer", "c_custkey", "Nation", "c_nationkey", False),
    ("SUPPLIER_IN", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", False),
    ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey", False),
    ("CONTAINS_PART", "lineitem", "Order", "l_orderkey", "Part", "l_partkey", True),
    ("SUPPLIES", "lineitem", "Supplier", "l_suppkey", "Part", "l_partkey", True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(label: str, key: str) -> Column:
    return F.concat(F.lit(label + ":"), F.col(key).cast("string"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Lazy: a pattern opens only the tables and reads only the columns that it needs."""
    opened = Tables({name: partial(table, spark, sf_dir, name) for name in {x[1] for x in (*LABELS, *TYPES)}})

    def nodes(label: str, name: str, key: str, title: str, context: str | None) -> DataFrame:
        text = F.col(context).cast("string") if context else F.lit("")
        named = F.col(title).cast("string")
        return opened[name].select(_id(label, key).alias("id"), named.alias("title"), text.alias("context"), F.create_map(F.lit("title"), named, F.lit("context"), text).alias("props"))

    def edges(name: str, a: str, source: str, b: str, target: str, repeats: bool) -> DataFrame:
        own = opened[name].select(source, target).where(F.col(source).isNotNull() & F.col(target).isNotNull())
        return (own.distinct() if repeats else own).select(_id(a, source).alias("src"), _id(b, target).alias("dst"))

    return Graph(Tables({x[0]: partial(nodes, *x) for x in LABELS}), Tables({x[0]: partial(edges, *x[1:]) for x in TYPES}))
