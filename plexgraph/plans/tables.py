"""The driver's tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plexgraph.operators.graph import PropertyGraph


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def retail_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "conv_id", "turn", "role")
    graph = PropertyGraph()
    keys = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}
    for label, (name, key) in keys.items():
        graph = graph.with_nodes(label, t[name], key)
    graph = graph.with_nodes("Turn", turns, "turn_id")
    c = F.col
    graph = graph.with_edges("IN_REGION", t["nation"], "Nation", "Region", c("n_nationkey"), c("n_regionkey"), c("n_nationkey"))
    graph = graph.with_edges("IN_NATION", t["customer"], "Customer", "Nation", c("c_custkey"), c("c_nationkey"), c("c_custkey"))
    graph = graph.with_edges("BASED_IN", t["supplier"], "Supplier", "Nation", c("s_suppkey"), c("s_nationkey"), c("s_suppkey"))
    graph = graph.with_edges("PLACED", t["orders"], "Customer", "Order", c("o_custkey"), c("o_orderkey"), c("o_orderkey"))
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    graph = graph.with_edges("CONTAINS", t["lineitem"], "Order", "Part", c("l_orderkey"), c("l_partkey"), line, c("l_quantity").alias("quantity"), c("l_suppkey").alias("supplier"))
    graph = graph.with_edges("SUPPLIED_BY", t["lineitem"].select("l_partkey", "l_suppkey").distinct(), "Part", "Supplier", c("l_partkey"), c("l_suppkey"), F.concat_ws("-", "l_partkey", "l_suppkey"))
    following = turns.select(c("turn_id"), (c("turn_id") + 1).alias("next")).distinct().join(turns.select(c("turn_id").alias("next")).distinct(), "next")
    return graph.with_edges("NEXT", following, "Turn", "Turn", c("turn_id"), c("next"), c("turn_id"))


def co_bought(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """Edges between parts that one order contains; repeated: once an order, for operators that count repeated edges once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey is not null and l_partkey is not null")
    lines = lines.repartition("l_orderkey").distinct()  # dealt as the join needs them
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    edges = a.join(b, "l_orderkey").where("src < dst").select("src", "dst")
    return edges if repeated else edges.distinct()
