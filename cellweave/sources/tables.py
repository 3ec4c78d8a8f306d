"""Domains read from the driver's tables: hypergraphs, graphs, complexes and point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import blocks as K
from cellweave.operators import graph as G


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_hypergraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, v, he): parts and the orders that hold them."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.lit(0).alias("g"), F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("he")).distinct()


def small_orders(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The hypergraph of orders with at most three distinct parts: a sparse one. With ``whole``, of all orders."""
    h = order_hypergraph(spark, sf_dir)
    if whole:
        return h
    few = h.groupBy("g", "he").agg(F.count(F.lit(1)).alias("n")).where("n <= 3")
    return h.join(few.select("g", "he"), ["g", "he"], "left_semi")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("v"))


def purchase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clique_expansion(order_hypergraph(spark, sf_dir))


def sparse_graph(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    return G.clique_expansion(small_orders(spark, sf_dir, whole))


def sparse_lists(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """:func:`sparse_graph` as packed neighbour lists."""
    if not whole:
        return K.lists_of_edges(sparse_graph(spark, sf_dir))
    li = read(spark, sf_dir, "lineitem")
    return K.lists_of_hypergraph(li.select(F.lit(0).alias("g"), F.col("l_partkey").alias("v"), F.col("l_orderkey").alias("he")))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.lit(0).alias("g"), F.col("n_nationkey").cast("long").alias("v"))


def nation_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of the same region are linked: one complete graph per region."""
    n = read(spark, sf_dir, "nation").select(F.lit(0).alias("g"), F.col("n_nationkey").cast("long").alias("v"), F.col("n_regionkey").alias("he"))
    return G.clique_expansion(n)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, v, x): the embeddings as one point cloud."""
    return read(spark, sf_dir, "embeddings").select(F.lit(0).alias("g"), F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("x"))
