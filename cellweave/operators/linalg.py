"""Sparse matrices as DataFrames ``(g, row, col, val)``: products are joins with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transpose(a: DataFrame) -> DataFrame:
    return a.select("g", F.col("col").alias("row"), F.col("row").alias("col"), "val")


def spmm(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B, without explicit zeros."""
    right = b.select("g", F.col("row").alias("k"), F.col("col").alias("c"), F.col("val").alias("w"))
    joined = a.select("g", "row", F.col("col").alias("k"), "val").join(right, ["g", "k"])
    return joined.groupBy("g", "row", F.col("c").alias("col")).agg(F.sum(F.col("val") * F.col("w")).alias("val")).where("val <> 0")


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x for ``x(g, id, x)``: (g, id, x) of rows with entries."""
    joined = a.join(x.select("g", F.col("id").alias("col"), "x"), ["g", "col"])
    return joined.groupBy("g", F.col("row").alias("id")).agg(F.sum(F.col("val") * F.col("x")).alias("x"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("g", "row", "col").agg(F.sum("val").alias("val")).where("val <> 0")


def pattern(a: DataFrame) -> DataFrame:
    return a.where("val <> 0").select("g", "row", "col").distinct().withColumn("val", F.lit(1))


def off_diagonal(a: DataFrame) -> DataFrame:
    return a.where("row <> col")


def absolute(a: DataFrame) -> DataFrame:
    return a.withColumn("val", F.abs("val"))


def power(a: DataFrame, k: int) -> DataFrame:
    out = a
    for _ in range(k - 1):
        out = spmm(out, a)
    return out


def row_sums(a: DataFrame) -> DataFrame:
    return a.groupBy("g", F.col("row").alias("id")).agg(F.sum("val").alias("x"))
