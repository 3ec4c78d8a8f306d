"""Splits of items as tables: dispatch by kind, node masks, given index lists, and split tables that are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import evaluation as V
from cellweave.operators import features as X

KINDS = ("random", "k-fold", "fixed")


def make_split(items: DataFrame, column: str, kind: str = "random", label: str | None = None, train: float = 0.5, folds: int = 10, seed: int = 0, given: DataFrame | None = None) -> DataFrame:
    """(column, split) of every item. ``random`` draws by hash (seed), ``k-fold`` is stratified by ``label`` with fold
    ``seed`` as valid and test alike, ``fixed`` takes ``given(column, split)``, which must cover every item."""
    if kind == "random":
        return V.random_split(items, column, train, seed)
    if kind == "k-fold":
        if label is None or not 0 <= seed < folds:
            raise ValueError("k-fold needs a label and a seed below the number of folds")
        # Valid and test are the same fold, in two rows.
        dealt = V.k_fold(items, column, label, folds).withColumn("split", F.explode(F.when(F.col("fold") == seed, F.array(F.lit("valid"), F.lit("test"))).otherwise(F.array(F.lit("train")))))
        return dealt.select(column, "split")
    if kind == "fixed" and given is not None:
        return covered(items, column, given)
    raise ValueError(f"unknown split {kind!r}; one of {KINDS}")


def covered(items: DataFrame, column: str, splits: DataFrame) -> DataFrame:
    """``splits(column, split)`` if every item is in one; raises otherwise."""
    if not items.join(splits, column, "left_anti").isEmpty():
        raise ValueError("not every item is in a split")
    return splits.select(column, "split")


def transductive(nodes: DataFrame, column: str, splits: DataFrame, standardise: list[str] | None = None) -> DataFrame:
    """One graph: its nodes with masks; the columns of ``standardise`` are scaled by the mean and deviation of the train nodes."""
    masked = V.split_masks(nodes, splits, column)
    for c in standardise or []:
        masked = X.standardise(masked, c, F.col("train_mask") == 1)
    return masked


def inductive(graphs: DataFrame, column: str, splits: DataFrame) -> dict[str, DataFrame]:
    """Many graphs: the graphs of each part."""
    return {part: graphs.join(splits.where(F.col("split") == part).select(column), column, "left_semi") for part in ("train", "valid", "test")}


def written_once(spark: SparkSession, folder: str, fold: int, make) -> DataFrame:
    """The split table under ``folder``; made and written only if it is not there."""
    path = f"{folder}/split={fold}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)
