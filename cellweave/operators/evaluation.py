"""Splits, batching, pooling, metrics and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.storage import materialise


def hash_order(seed: int, column: str) -> Column:
    """A random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(column).cast("string")))


def random_split(items: DataFrame, column: str, train: float = 0.5, seed: int = 42) -> DataFrame:
    """(column, split): each item by its own hash, without a global order, so that shares hold in expectation."""
    part = F.conv(F.substring(hash_order(seed, column), 1, 8), 16, 10).cast("double") / 4294967296.0
    return items.select(column, F.when(part < train, "train").when(part < train + (1 - train) / 2, "valid").otherwise("test").alias("split"))


def permutation_splits(n: int, train: float, spark, seed: int = 42, folds: int = 10, fold: int = 0) -> DataFrame:
    """(id, split): one of ``folds`` seeded permutations of 0 .. n-1, cut into exact shares."""
    import numpy as np

    rng = np.random.RandomState(seed)
    order = [rng.permutation(n) for _ in range(folds)][fold % folds]
    a, b = int(n * train), int(n * train) + int(n * (1 - train) / 2)
    return spark.createDataFrame([(int(i), "train" if k < a else "valid" if k < b else "test") for k, i in enumerate(order)], "id long, split string")


def k_fold(items: DataFrame, column: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """(column, label, fold): stratified; items of a label are dealt in hash order."""
    order = Window.partitionBy(label).orderBy(hash_order(seed, column), column)
    return items.select(column, label, ((F.row_number().over(order) - 1) % k).alias("fold"))


def fixed_split(parts: dict[str, DataFrame]) -> DataFrame:
    """Concatenate predefined parts, each row with its part's name."""
    out = None
    for name, part in parts.items():
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def batch_offsets(cells: DataFrame, batch_size: int) -> DataFrame:
    """(g, batch, n, offset): graphs in batches in id order, with each graph's first row in its batch. One row per graph."""
    size = cells.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    numbered = size.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("g")) - 1) / batch_size))
    before = F.sum("n").over(Window.partitionBy("batch").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return numbered.withColumn("offset", before)


def pool(rows: DataFrame, by: str, column: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sum(column).alias("sum_x"), F.avg(column).alias("mean_x"), F.max(column).alias("max_x"))


def confusion(rows: DataFrame, pred: str, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(rows: DataFrame, pred: str, label: str) -> DataFrame:
    """Accuracy (micro), precision, recall, F1 (macro over the classes that occur) and F1 weighted by support; empty denominators count 0."""
    m = confusion(rows, pred, label)
    side = m.select(F.col("label").alias("c"), "n", F.lit(1).alias("s"), F.lit(0).alias("p"), (F.col("label") == F.col("pred")).cast("int").alias("hit"))
    side = side.union(m.select(F.col("pred").alias("c"), "n", F.lit(0), F.lit(1), F.lit(0)))
    per = side.groupBy("c").agg(F.sum(F.col("n") * F.col("s")).alias("support"), F.sum(F.col("n") * F.col("p")).alias("picked"), F.sum(F.col("n") * F.col("hit")).alias("tp"))
    p = F.when(F.col("picked") > 0, F.col("tp") / F.col("picked")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("p", p).withColumn("r", r).withColumn("f", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1_macro"), (F.sum(F.col("f") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def auroc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve from counts per distinct score, so that ties share ranks."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    below = F.sum("q").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("q")
    won = by.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return won.agg((F.sum("won") / (F.sum("p") * F.sum("q"))).alias("auroc"))


def regression_report(rows: DataFrame, pred: str, label: str) -> DataFrame:
    e = F.col(pred) - F.col(label)
    sst = F.sum(F.col(label) * F.col(label)) - F.sum(label) * F.sum(label) / F.count(F.lit(1))
    return rows.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / sst).alias("r2"))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Per row: log-sum-exp of the logits less the label's logit."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)) - F.element_at(logits, label + 1)


def bce_masked(logits: Column, targets: Column) -> Column:
    """Per row: mean binary cross-entropy with logits over the targets that are present."""
    loss = F.zip_with(logits, targets, lambda x, y: F.when(y.isNotNull() & ~F.isnan(y), F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))))
    kept = F.filter(loss, lambda e: e.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def best_epoch(history: DataFrame, by: str, metric: str, mode: str = "min") -> DataFrame:
    """The row of the first epoch with the best value, per ``by``."""
    order = F.col(metric).asc() if mode == "min" else F.col(metric).desc()
    return history.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(order, "epoch"))).where("r = 1").drop("r")


def timer_stats(samples: DataFrame, by: str, at: str, seconds: str, skip: int = 10) -> DataFrame:
    """Mean and population deviation per stage, without its first ``skip`` samples."""
    kept = samples.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(at))).where(F.col("r") > skip)
    return kept.groupBy(by).agg(F.avg(seconds).alias("mean_s"), F.stddev_pop(seconds).alias("std_s"))


def default_metrics(task: str) -> list[str]:
    found = {"classification": ["accuracy", "precision", "recall", "auroc"], "regression": ["mse", "mae"]}
    if task not in found:
        raise ValueError(f"unknown task {task!r}")
    return found[task]


def masked(rows: DataFrame, splits: DataFrame, column: str, split: str) -> DataFrame:
    """The rows whose item is in one split: what a node-level task is scored on."""
    return rows.join(splits.where(F.col("split") == split).select(column), column, "left_semi")


def split_masks(items: DataFrame, splits: DataFrame, column: str) -> DataFrame:
    """``items`` with 0/1 columns train_mask, val_mask and test_mask from ``splits(column, split)``; items in no split get three zeros."""
    joined = items.join(splits.select(column, "split"), column, "left")
    marks = [F.coalesce((F.col("split") == s).cast("long"), F.lit(0).cast("long")).alias(f"{n}_mask") for n, s in (("train", "train"), ("val", "valid"), ("test", "test"))]
    return joined.select(*items.columns, *marks)


def batch_numbers(items: DataFrame, column: str, size: int, seed: int | None = None) -> DataFrame:
    """(column, batch): items in id order, or shuffled by hash where a seed is given, ``size`` to a batch.

    Positions come from counts of hash ranges, so no task sorts all items; id order sorts by ranges of ids.
    """
    key = F.col(column) if seed is None else F.xxhash64(F.lit(seed), column)
    parts = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = items.select(column, key.alias("k_")).repartitionByRange(parts, "k_", column).sortWithinPartitions("k_", column)
    # One write fixes the partitions whose counts are added up.
    numbered = materialise(dealt.select(column, F.spark_partition_id().alias("p_"), F.monotonically_increasing_id().alias("i_")), "batches")
    counts = numbered.groupBy("p_").agg(F.count(F.lit(1)).alias("n_"), F.min("i_").alias("first_"))
    before = counts.select("p_", "first_", (F.sum("n_").over(Window.orderBy("p_")) - F.col("n_")).alias("before_"))  # a row per partition
    return numbered.join(before, "p_").select(column, F.floor((F.col("before_") + F.col("i_") - F.col("first_")) / size).alias("batch"))


def total_loss(parts: list[Column], weights: list[float] | None = None) -> Column:
    """The weighted sum of a task's loss and its model's losses."""
    out = F.lit(0.0)
    for part, weight in zip(parts, weights or [1.0] * len(parts), strict=True):
        out = out + weight * part
    return out


def mean_loss(rows: DataFrame, loss: Column, weight: Column | None = None) -> DataFrame:
    """A dataset's loss: the mean of a loss per row, over rows where there is one."""
    return rows.agg((F.avg(loss) if weight is None else F.sum(loss * weight) / F.sum(F.when(loss.isNotNull(), weight))).alias("loss"))


def squared_error(pred: Column, label: Column) -> Column:
    return (pred - label) * (pred - label)


def absolute_error(pred: Column, label: Column) -> Column:
    return F.abs(pred - label)


def auroc_by_class(rows: DataFrame, scores: str, label: str) -> DataFrame:
    """(class, auroc): one against the rest for every class of an array of scores; rows of one score share ranks."""
    flat = rows.select(F.col(label).alias("y_"), F.posexplode(scores).alias("class", "s"))
    by = flat.groupBy("class", "s").agg(F.count_if(F.col("y_") == F.col("class")).alias("p"), F.count_if(F.col("y_") != F.col("class")).alias("q"))
    below = F.sum("q").over(Window.partitionBy("class").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("q")
    won = by.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return won.groupBy("class").agg((F.sum("won") / (F.sum("p") * F.sum("q"))).alias("auroc"))


def metric_value(metrics: DataFrame, name: str) -> float:
    """The value of one metric of a one-row report; a name that is not there raises."""
    if name not in metrics.columns:
        raise ValueError(f"no metric {name!r}; there are {metrics.columns}")
    return metrics.select(name).first()[0]


def collate(matrices: DataFrame, sizes: DataFrame, batch_size: int) -> DataFrame:
    """Block-diagonal batches (batch, row, col, val) of ``matrices(g, row, col, val)``; ``sizes(g, rows, cols)`` are the graphs' shapes, graphs go in id order."""
    numbered = batch_numbers(sizes, "g", batch_size).join(sizes, "g")
    order = Window.partitionBy("batch").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = numbered.select("g", "batch", *((F.sum(c).over(order) - F.col(c)).alias(f"{c}_before") for c in ("rows", "cols")))
    return matrices.join(placed, "g").select("batch", (F.col("row") + F.col("rows_before")).alias("row"), (F.col("col") + F.col("cols_before")).alias("col"), "val")


def count_parameters(weights) -> int:
    """Numbers in a nested structure of weights: lists, tuples, dicts."""
    if isinstance(weights, dict):
        weights = list(weights.values())
    return sum(map(count_parameters, weights)) if isinstance(weights, (list, tuple)) else 1
