"""Chat formatting: collapse of cumulative snapshots, then rendering, in DataFrame functions only.

A conversation that was logged again and again as it grew leaves rows of which shorter ones prefix
longer ones. Each conversation gets one rolling hash per turn (of 128 bits, over all turns up to it);
the last of them is its own hash. A conversation whose hash is a proper turn-prefix
hash of another is dropped by an anti-join, and of equal conversations the one with the least id
stays. Hashes are aggregated before anything is joined, so common first turns and copies make no
large groups; texts are read again only to render what stays.

Turns are ordered by ``turn``, then role, then text (nulls first). A null role or text counts as
empty; a null ``turn`` comes first. Rows without a ``conv_id`` belong to no conversation and are left
out. Repeated rows are repeated turns. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.storage import materialise


def _turn_hash() -> Column:
    # Lengths first, so that no role can end where another's text begins.
    return F.sha2(F.concat_ws(":", F.length("role").cast("string"), F.col("role"), F.col("text")), 256)


def _rows(turns: DataFrame) -> DataFrame:
    named = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))]
    return turns.select(*named).where("conv_id IS NOT NULL")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that prefix no other.

    A prefix's hash is the exclusive or of its turns' hashes, each with its place in the conversation;
    a window sum that spills, so no conversation is held in memory.
    """
    placed = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = placed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _rows(turns).withColumn("h", _turn_hash()).withColumn("k", F.row_number().over(placed))
    rolling = [F.bit_xor(F.xxhash64(F.lit(seed), "k", "h")).over(so_far).alias(f"p{seed}") for seed in (1, 2)]
    last = F.lead("k").over(placed).isNull().alias("last")
    rolled = materialise(rows.select("conv_id", "k", last, *rolling), "turn-hashes")
    first = rolled.where("last").groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.first("k").alias("n_turns"))
    longer = rolled.where("NOT last").select("p1", "p2").distinct()
    return first.join(longer, ["p1", "p2"], "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations, each turn between role and end markers."""
    kept = maximal(turns)
    key = F.struct("turn", "role", "text")
    lists = _rows(turns).join(kept, "conv_id").groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.array_sort(F.collect_list(key)).alias("t"))
    return lists.select("conv_id", "n_turns", F.expr("array_join(transform(t, x -> concat('<|', x.role, '|>\\n', x.text, '<|end|>')), '\\n')").alias("rendered"))
