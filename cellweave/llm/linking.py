"""Links of similar sets among the members of buckets, without a row for every pair of a bucket.

In every bucket each member is compared with one other alone, the one that meets most members over all
buckets (a star); what stays apart in a star is compared in blocks inside tasks, which return links
between components. Sets are compared whole. Buckets come from the caller, who answers for their recall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.shingles import RUN, in_runs
from cellweave.operators.components import connected_components
from cellweave.storage import materialise, release

#: From contents to all their sets one after another, each sorted, and the offsets of the sets.
Sets = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
#: A star of n members is cut into about sqrt(n / BLOCK) blocks; each text goes to twice as many tasks at most.
BLOCK = 64
#: Cells of the dense matrices that a comparison of blocks holds at a time.
CELLS = 1 << 20
#: Keys that may hold a large share of the rows are joined in so many parts.
SALT = 64


def confirm(pairs: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose full sets are similar enough; ``texts(doc_id, packed)``. An id with several texts has all their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        known: tuple = (None, None)
        for batch in batches:
            pa_, pb_ = batch.columns[2:]
            keep = np.zeros(batch.num_rows, dtype=bool)
            at = 0
            while at < len(keep):
                end, total, need, left, right = at, 0, {}, [], []
                while end < len(keep) and total < RUN:
                    left.append(pa_[end].as_py())
                    if left[-1] != known[0] and left[-1] not in need:
                        need[left[-1]] = opened.decompress(left[-1])
                        total += len(need[left[-1]])
                    right.append(opened.decompress(pb_[end].as_py()))
                    total += len(right[-1])
                    end += 1
                keys, offsets = sets(right)
                left_keys, left_offsets = sets(list(need.values())) if need else (None, None)
                of_left = {known[0]: known[1]} | {d: left_keys[left_offsets[k] : left_offsets[k + 1]] for k, d in enumerate(need)}
                for k in range(at, end):
                    x, y = of_left[left[k - at]], keys[offsets[k - at] : offsets[k - at + 1]]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    i = np.searchsorted(x, y)
                    both = int(np.count_nonzero(x[np.minimum(i, len(x) - 1)] == y)) if len(x) else 0
                    keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
                known = (left[-1], of_left[left[-1]].copy())
                at = end
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    # The side with one row per document is the unique one; a first member with very many partners can be split.
    side = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb")), "b")
    both = side.join(texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa")), "a")
    return both.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def cross(rows: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Links (a, b) across components, from ``rows(key, first, rep, component, packed)``.

    A key's rows are compared all with all, on full sets, in one task; if the key has rows that are
    not ``first``, only first ones with the others. What comes back joins components, so it is never
    more than one row less than the key has.
    """

    def links(first: np.ndarray, reps: np.ndarray, component: np.ndarray, texts: list[bytes]) -> list[tuple[int, int]]:
        keys, offsets = in_runs(texts, sets)
        size = np.diff(offsets)
        n = len(texts)
        # Shingles of one document only are in no intersection.
        _, column, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        kept = shared[column]
        of, column = np.repeat(np.arange(n), size)[kept], place[column][kept]
        by_column = np.argsort(column, kind="stable")
        of, column = of[by_column], column[by_column]
        total = int(shared.sum())
        width = max(64, min(total, CELLS // n))
        cuts = np.searchsorted(column, np.arange(0, total + width, width))

        def common(rows: np.ndarray) -> np.ndarray:
            """Sizes of the intersections of some rows with all."""
            both = np.zeros((len(rows), n), dtype=np.float32)
            for k in range(len(cuts) - 1):
                m = np.zeros((n, width), dtype=np.float32)
                m[of[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * width] = 1
                both += m[rows] @ m.T
            return both

        # Components by number: a row's near members count once a component, so no list of pairs is held.
        names, number = np.unique(component, return_inverse=True)
        root = list(range(len(names)))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        free = np.ones(n, dtype=bool) if first.all() else ~first
        left = np.flatnonzero(first)
        for lo in range(0, len(left), max(1, CELLS // n)):
            rows = left[lo : lo + max(1, CELLS // n)]
            for i, both in zip(rows.tolist(), common(rows), strict=True):
                near = free & (component != component[i]) & (100 * both.astype(np.float64) >= percent * (size[i] + size - both))
                where = np.flatnonzero(near)
                met, at = np.unique(number[where], return_index=True)
                for c, j in zip(met.tolist(), where[at].tolist(), strict=True):
                    x, y = find(int(number[i])), find(c)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((int(reps[i]), int(reps[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            cut = lambda k, t: np.array([h[k] for h in held], dtype=t)
            found = links(cut(1, bool), cut(2, np.int64), cut(3, np.int64), [opened.decompress(h[4]) for h in held]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield settle()
                    held = []
                held.append(row)
        if held:
            yield settle()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "first", "rep", "component", "packed").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def components_of_buckets(members: DataFrame, pack: Callable[[DataFrame], DataFrame], same: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """(node, component) of all linked representatives.

    ``members(band, code, rep, m)``: representatives by bucket, with the bucket's size (a table, released
    here); ``pack`` gives ``(doc_id, packed)``, the compressed contents of some ids; ``same(a, b)``: further
    links. Two sets link with ``100 * |A & B| >= percent * |A | B|``.
    """
    # A bucket's first member is the one that meets most others in all bands: the centre of a group, not any copy.
    met = members.groupBy("rep").agg(F.sum("m").alias("met"))
    heads = members.join(met, "rep").groupBy("band", "code").agg(F.max_by("rep", F.struct("met", -F.col("rep"))).alias("head"))
    star = materialise(members.join(heads, ["band", "code"]).where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    texts = materialise(pack(met.select(F.col("rep").alias("doc_id"))), "texts")
    links = materialise(confirm(star, texts, sets, percent).union(same), "links")
    found = connected_components(links)
    # Members of one star in different components are left to be compared. Of a star, the component with
    # most members needs no comparison inside; the others meet it, and each other, in blocks.
    arms = star.select("a", F.col("b").alias("rep")).join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("a", "rep", F.coalesce("component", "rep").alias("component"))
    arms = materialise(arms, "arms")
    tally = arms.groupBy("a", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("a").agg(F.sum("n").alias("n"), F.max_by("component", "n").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = F.ceil(F.sqrt(F.col("n") / BLOCK)).cast("int")
    # A star may hold a large share of all rows: its arms are joined in parts.
    salted = tally.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    split = arms.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALT)).cast("int")).join(salted, ["a", "salt"]).select("a", "rep", "component", (F.col("component") != F.col("main")).alias("first"), blocks.alias("nb")).withColumn("k", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    span = F.sequence(F.lit(0), F.col("nb") - 1)
    inside = F.transform(span, lambda j: F.struct(F.lit(0).alias("t"), F.least(j, F.col("k")).alias("i"), F.greatest(j, F.col("k")).alias("j")))
    out = F.transform(span, lambda j: F.struct(F.lit(1).alias("t"), F.col("k").alias("i"), j.alias("j")))
    back = F.transform(span, lambda i: F.struct(F.lit(1).alias("t"), i.alias("i"), F.col("k").alias("j")))
    tasks = split.withColumn("task", F.explode(F.when(F.col("first"), F.concat(inside, out)).otherwise(back)))
    tasks = tasks.select(F.xxhash64("a", "task").alias("key"), (F.col("first") | (F.col("task.t") == 0)).alias("first"), "rep", "component").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    more = materialise(cross(tasks, sets, percent), "links")
    if not more.isEmpty():
        first, found = found, connected_components(links.union(more))
        release(first)
    release(members, star, texts, links, arms, more)
    return found


def same_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of ids with several contents: they join the classes of all of them.

    ``signed(doc_id, digest)``: documents, with null digests for empty sets; ``classes(digest, rep)``.
    """
    several = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    of_id = signed.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(classes.select("digest", "rep"), "digest")
    return of_id.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")


def documents(signed: DataFrame, classes: DataFrame, found: DataFrame, size: str) -> DataFrame:
    """(doc_id, ``size``, component_id, kept) for every row of ``signed``; rows with a null id have a null component and are kept."""
    by_class = classes.select("digest", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    joined = signed.select("doc_id", size, "digest").join(by_class, "digest", "left")
    # The id's own component: its texts' components are one.
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", size, component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
