"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Unit vectors with a cosine of at least ``cosine`` lie within ``d = sqrt(2 - 2 cosine)``. Vectors are
dealt into ``tables`` of coarse cells (``width`` wide in ``coarse`` random projections), which bound the
length of what is sorted. Each cell is sorted along ``sorted_lines`` of ``lines`` one-dimensional
projections in turn; on each, the window within ``reach`` of every vector is scanned, and a pair that
collides there is counted over all lines, once, at the first sorted line on which it collides. Pairs that reach a
least count are verified by cosine in double precision. The lines are the same in every table, so no
table makes up for a pair that they miss: a pair at distance ``d`` that collides on no sorted line, or on
fewer lines than the least count, has a probability of at most ``miss``. Beside that, such a pair
shares no cell in any table with a probability of 1.8e-4 at the values below; both fall fast with the
distance. A pair is taken by the first table in which
it shares a cell, so links are counted once and pairs never leave their task: a task returns each
vector's link count and a spanning forest of its links.

Cells of more than ``split`` rows are cut into blocks, and each pair of blocks is a group of its own.
Equal vectors are one class with a multiplicity. Vectors of different lengths never link; each length
has its own projections and its own cells. Null or zero vectors and those with null or non-finite
components link with nothing. Rows with a null ``vec_id`` come back
unlinked; repeated ids count as several vectors under one id.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.components import connected_components
from cellweave.llm.shingles import mix
from cellweave.storage import materialise

COSINE = 0.95
TABLES, COARSE, WIDTH, LINES, SORTED, MISS, SPLIT = 48, 8, 1.25, 16, 4, 2e-4, 4096


def _within(distance: float, reach: float) -> float:
    """P(|N(0, distance^2)| <= reach)."""
    return math.erf(reach / distance / math.sqrt(2))


def calibrate(distance: float, lines: int, sorted_lines: int, miss: float) -> tuple[float, int]:
    """The reach of a collision and the least count: a pair at ``distance`` collides on no sorted line or on fewer lines with a probability of at most ``miss``."""
    reach = 2 * distance
    p = _within(distance, reach)
    total = (1 - p) ** sorted_lines
    for k in range(lines + 1):
        total += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if total > miss:
            return reach, k
    return reach, lines


def cell_share(distance: float, width: float = WIDTH, coarse: int = COARSE) -> float:
    """The probability that a pair at ``distance`` shares the cell of one table."""
    r = width / distance
    return (1 - math.erfc(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))) ** coarse


@functools.lru_cache(maxsize=4)
def _projections(dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(104729)
    return rng.standard_normal((dimension, TABLES * COARSE)), rng.uniform(0, WIDTH, TABLES * COARSE), rng.standard_normal((dimension, LINES))


def _cells(unit: np.ndarray, coarse: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Cell codes (vectors x tables)."""
    q = np.floor((unit @ coarse + shift) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(unit), TABLES, COARSE)
    code = np.full((len(unit), TABLES), 17, dtype=np.uint64) + np.arange(TABLES, dtype=np.uint64)
    for k in range(COARSE):
        code = mix(code * np.uint64(0xD6E8FEB86659FD93) + q[:, :, k])
    return code


def _links(keys: np.ndarray, block: np.ndarray, unit: np.ndarray, tables: np.ndarray, coarse, shift, lines, reach: float, least: int, cosine: float):
    """(i, j) positions of linked pairs: rows of one key, of one block or of two."""
    projected = unit @ lines
    found = []
    for line in range(SORTED):
        position = np.lexsort((projected[:, line], keys))
        key, along, side = keys[position], projected[position], block[position]
        n, active = len(key), np.arange(len(key))
        # A key's blocks are 0 (one block against itself) or 1 and 2 (one against the other).
        step = 0
        while len(active):
            step += 1
            active = active[active + step < n]
            other = active + step
            active = active[(key[active] == key[other]) & (along[other, line] - along[active, line] <= reach)]
            if not len(active):
                break
            i, j = active, active + step
            mixed = (side[i] == 0) | (side[i] != side[j])
            i, j = i[mixed], j[mixed]
            if not len(i):
                continue
            met = np.abs(along[i] - along[j]) <= reach
            # A pair that met on an earlier sorted line is counted there.
            new = (met.sum(axis=1) >= least) & ~met[:, :line].any(axis=1)
            i, j = position[i[new]], position[j[new]]
            if not len(i):
                continue
            close = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            if close.any():
                found.append((i[close], j[close]))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    code = np.concatenate([_cells(unit[rows[k : k + 4096]], coarse, shift) for k in range(0, len(rows), 4096)])
    first = np.empty(len(i), dtype=np.int64)
    for k in range(0, len(i), 65536):
        same = code[back[: len(i)][k : k + 65536]] == code[back[len(i) :][k : k + 65536]]
        first[k : k + 65536] = same.argmax(axis=1)
    own = first == tables[i]
    return i[own], j[own]


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    classes = rows.where(sound & F.col("vec_id").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    distance = math.sqrt(2 - 2 * cosine)
    reach, least = calibrate(distance, LINES, SORTED, MISS)

    def by_length(table, column: str) -> Iterator[tuple]:
        """(length, rows of that length); the rows keep their order."""
        sizes = pc.list_value_length(table.column(column)).to_numpy()
        for n in np.unique(sizes).tolist():
            yield n, table.filter(pa.array(sizes == n))

    def normal(column: pa.Array, dimension: int) -> np.ndarray:
        x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dimension)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dimension, rows_of in by_length(batch, "v"):
                coarse, shift, _ = _projections(dimension)
                for lo in range(0, rows_of.num_rows, 1024):
                    part = rows_of.slice(lo, 1024)
                    code = mix(_cells(normal(part.column("v"), dimension), coarse, shift) + np.uint64(dimension)).view(np.int64)
                    n = len(code)
                    take = pa.array(np.repeat(np.arange(n), TABLES))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)), pa.array(code.ravel()), part.column("rep").take(take)], names=["t", "cell", "rep"])

    dealt = materialise(classes, "vector-classes")
    cells = materialise(dealt.select("rep", "v").mapInArrow(deal, "t int, cell long, rep long"), "cells")
    counts = cells.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # Rows that are alone in their cell are done; blocks of large cells meet in pairs.
    shared = cells.join(counts, ["t", "cell"]).withColumn("blocks", F.ceil(F.col("m") / SPLIT).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("b")).alias("lo"), F.greatest(k, F.col("b")).alias("hi"))))
    shared = shared.withColumn("g", F.explode(met)).select("t", "rep", F.xxhash64("t", "cell", "g.lo", "g.hi").alias("key"), F.when(F.col("g.lo") == F.col("g.hi"), 0).when(F.col("b") == F.col("g.lo"), 1).otherwise(2).alias("block"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = shared.join(dealt, "rep").select("key", "t", "block", "rep", "copies", F.col("v").cast("array<float>").alias("f"), F.when(F.col("v") != F.col("v").cast("array<float>").cast("array<double>"), F.col("v")).alias("exact"))
    grouped = grouped.repartition(n_parts, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        links: dict[int, int] = {}
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.get(x, x)) != x:
                root[x] = root.get(p, p)
                x = p
            return x

        def settle(table: pa.Table) -> None:
            for dimension, part in by_length(table, "f"):
                if part.num_rows > 1:
                    settle_length(part, dimension)

        def settle_length(table: pa.Table, dimension: int) -> None:
            f, exact = table.column("f").combine_chunks(), table.column("exact").combine_chunks()
            x = np.asarray(f.flatten(), dtype=np.float64).reshape(-1, dimension)
            if exact.null_count < len(exact):
                where = np.flatnonzero(~np.asarray(exact.is_null()))
                x[where] = np.asarray(exact.drop_null().flatten(), dtype=np.float64).reshape(-1, dimension)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            key, t, block, rep, copies = (table.column(c).to_numpy() for c in ("key", "t", "block", "rep", "copies"))
            i, j = _links(key, block, unit, t, *_projections(dimension), reach, least, cosine)
            if not len(i):
                return
            ends, of = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
            for d, c in zip(ends.tolist(), np.bincount(of, weights=np.concatenate([copies[j], copies[i]])).astype(np.int64).tolist(), strict=True):
                links[d] = links.get(d, 0) + c
            for a, b in np.unique(np.stack([rep[i], rep[j]], axis=1), axis=0).tolist():
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 40_000:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            settle(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            settle(pa.Table.from_batches(held))
        ids = list(links)
        for k in range(0, len(ids), 10_000):
            part = ids[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (part, [links[d] for d in part], [find(d) for d in part])], names=["rep", "n", "root"])

    part = materialise(grouped.mapInArrow(run, "rep long, n long, root long"), "vector-links")
    found = connected_components(part.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = part.groupBy("rep").agg(F.sum("n").alias("n"))
    done = dealt.select("v", "rep", "copies").join(linked, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    done = done.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    joined = rows.withColumn("v", F.when(sound & F.col("vec_id").isNotNull(), F.col("v"))).join(done, "v", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
