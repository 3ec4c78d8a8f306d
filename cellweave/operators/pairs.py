"""All pairs of a point cloud, block by block: matrix products rank the pairs, those that may count are computed exactly.

The product of two blocks gives squared distances up to rounding. Pairs within that margin of what is
asked for are computed again from the differences, summed in order; so no pair is lost and distances
are those of the plain formula.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the left block at a time, and the relative margin of squared distances from products (64-bit floats, up to thousands of dimensions).
STEP, MARGIN = 256, 1e-11


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in order."""
    out = np.empty(len(x))
    for lo in range(0, len(x), 1 << 14):
        d = x[lo : lo + (1 << 14)] - y[lo : lo + (1 << 14)]
        out[lo : lo + (1 << 14)] = np.cumsum(d * d, axis=1)[:, -1] if d.shape[1] else 0.0
    return out


def rough(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by product, and the margin of each row of x."""
    with np.errstate(all="ignore"):
        sx, sy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        d = sx[:, None] + sy[None, :] - 2 * (x @ y.T)
        return d, MARGIN * (sx + (sy.max() if len(sy) else 0.0))


def nearest(x: np.ndarray, y: np.ndarray, k: int, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d): the k nearest rows j of y for each row i of x, ties by j; ``leave`` marks pairs that do not count."""
    d, margin = rough(x, y)
    if leave is not None:
        d[leave] = np.inf
    with np.errstate(all="ignore"):
        # What products cannot tell is computed.
        kth = np.partition(np.where(np.isnan(d), np.inf, d), k - 1, axis=1)[:, k - 1 : k]
        may = ~(d > kth + 2 * margin[:, None])
    if leave is not None:
        may &= ~leave
    i, j = np.nonzero(may)
    with np.errstate(all="ignore"):
        e = np.sqrt(exact(x[i], y[j]))
    e[np.isnan(e)] = np.inf
    order = np.lexsort((j, e, i))
    i, j, e = i[order], j[order], e[order]
    first = np.searchsorted(i, i, side="left")
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept], e[kept]


def within(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, radius: float) -> list[np.ndarray]:
    """(a, b, d) of pairs of different points within ``radius``."""
    d, margin = rough(x, y)
    with np.errstate(all="ignore"):
        i, j = np.nonzero(~(d > radius * radius + margin[:, None] + MARGIN * radius * radius))
        other = a[i] != b[j]
        i, j = i[other], j[other]
        e = np.sqrt(exact(x[i], y[j]))
    kept = e <= radius
    return [a[i[kept]], b[j[kept]], e[kept]]


def _ball(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points shrunk into the open unit ball, and their squared lengths."""
    length = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])
    x = x / (np.maximum(length, 1.0) * 1.01)
    return x, np.cumsum(x * x, axis=1)[:, -1]


def hyperbolic(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """(v, least, most): hyperbolic distances of points of the left block to others of the right one."""
    (x, sx), (y, sy) = _ball(x), _ball(y)
    d, _ = rough(x, y)
    scale = (1 - sx)[:, None] * (1 - sy)[None, :]
    ratio = d / scale
    own = a[:, None] == b[None, :]
    # Lengths are below 1: the margin of a squared distance is MARGIN, that of its ratio at most this.
    margin = 4 * MARGIN / ((1 - sx) * (1 - sy).min())
    out = []
    for low in (True, False):
        r = np.where(own, np.inf if low else -np.inf, ratio)
        best = r.min(axis=1) if low else r.max(axis=1)
        may = (r <= (best + margin)[:, None] if low else r >= (best - margin)[:, None]) & ~own
        i, j = np.nonzero(may)
        e = np.arccosh(1e-6 + 1 + 2 * exact(x[i], y[j]) / scale[i, j])
        most = np.full(len(x), np.inf if low else -np.inf)
        (np.minimum if low else np.maximum).at(most, i, e)
        out.append(most)
    kept = np.isfinite(out[0])
    return [a[kept], out[0][kept], out[1][kept]]


def _hash_long(v: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """xxhash64 of 64-bit integers as Spark has it, by seed."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (seed.view("u8") + p5 + np.uint64(8))[:, None] ^ (turn(v.view("u8") * p2, 31) * p1)[None, :]
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def sampled(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, h: np.ndarray, k: int, scale: float) -> list[np.ndarray]:
    """(a, b, logit, s): for each point of the left block the k least s of the right one, squared distances times ``scale`` less Gumbel noise."""
    noise = (_hash_long(np.ascontiguousarray(b), np.ascontiguousarray(h)) & np.uint64((1 << 30) - 1)).astype("f8") / float(1 << 30) + 1e-8
    gumbel = np.log(-np.log(noise))
    d, margin = rough(x, y)
    s = d * scale - gumbel
    kth = np.partition(s, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
    i, j = np.nonzero(s <= (kth + 2 * margin * scale + 1e-12)[:, None])
    e = np.sqrt(exact(x[i], y[j]))
    logit = e * e * scale
    return [a[i], b[j], logit, logit - gumbel[i, j]]


def by_pairs(points: DataFrame, work: Callable, schema: str, extra: str | None = None, n: int = 8) -> DataFrame:
    """``work(a, x, b, y[, extra of a])`` on steps of every pair of blocks of ``points(g, v, x)`` of a graph; points without x count nowhere. The result is ``schema`` after g."""
    names = ["g", *(c.split()[0] for c in schema.split(", "))]

    def pair(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({c: [] for c in names})]
        if len(left) and len(right):
            right = right.sort_values("w", ignore_index=True)
            x, y = np.array(left["x"].tolist(), dtype=float), np.array(right["y"].tolist(), dtype=float)
            a, b = left["v"].to_numpy(), right["w"].to_numpy()
            for lo in range(0, len(x), STEP):
                at = slice(lo, lo + STEP)
                more = [left["e"].to_numpy()[at]] if extra else []
                parts.append(pd.DataFrame(dict(zip(names, [key[0], *work(a[at], x[at], b, y, *more)], strict=True))))
        return pd.concat([p for p in parts if len(p)] or parts)

    # Points are dealt into blocks; a block meets each block in a task of its own.
    e = [F.col(extra).alias("e")] if extra else []
    deal = points.where("x IS NOT NULL").select(F.col("g").cast("long").alias("g"), F.col("v").cast("long").alias("v"), F.col("x").cast("array<double>").alias("x"), F.pmod(F.xxhash64("v"), F.lit(n)).cast("int").alias("block"), *e)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = deal.withColumn("other", every)
    right = deal.withColumnRenamed("block", "other").withColumn("block", every).select("g", "block", "other", F.col("v").alias("w"), F.col("x").alias("y"))
    keys = ["g", "block", "other"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(pair, f"g long, {schema}")
