"""Positional and structural encodings, curvature and homophily."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import blocks as K
from cellweave.operators import connectivity as C
from cellweave.operators import graph as G
from cellweave.operators import linalg as L


def random_walk(edges: DataFrame, steps: int, lists: DataFrame | None = None) -> DataFrame:
    """(g, k, v, p): return probabilities after 2 .. ``steps`` steps of the uniform walk, where positive; up to three steps inside blocks of vertices, from packed ``lists`` where those are given."""
    if steps <= 3 and (lists is not None or K.integral(edges, "g", "u", "v")):
        return K.returns(K.lists_of_edges(edges) if lists is None else lists, steps)
    both = G.to_undirected(edges)
    d = both.groupBy("g", "src").agg(F.count(F.lit(1)).alias("d"))
    step = both.join(d, ["g", "src"]).select("g", F.col("src").alias("row"), F.col("dst").alias("col"), (1 / F.col("d")).alias("val"))
    at, out = step, None
    for k in range(2, steps + 1):
        at = L.spmm(at, step)
        here = at.where("row = col").select("g", F.lit(k).alias("k"), F.col("row").alias("v"), F.col("val").alias("p"))
        out = here if out is None else out.union(here)
    return out


def laplacian_pe(nodes: DataFrame, edges: DataFrame, k: int = 10, include_first: bool = False) -> DataFrame:
    """(g, v, pe): the eigenvectors of the least eigenvalues of the normalised Laplacian, dense per graph.

    The entry of greatest size is positive in each vector; eigenvalues up to 1e-6 are left out unless
    ``include_first``; short graphs are padded with zeros.
    """
    import numpy as np
    import pandas as pd

    def lift(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(left["v"].unique())
        n = len(ids)
        pe = np.zeros((n, k))
        if n > 1 and len(right):
            a = np.zeros((n, n))
            i, j = np.searchsorted(ids, right["u"]), np.searchsorted(ids, right["v"])
            a[i, j] = a[j, i] = 1
            d = a.sum(1)
            s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1)), 0)
            w, q = np.linalg.eigh(np.diag((d > 0).astype(float)) - a * s[:, None] * s[None, :])
            w, q = w[: min(k, max(1, n - 1))], q[:, : min(k, max(1, n - 1))]
            if not include_first:
                q = q[:, w > 1e-6]
            top = np.abs(q).argmax(axis=0)
            pe[:, : q.shape[1]] = q * np.sign(q[top, np.arange(q.shape[1])])
        return pd.DataFrame({"g": key[0] if key else 0, "v": ids, "pe": pe.tolist()})

    return nodes.groupBy("g").cogroup(edges.groupBy("g")).applyInPandas(lift, "g long, v long, pe array<double>")


def curvature(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(g, id, x) for vertices, edges and triangles of a simplicial complex.

    c1 = 4 - |B1|^T deg0 + 3 deg1; c0 = |B1| c1; c2 = 3 + deg2 - the off-diagonal row sums of
    |B2|^T |B2| - |B3| |B3|^T.
    """
    b1, b2, b3 = (C.incidence(cells, r, signed=False) for r in (1, 2, 3))
    deg0, deg1, deg2 = (L.row_sums(b) for b in (b1, b2, b3))
    edges = cells.where("rank = 1").select("g", C.name("verts").alias("id"))
    near = L.spmv(L.transpose(b1), deg0)
    c1 = edges.join(near.withColumnRenamed("x", "a"), ["g", "id"], "left").join(deg1.withColumnRenamed("x", "b"), ["g", "id"], "left")
    c1 = c1.select("g", "id", (4 - F.coalesce("a", F.lit(0)) + 3 * F.coalesce("b", F.lit(0))).alias("x"))
    c0 = L.spmv(b1, c1)
    down = L.spmm(L.transpose(b2), b2)
    up = L.spmm(b3, L.transpose(b3)).withColumn("val", -F.col("val"))
    off = L.row_sums(L.off_diagonal(L.add(down, up)))
    faces = cells.where("rank = 2").select("g", C.name("verts").alias("id"))
    c2 = faces.join(deg2.withColumnRenamed("x", "a"), ["g", "id"], "left").join(off.withColumnRenamed("x", "b"), ["g", "id"], "left")
    return c0, c1, c2.select("g", "id", (3 + F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("x"))


def group_degrees(incidence: DataFrame, labels: DataFrame, top_k: int = 10) -> DataFrame:
    """(k, v, y, t, d): for the ``top_k`` commonest cardinalities k > 1, the number of hyperedges of v of that size in which t members share v's class."""
    members = incidence.join(labels, ["g", "v"])
    size = incidence.groupBy("g", "he").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    common = size.groupBy("k").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "k").limit(top_k)
    share = members.groupBy("g", "he", "y").agg(F.count(F.lit(1)).alias("t"))
    return members.join(size.join(F.broadcast(common.select("k")), "k"), ["g", "he"]).join(share, ["g", "he", "y"]).groupBy("k", "v", "y", "t").agg(F.count(F.lit(1)).alias("d"))  # top_k rows


def group_affinity(degrees: DataFrame) -> DataFrame:
    """(k, y, t, dt): class totals of the degrees as shares over t."""
    total = degrees.groupBy("k", "y", "t").agg(F.sum("d").alias("n"))
    return total.select("k", "y", "t", (F.col("n") / F.sum("n").over(Window.partitionBy("k", "y"))).alias("dt"))


def group_baseline(labels: DataFrame, sizes: list[int]) -> DataFrame:
    """(k, y, t, bt): C(n_c - 1, t - 1) C(n - n_c, k - t) / C(n - 1, k - 1), as products of ratios."""
    counts = labels.groupBy("y").agg(F.count(F.lit(1)).alias("nc")).withColumn("n", F.sum("nc").over(Window.partitionBy()))
    rows = counts.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("k"))))
    choose = lambda n, k: f"if({k} < 0 or {k} > {n}, 0D, aggregate(sequence(1, greatest({k}, 1)), 1D, (a, i) -> if({k} = 0, a, a * ({n} - {k} + i) / i)))"
    return rows.select("k", "y", "t", F.expr(f"{choose('(nc - 1)', '(t - 1)')} * {choose('(n - nc)', '(k - t)')} / {choose('(n - 1)', '(k - 1)')}").alias("bt"))


def affinity_ratios(dt: DataFrame, bt: DataFrame) -> DataFrame:
    """Affinity over baseline, and the bias normalised to [-1, 1]."""
    both = dt.join(bt, ["k", "y", "t"])
    bias = F.when(F.col("dt") >= F.col("bt"), (F.col("dt") - F.col("bt")) / (1 - F.col("bt"))).otherwise((F.col("dt") - F.col("bt")) / F.col("bt"))
    return both.select("k", "y", "t", (F.col("dt") / F.col("bt")).alias("ratio"), bias.alias("bias"))


def message_passing_homophily(incidence: DataFrame, labels: DataFrame, steps: int) -> DataFrame:
    """(step, he, y, p): class shares of hyperedges, each step averaged over nodes and back."""
    members = incidence.join(labels, ["g", "v"])
    size = incidence.groupBy("g", "he").agg(F.count(F.lit(1)).alias("n"))
    degree = incidence.groupBy("g", "v").agg(F.count(F.lit(1)).alias("m"))
    shares = members.groupBy("g", "he", "y").agg(F.count(F.lit(1)).alias("c")).join(size, ["g", "he"]).select("g", "he", "y", (F.col("c") / F.col("n")).alias("p"))
    out = shares.withColumn("step", F.lit(0))
    for s in range(1, steps + 1):
        # Shares of zero are absent rows, so means divide sums by the full counts.
        nodes = incidence.join(shares, ["g", "he"]).groupBy("g", "v", "y").agg(F.sum("p").alias("p")).join(degree, ["g", "v"]).select("g", "v", "y", (F.col("p") / F.col("m")).alias("p"))
        shares = incidence.join(nodes, ["g", "v"]).groupBy("g", "he", "y").agg(F.sum("p").alias("p")).join(size, ["g", "he"]).select("g", "he", "y", (F.col("p") / F.col("n")).alias("p"))
        out = out.unionByName(shares.withColumn("step", F.lit(s)))
    return out.select("step", "he", "y", "p")


def class_homophily(incidence: DataFrame, labels: DataFrame, shares: DataFrame) -> DataFrame:
    """(step, y, p): mean over a class's nodes of the mean share of their own class in their hyperedges; nodes of one hyperedge are left out.

    ``shares(step, he, y, p)`` come from :func:`message_passing_homophily`, of one hypergraph.
    """
    degree = incidence.groupBy("g", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mine = incidence.join(degree, ["g", "v"]).join(labels, ["g", "v"])
    steps = shares.select("step").distinct()
    # Absent shares count as zero: sums are divided by the full number of hyperedges.
    per = mine.join(shares, ["he", "y"]).groupBy("step", "g", "v").agg(F.sum("p").alias("s"))
    every = degree.join(labels, ["g", "v"]).crossJoin(steps)  # a row per step
    return every.join(per, ["step", "g", "v"], "left").groupBy("step", "y").agg(F.avg(F.coalesce("s", F.lit(0.0)) / F.col("m")).alias("p"))


def combined_encodings(nodes: DataFrame, edges: DataFrame, kinds: list[str], k: int = 10, steps: int = 10) -> DataFrame:
    """(g, v, x): the named encodings ("LapPE", "RWSE") side by side in the order given."""
    if not kinds or set(kinds) - {"LapPE", "RWSE"}:
        raise ValueError(f"unknown encodings {kinds!r}")
    out, columns = nodes.select("g", "v"), []
    for i, kind in enumerate(kinds):
        if kind == "LapPE":
            part = laplacian_pe(nodes, edges, k).withColumnRenamed("pe", f"e{i}")
        else:
            found = random_walk(edges, steps).groupBy("g", "v").agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("m"))
            part = found.select("g", "v", F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0.0))).alias(f"e{i}"))
        width = k if kind == "LapPE" else steps
        out = out.join(part, ["g", "v"], "left")
        columns.append(F.coalesce(f"e{i}", F.array_repeat(F.lit(0.0), width)))
    return out.select("g", "v", F.concat(*columns).alias("x"))
