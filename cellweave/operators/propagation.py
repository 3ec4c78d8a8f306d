"""Forward passes with fixed or given weights: message passing as joins and partial aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import connectivity as C
from cellweave.operators import graph as G
from cellweave.operators import liftings as S
from cellweave.operators import pairs as P
from cellweave.operators import blocks as K
from cellweave.operators import linalg as L


def normalised_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 as (g, row, col, val)."""
    d = G.degrees(nodes, edges).select("g", "v", (F.col("degree") + 1).alias("d"))
    both = G.to_undirected(edges).union(nodes.select("g", F.col("v").alias("src"), F.col("v").alias("dst")))
    e = both.join(d.select("g", F.col("v").alias("src"), F.col("d").alias("a")), ["g", "src"]).join(d.select("g", F.col("v").alias("dst"), F.col("d").alias("b")), ["g", "dst"])
    return e.select("g", F.col("src").alias("row"), F.col("dst").alias("col"), (1 / F.sqrt(F.col("a") * F.col("b"))).alias("val"))


def propagate(operator: DataFrame, x: DataFrame, times: int = 1) -> DataFrame:
    """Simplified graph convolution: the operator applied ``times`` times to scalar features (g, id, x)."""
    for _ in range(times):
        x = L.spmv(operator, x)
    return x


def hypergraph_mean_pass(incidence: DataFrame, x: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Mean over each hyperedge's members, mean back over each node's hyperedges, mixed with the input: (g, id, x)."""
    he = incidence.join(x.select("g", F.col("id").alias("v"), "x"), ["g", "v"]).groupBy("g", "he").agg(F.avg("x").alias("m"))
    back = incidence.join(he, ["g", "he"]).groupBy("g", F.col("v").alias("id")).agg(F.avg("m").alias("m"))
    return x.join(back, ["g", "id"], "left").select("g", "id", ((1 - alpha) * F.coalesce("m", F.lit(0.0)) + alpha * F.col("x")).alias("x"))


def signal_down(incidences: list[DataFrame], x: DataFrame) -> DataFrame:
    """From the highest rank down to vertices: x_{r-1} = |B_r| x_r for B_R ... B_1."""
    for b in incidences:
        x = L.spmv(L.absolute(b), x)
    return x


def signal_down_simplices(cells: DataFrame, rank: int) -> DataFrame:
    """:func:`signal_down` of ``cells(g, rank, verts, x)`` from rank ``rank`` of a simplicial complex: a cell reaches each of its vertices along rank! chains of faces."""
    top = cells.where(F.col("rank") == rank).select("g", F.explode("verts").alias("id"), "x")
    return top.groupBy("g", "id").agg((F.sum("x") * math.factorial(rank)).alias("x"))


def routed_messages(operators: dict[str, DataFrame], features: dict[int, DataFrame], routes: dict[str, tuple[int, int]], activation: str = "relu") -> dict[int, DataFrame]:
    """One layer of neighbourhood messages: sums over the routes into each rank; untouched ranks pass through."""
    act = {"relu": lambda c: F.greatest(c, F.lit(0.0)), "id": lambda c: c, "tanh": F.tanh, "sigmoid": lambda c: 1 / (1 + F.exp(-c)), "elu": lambda c: F.when(c > 0, c).otherwise(F.expm1(c))}[activation]
    got: dict[int, DataFrame] = {}
    for name, (src, dst) in routes.items():
        message = L.spmv(operators[name], features[src])
        got[dst] = got[dst].unionByName(message) if dst in got else message
    return features | {r: m.groupBy("g", "id").agg(act(F.sum("x")).alias("x")) for r, m in got.items()}


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A linear layer on an array column."""
    rows = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(float(c)), lambda s, e: s + e) for w, c in zip(weights, bias, strict=True)]
    return F.array(*rows)


def graph_mlp_loss(similarity: DataFrame, power: DataFrame, tau: float = 1.0) -> DataFrame:
    """Mean of -log(sum_j e^(tau s_ij) A^r_ij / sum_j e^(tau s_ij) + 1e-8) over rows, self-loops left out."""
    s = similarity.where("a <> b").withColumn("e", F.exp(tau * F.col("s")))
    both = s.join(power.select("g", F.col("row").alias("a"), F.col("col").alias("b"), "val"), ["g", "a", "b"], "left")
    per = both.groupBy("g", "a").agg((F.sum(F.col("e") * F.coalesce("val", F.lit(0.0))) / F.sum("e")).alias("share"))
    return per.agg(F.avg(-F.log(F.col("share") + 1e-8)).alias("loss"))


def normalised_laplacian(laplacian: DataFrame) -> DataFrame:
    """D^-1/2 |L| D^-1/2 with the row sums of |L| in D."""
    a = L.absolute(laplacian)
    d = L.row_sums(a)
    both = a.join(d.select("g", F.col("id").alias("row"), F.col("x").alias("p")), ["g", "row"]).join(d.select("g", F.col("id").alias("col"), F.col("x").alias("q")), ["g", "col"])
    return both.select("g", "row", "col", (F.col("val") / F.sqrt(F.col("p") * F.col("q"))).alias("val"))


def graph_norm(rows: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Array features ``rows(g, id, x)`` less their graph's mean, over its population deviation, by position."""
    flat = rows.select("g", "id", F.posexplode("x").alias("p", "e"))
    stats = flat.groupBy("g", "p").agg(F.avg("e").alias("m"), F.var_pop("e").alias("s"))
    done = flat.join(stats, ["g", "p"]).select("g", "id", "p", ((F.col("e") - F.col("m")) / F.sqrt(F.col("s") + eps)).alias("e"))
    return done.groupBy("g", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "e"))), lambda s: s["e"]).alias("x"))


def encode(rows: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """A cell encoder: graph norm, linear layer, ReLU."""
    return graph_norm(rows).withColumn("x", F.transform(dense(F.col("x"), weights, bias), lambda e: F.greatest(e, F.lit(0.0))))


def flatten_graphs(rows: DataFrame) -> DataFrame:
    """(g, x): all array features of a graph's nodes side by side, by id."""
    return rows.groupBy("g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda s: s["x"])).alias("x"))


def edge_cell_layer(x: DataFrame, down: DataFrame, up: DataFrame, own: float = 1.0, below: float = 1.0, above: float = 1.0) -> DataFrame:
    """relu(own x + below A_down x + above A_up x) for scalar edge features (g, id, x)."""
    parts = x.select("g", "id", (own * F.col("x")).alias("x"))
    for w, operator in ((below, down), (above, up)):
        parts = parts.unionByName(L.spmv(operator, x).select("g", "id", (w * F.col("x")).alias("x")))
    return parts.groupBy("g", "id").agg(F.greatest(F.sum("x"), F.lit(0.0)).alias("x"))


def hasse_graph(cells: DataFrame, neighbourhoods: list[str]) -> DataFrame:
    """One graph (g, src, dst) over the cells of all ranks, named "rank:cell", with an arc per entry of every neighbourhood."""
    out = None
    for text in neighbourhoods:
        low, high = C.route(text)
        m = C.neighbourhood(cells, text)
        part = m.select("g", F.concat(F.lit(f"{low}:"), F.col("col").cast("string")).alias("src"), F.concat(F.lit(f"{high}:"), F.col("row").cast("string")).alias("dst"))
        out = part if out is None else out.union(part)
    return out.distinct()


def sampled_edges(points: DataFrame, k: int = 5, temperature: float = 4.0, seed: int = 0, metric: str = "euclidean") -> DataFrame:
    """(g, a, b, logprob): Gumbel top-k over squared distances times exp(temperature), drawn by hash; dense per graph, as all pairs are scored."""
    logit = F.col("d") * F.col("d") * float(math.exp(max(-5.0, min(5.0, temperature))))
    noise = F.pmod(F.xxhash64(F.lit(seed), "g", "a", "b"), F.lit(1 << 30)) / float(1 << 30) + 1e-8
    if metric == "euclidean" and K.integral(points, "g") and points.schema["v"].dataType.simpleString() == "bigint":
        # xxhash64 of several columns goes on from the hash of those before: that of b is taken in the task.
        start = points.withColumn("h", F.xxhash64(F.lit(seed), "g", "v"))
        scale = float(math.exp(max(-5.0, min(5.0, temperature))))
        found = P.by_pairs(start, lambda a, x, b, y, h: P.sampled(a, x, b, y, h, k, scale), "a long, b long, logit double, s double", extra="h")
        order = Window.partitionBy("g", "a").orderBy("s", "b")
        return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("g", "a", "b", (-F.col("logit")).alias("logprob"))
    scored = S.pair_distances(points, metric).select("g", "a", "b", logit.alias("logit"), (logit - F.log(-F.log(noise))).alias("s"))
    order = Window.partitionBy("g", "a").orderBy("s", "b")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("g", "a", "b", (-F.col("logit")).alias("logprob"))


def sampling_loss(edges: DataFrame, correct: DataFrame, average: float = 0.5, weight: float = 0.5) -> DataFrame:
    """The mean over nodes of (average - correct) times the mean probability of a node's sampled edges; ``correct(g, v, correct)``."""
    per = edges.groupBy("g", F.col("a").alias("v")).agg(F.avg(F.exp("logprob")).alias("p"))
    return per.join(correct, ["g", "v"]).agg((weight * F.avg((average - F.col("correct").cast("double")) * F.col("p"))).alias("loss"))
