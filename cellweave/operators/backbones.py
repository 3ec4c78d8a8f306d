"""Forward passes of graph, hypergraph, sheaf and simplicial layers with given weights.

Messages are joins with partial aggregates, so a hub's messages are summed before they are shuffled.
Features are arrays ``(g, id, x)`` unless a docstring says scalar; arcs are ``(g, src, dst)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import linalg as L


def dot(x: Column, weights: list[float]) -> Column:
    """The product of an array column with fixed weights."""
    return F.aggregate(F.zip_with(x, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def _by_position(rows: DataFrame, keys: list[str], value: Column, how) -> DataFrame:
    """Arrays aggregated by position: (keys, x)."""
    flat = rows.select(*keys, F.posexplode(value).alias("p", "e"))
    per = flat.groupBy(*keys, "p").agg(how("e").alias("e"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "e"))), lambda s: s["e"]).alias("x"))


def neighbour_pass(arcs: DataFrame, x: DataFrame, how: str = "mean", own: float = 1.0) -> DataFrame:
    """own * x plus the sum, mean or maximum of the sources' features; nodes without arcs keep own * x.

    ``how="sum"`` with own = 1 + eps is an isomorphism layer, ``how="mean"`` a sample-and-aggregate layer.
    """
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    sent = arcs.join(x.select("g", F.col("id").alias("src"), F.col("x").alias("m")), ["g", "src"])
    got = _by_position(sent.select("g", F.col("dst").alias("id"), "m"), ["g", "id"], F.col("m"), agg).withColumnRenamed("x", "m")
    mixed = F.zip_with("x", F.coalesce("m", F.transform("x", lambda e: e * 0.0)), lambda a, b: own * a + b)
    return x.join(got, ["g", "id"], "left").select("g", "id", mixed.alias("x"))


def _softmax_sum(sent: DataFrame) -> DataFrame:
    """(g, id, x): features m of ``sent(g, dst, m, s)`` weighed by the softmax of the scores s over each target.

    The greatest score of each target goes first, so that no exponential overflows; sums then need
    no sorting and no list of neighbours. The weight itself travels as the last position of the array.
    """
    top = sent.groupBy("g", "dst").agg(F.max("s").alias("top"))
    weighed = sent.join(top, ["g", "dst"]).select("g", F.col("dst").alias("id"), F.exp(F.col("s") - F.col("top")).alias("w"), "m")
    summed = _by_position(weighed, ["g", "id"], F.concat(F.transform("m", lambda e: e * F.col("w")), F.array("w")), F.sum)
    return summed.select("g", "id", F.transform(F.slice("x", F.lit(1), F.size("x") - 1), lambda e: e / F.element_at("x", -1)).alias("x"))


def attention_pass(arcs: DataFrame, x: DataFrame, source: list[float], target: list[float], slope: float = 0.2, self_loops: bool = True) -> DataFrame:
    """One attention head: softmax over a node's arcs of LeakyReLU(source . x_src + target . x_dst), applied to x.

    Without self-loops, nodes without arcs give no row.
    """
    if self_loops:
        arcs = arcs.select("g", "src", "dst").where("src <> dst").unionByName(x.select("g", F.col("id").alias("src"), F.col("id").alias("dst")))
    left = x.select("g", F.col("id").alias("src"), F.col("x").alias("m"), dot(F.col("x"), source).alias("p"))
    right = x.select("g", F.col("id").alias("dst"), dot(F.col("x"), target).alias("q"))
    raw = F.col("p") + F.col("q")
    return _softmax_sum(arcs.join(left, ["g", "src"]).join(right, ["g", "dst"]).select("g", "dst", "m", F.when(raw > 0, raw).otherwise(slope * raw).alias("s")))


def hypergraph_attention(incidence: DataFrame, x: DataFrame, source: list[float], slope: float = 0.2) -> DataFrame:
    """Attention of members onto hyperedges, then of hyperedges back onto members: (g, id, x) of nodes with hyperedges.

    Scores depend on the sender alone.
    """

    def step(arcs: DataFrame, values: DataFrame) -> DataFrame:
        score = dot(F.col("x"), source)
        return _softmax_sum(arcs.join(values.select("g", F.col("id").alias("src"), F.col("x").alias("m"), F.when(score > 0, score).otherwise(slope * score).alias("s")), ["g", "src"]))

    onto = step(incidence.select("g", F.col("v").alias("src"), F.col("he").alias("dst")), x)
    return step(incidence.select("g", F.col("he").alias("src"), F.col("v").alias("dst")), onto)


def linear_attention(rows: DataFrame) -> DataFrame:
    """Global attention of all nodes of a graph with the feature map elu + 1 and identity projections.

    phi(x_i) . sum_j phi(x_j) x_j^T / phi(x_i) . sum_j phi(x_j): the sums hold d * d numbers a graph,
    so no pair of nodes is formed. Features may have any sign.
    """
    phi = F.transform("x", lambda e: F.when(e > 0, e + 1).otherwise(F.exp(e)))
    at = rows.select("g", "id", "x", phi.alias("f"))
    outer = at.select("g", F.posexplode("f").alias("a", "fa"), "x").select("g", "a", "fa", F.posexplode(F.concat("x", F.array(F.lit(1.0)))).alias("b", "xb"))
    moments = outer.groupBy("g", "a", "b").agg(F.sum(F.col("fa") * F.col("xb")).alias("m"))
    table = moments.groupBy("g", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "m"))), lambda s: s["m"]).alias("row"))
    table = table.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "row"))), lambda s: s["row"]).alias("rows"))
    product = lambda r: F.aggregate(F.zip_with("f", r, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    mixed = at.join(table, "g").select("g", "id", F.transform("rows", product).alias("y"))
    return mixed.select("g", "id", F.transform(F.slice("y", F.lit(1), F.size("y") - 1), lambda e: e / F.element_at("y", -1)).alias("x"))


def sheaf_laplacian(maps: DataFrame, normalised: bool = True) -> DataFrame:
    """Diagonal sheaf Laplacian (g, stalk, row, col, val) of ``maps(g, u, v, fu, fv)``: restriction maps of every edge's ends.

    On each stalk the diagonal sums the squared maps at a node, the rest is -fu * fv; normalised by
    D^-1/2 on both sides, where D is the diagonal. Rows with a zero diagonal stay zero.
    """
    flat = maps.select("g", "u", "v", F.posexplode(F.arrays_zip("fu", "fv")).alias("stalk", "f")).select("g", "stalk", "u", "v", F.col("f.fu").alias("a"), F.col("f.fv").alias("b"))
    entry = lambda r, c, x: F.struct(F.col(r).alias("row"), F.col(c).alias("col"), x.alias("val"))
    a, b = F.col("a"), F.col("b")
    four = flat.select("g", "stalk", F.explode(F.array(entry("u", "u", a * a), entry("v", "v", b * b), entry("u", "v", -a * b), entry("v", "u", -a * b))).alias("e")).select("g", "stalk", "e.*")
    whole = four.groupBy("g", "stalk", "row", "col").agg(F.sum("val").alias("val"))
    if not normalised:
        return whole
    d = whole.where("row = col").select("g", "stalk", "row", F.when(F.col("val") > 0, 1 / F.sqrt("val")).otherwise(0.0).alias("p"))
    both = whole.join(d, ["g", "stalk", "row"]).join(d.select("g", "stalk", F.col("row").alias("col"), F.col("p").alias("q")), ["g", "stalk", "col"])
    return both.select("g", "stalk", "row", "col", (F.col("val") * F.col("p") * F.col("q")).alias("val"))


def sheaf_diffusion(laplacian: DataFrame, x: DataFrame, steps: int = 1) -> DataFrame:
    """x - L x, ``steps`` times, for scalar features ``x(g, stalk, id, x)``."""
    for _ in range(steps):
        y = laplacian.join(x.select("g", "stalk", F.col("id").alias("col"), "x"), ["g", "stalk", "col"])
        y = y.select("g", "stalk", F.col("row").alias("id"), (-F.col("val") * F.col("x")).alias("x"))
        x = x.select("g", "stalk", "id", "x").unionByName(y).groupBy("g", "stalk", "id").agg(F.sum("x").alias("x"))
    return x


def polynomial(operator: DataFrame, x: DataFrame, coefficients: list[float]) -> DataFrame:
    """sum_k coefficients[k] * operator^k x for scalar features (g, id, x)."""
    out, y = None, x
    for k, c in enumerate(coefficients):
        y = L.spmv(operator, y) if k else y
        part = y.select("g", "id", (float(c) * F.col("x")).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("g", "id").agg(F.sum("x").alias("x"))


def simplicial_layer(x: dict[int, DataFrame], incidences: dict[int, DataFrame], down: dict[int, DataFrame], up: dict[int, DataFrame], coefficients: list[float]) -> dict[int, DataFrame]:
    """Convolution over ranks: polynomials of both Laplacians on a rank's own features and on those of its faces and cofaces.

    ``incidences[r]`` maps rank r to r - 1; a rank's result is the sum of its own polynomials, of
    the down ones on B_r^T x_{r-1} and of the up ones on B_{r+1} x_{r+1}, all scalar.
    """
    out = {}
    for r, own in x.items():
        parts = [own.select("g", "id", (float(coefficients[0]) * F.col("x")).alias("x"))]
        tail = [0.0, *coefficients[1:]]
        parts += [polynomial(m[r], own, tail) for m in (down, up) if r in m]
        if r in incidences and r - 1 in x:
            projected = L.spmv(L.transpose(incidences[r]), x[r - 1])
            parts.append(polynomial(down[r], projected, coefficients) if r in down else projected)
        if r + 1 in incidences and r + 1 in x:
            projected = L.spmv(incidences[r + 1], x[r + 1])
            parts.append(polynomial(up[r], projected, coefficients) if r in up else projected)
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        out[r] = total.groupBy("g", "id").agg(F.sum("x").alias("x"))
    return out


def unified_hypergraph_pass(incidence: DataFrame, x: DataFrame) -> DataFrame:
    """Mean of members, weighed back by 1 / sqrt(node degree * mean degree of the hyperedge's members), for scalar features (g, id, x)."""
    d = incidence.groupBy("g", "v").agg(F.count(F.lit(1)).alias("d"))
    members = incidence.join(d, ["g", "v"]).join(x.select("g", F.col("id").alias("v"), "x"), ["g", "v"])
    he = members.groupBy("g", "he").agg(F.avg("x").alias("m"), F.avg("d").alias("e"))
    sent = incidence.join(he, ["g", "he"]).groupBy("g", "v").agg(F.sum(F.col("m") / F.sqrt("e")).alias("m"))
    return sent.join(d, ["g", "v"]).select("g", F.col("v").alias("id"), (F.col("m") / F.sqrt("d")).alias("x"))
