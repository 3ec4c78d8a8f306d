"""Layers with given weights against numpy, general kernels, strong components, masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import backbones as B
from cellweave.operators import evaluation as V
from cellweave.operators import graph as G
from cellweave.operators import liftings as S

EDGES = [(0, 1), (0, 2), (1, 2), (2, 3)]
X = np.array([[1.0, -2.0], [0.5, 3.0], [-1.0, 0.0], [400.0, 2.0], [7.0, 7.0]])


@pytest.fixture(scope="module")
def arcs(spark):
    return spark.createDataFrame([(0, u, v) for a, b in EDGES for u, v in ((a, b), (b, a))], "g long, src long, dst long")


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame([(0, i, row.tolist()) for i, row in enumerate(X)], "g long, id long, x array<double>")


def values(df):
    return {r["id"]: r["x"] for r in df.collect()}


def near_of(i):
    return sorted({b for a, b in EDGES if a == i} | {a for a, b in EDGES if b == i})


def test_neighbour_pass(arcs, x):
    for how, f in (("sum", np.sum), ("mean", np.mean), ("max", np.max)):
        got = values(B.neighbour_pass(arcs, x, how, 1.5))
        for i in range(5):
            m = f(X[near_of(i)], axis=0) if near_of(i) else np.zeros(2)
            assert np.allclose(got[i], 1.5 * X[i] + m)


def test_attention_has_no_overflow(arcs, x):
    source, target = np.array([3.0, 1.0]), np.array([-1.0, 0.5])
    got = values(B.attention_pass(arcs, x, source, target))
    assert set(got) == set(range(5))
    for i in range(5):
        around = [*near_of(i), i]
        s = X[around] @ source + X[i] @ target
        s = np.where(s > 0, s, 0.2 * s)
        w = np.exp(s - s.max())
        assert np.allclose(got[i], (w / w.sum()) @ X[around])
    assert 4 not in values(B.attention_pass(arcs, x, source, target, self_loops=False))


def test_hypergraph_attention_of_one_edge(spark, x):
    incidence = spark.createDataFrame([(0, v, 9) for v in range(3)], "g long, v long, he long")
    got = values(B.hypergraph_attention(incidence, x, [0.0, 0.0]))
    assert set(got) == {0, 1, 2} and all(np.allclose(v, X[:3].mean(0)) for v in got.values())


def test_linear_attention(spark):
    y = np.array([[0.5, -1.0, 2.0], [1.5, 0.0, -3.0], [-0.5, 1.0, 0.25]])
    rows = spark.createDataFrame([(g, i, r.tolist()) for g in (0, 1) for i, r in enumerate(y * (g + 1))], "g long, id long, x array<double>")
    for g in (0, 1):
        z = y * (g + 1)
        f = np.where(z > 0, z + 1, np.exp(z))
        want = (f @ (f.T @ z)) / (f @ f.sum(0))[:, None]
        got = values(B.linear_attention(rows).where(f"g = {g}"))
        assert all(np.allclose(got[i], want[i]) for i in range(3))


def test_sheaf(spark):
    maps = spark.createDataFrame([(0, 0, 1, [2.0, 1.0], [1.0, -1.0]), (0, 1, 2, [0.0, 3.0], [0.5, 1.0]), (0, 3, 4, [0.0, 1.0], [1.0, 1.0])], "g long, u long, v long, fu array<double>, fv array<double>")
    for stalk in (0, 1):
        delta = np.zeros((3, 5))
        for e, r in enumerate(maps.orderBy("u").collect()):
            delta[e, r["u"]], delta[e, r["v"]] = r["fu"][stalk], -r["fv"][stalk]
        whole = delta.T @ delta
        d = np.diag(whole)
        p = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
        for normalised, want in ((False, whole), (True, whole * p[:, None] * p[None, :])):
            got = np.zeros((5, 5))
            for r in B.sheaf_laplacian(maps, normalised).where(f"stalk = {stalk}").collect():
                got[r["row"], r["col"]] = r["val"]
            assert np.allclose(got, want)
        start = spark.createDataFrame([(0, stalk, i, float(i + 1)) for i in range(5)], "g long, stalk int, id long, x double")
        y = np.arange(1.0, 6.0)
        for _ in range(2):
            y = y - (whole * p[:, None] * p[None, :]) @ y
        got = values(B.sheaf_diffusion(B.sheaf_laplacian(maps), start, 2))
        assert np.allclose([got[i] for i in range(5)], y)


def test_polynomial_keeps_rows_without_entries(spark):
    op = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 1.0)], "g long, row long, col long, val double")
    x = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "g long, id long, x double")
    assert values(B.polynomial(op, x, [1, 10, 100])) == {0: 1 + 50 + 1000, 1: 3}


def test_unified_hypergraph_pass(spark):
    pairs = [(0, 0), (1, 0), (1, 1), (2, 1), (3, 1)]
    incidence = spark.createDataFrame([(0, v, h) for v, h in pairs], "g long, v long, he long")
    x = spark.createDataFrame([(0, v, float(v + 1)) for v in range(4)], "g long, id long, x double")
    got = values(B.unified_hypergraph_pass(incidence, x))
    first, second = 1.5 / np.sqrt(1.5), 3.0 / np.sqrt(4 / 3)
    assert got == pytest.approx({0: first, 1: (first + second) / np.sqrt(2), 2: second, 3: second})


def sets(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["he"], set()).add(r["v"])
    return sorted(map(sorted, got.values()))


def test_kernels(spark):
    edges = spark.createDataFrame([(0, a, b) for a, b in EDGES], "g long, u long, v long")
    nodes = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(X)], "g long, v long, x array<double>")
    a = np.zeros((5, 5))
    for u, v in EDGES:
        a[u, v] = a[v, u] = 1
    s = 1 / np.sqrt(np.maximum(a.sum(1), 1))
    inverse = np.linalg.inv(2 / 4 * np.eye(5) + np.eye(5) - a * s[:, None] * s[None, :])
    gram = lambda m: np.exp(-((m[:, None] - m[None]) ** 2).sum(-1) / 1e5)

    def want(k, fraction):
        h = np.round(k, 12) >= np.quantile(np.round(k, 12), 1 - fraction)
        return sorted(map(list, {tuple(np.flatnonzero(h[:, c]).tolist()) for c in range(5) if h[:, c].sum() > 1}))

    assert sets(S.kernel_hypergraph(edges, 0.4, nodes=nodes, kernel="matern", nu=1, kappa=2)) == want(inverse, 0.4)
    assert sets(S.kernel_hypergraph(edges, 0.3, nodes=nodes, kernel="identity", features=gram, combine="sum")) == want(1 + gram(X), 0.3)
    assert sets(S.kernel_hypergraph(edges, 0.4, nodes=nodes, kernel=lambda m: m, features=gram)) == want((np.eye(5) - a * s[:, None] * s[None, :]) * gram(X), 0.4)
    assert sets(S.kernel_hypergraph(edges, 0.5, kernel="identity")) == [[0, 1, 2, 3]]
    for wrong in ({"kernel": "cubic"}, {"features": "cubic"}, {"combine": "cubic"}, {"features": gram}):
        with pytest.raises(ValueError):
            S.kernel_hypergraph(edges, **wrong)


def test_strong_components(spark):
    rng = np.random.default_rng(3)
    arcs = {(int(a), int(b)) for a, b in rng.integers(0, 14, (19, 2))} | {(14, 15), (15, 14), (15, 16)}
    reach = np.eye(18, dtype=bool)
    for a, b in arcs:
        reach[a, b] = True
    for k in range(18):
        reach |= reach[:, [k]] & reach[[k], :]
    both = reach & reach.T
    nodes = spark.createDataFrame([(0, v) for v in range(18)], "g long, v long")
    df = spark.createDataFrame([(0, a, b) for a, b in sorted(arcs)], "g long, src long, dst long")
    got = {r["v"]: r["component"] for r in G.strong_components(nodes, df).collect()}
    assert got == {v: int(np.flatnonzero(both[v])[0]) for v in range(18)}
    most = max(np.bincount(list(got.values())))
    assert G.largest_components(nodes, df, 1, strong=True).count() == most
    assert G.strong_components(nodes, df.limit(0)).where("v <> component").isEmpty()


def test_hyperbolic_distances(spark):
    points = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [0.505, 0.0]), (0, 2, [30.0, 40.0])], "g long, v long, x array<double>")
    d = {(r["a"], r["b"]): r["d"] for r in S.pair_distances(points, "hyperbolic").collect()}
    # 0.505 / 1.01 = 0.5, and 50 long shrinks to 1 / 1.01.
    assert d[0, 1] == pytest.approx(np.arccosh(1e-6 + 1 + 2 * 0.25 / 0.75)) and d[0, 1] == d[1, 0]
    r = 1 / 1.01
    assert d[0, 2] == pytest.approx(np.arccosh(1e-6 + 1 + 2 * r * r / (1 - r * r)))
    with pytest.raises(ValueError):
        S.pair_distances(points, "taxi")


def test_split_masks(spark):
    items = spark.range(40).withColumnRenamed("id", "k")
    splits = V.random_split(items.where("k < 39"), "k")
    got = V.split_masks(items, splits, "k").withColumn("all", F.col("train_mask") + F.col("val_mask") + F.col("test_mask"))
    assert {r["k"]: r["all"] for r in got.collect()} == {k: int(k < 39) for k in range(40)}
