"""Seeded and spectral liftings: invariants, repeats, and small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import encodings as P
from cellweave.operators import evaluation as V
from cellweave.operators import graph as G
from cellweave.operators import propagation as M
from cellweave.operators import sampled as Z
from cellweave.sources import readers as R

CLOUD = [(0, i, [x, y]) for i, (x, y) in enumerate([(0.0, 0.0), (0.1, 0.0), (0.0, 0.1), (0.1, 0.1), (10.0, 0.0), (10.1, 0.0), (10.0, 0.1), (10.1, 0.1)])]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_latent_cliques_cover_all_edges(spark):
    nodes, edges = R.manual_graph(spark)
    found = {(r["u"], r["v"]) for r in Z.latent_clique_edges(edges, 300, 1).collect()}
    assert set(R.MANUAL_EDGES) <= found
    assert rows(Z.latent_clique_edges(edges, 300, 1), "u", "v") == sorted(found)
    cells = Z.latent_clique_complex(nodes.select("g", "v"), edges, 1, 300, 1)
    assert cells.where("rank = 1").count() == len(found) and cells.where("rank = 0").count() == 8


def test_dice_simplices_are_closed_and_bounded(spark):
    nodes, edges = R.manual_graph(spark)
    nodes = nodes.select("g", "v")
    cells = rows(Z.dice_simplices(nodes, edges, 2, 3, 5), "rank", "verts")
    assert cells == rows(Z.dice_simplices(nodes, edges, 2, 3, 5), "rank", "verts")
    sets = {tuple(v) for _, v in cells}
    assert {(v,) for v in range(8)} <= sets and len(sets) == len(cells)
    for rank, verts in cells:
        assert len(verts) == rank + 1 and len(set(verts)) == len(verts)
        assert rank == 0 or all(tuple(v for v in verts if v != x) in sets for x in verts)
    assert sum(rank == 2 for rank, _ in cells) <= 8 * 4


def test_mixture_tree(spark):
    got = rows(Z.mixture_tree(spark.createDataFrame(CLOUD, "g long, v long, x array<double>"), 2, 2), "v", "he")
    label = {v: he for v, he in got if he < 2}
    assert {label[v] for v in range(4)} != {label[v] for v in range(4, 8)} and len(set(label.values())) == 2
    # Two components are each other's neighbours in the tree.
    assert sorted((v, he - 2) for v, he in got if he >= 2) == sorted((v, 1 - c) for v, c in label.items())


def test_modularity(spark):
    nodes = spark.createDataFrame(CLOUD, "g long, v long, x array<double>")
    edges = spark.createDataFrame([(0, u, v) for lo in (0, 4) for u in range(lo, lo + 4) for v in range(u + 1, lo + 4)] + [(0, 3, 4)], "g long, u long, v long")
    of = {r["v"]: r["community"] for r in Z.modularity_communities(nodes.select("g", "v"), edges, 2).collect()}
    assert len({of[v] for v in range(4)}) == 1 and len({of[v] for v in range(4, 8)}) == 1 and of[0] != of[4]
    got = rows(Z.modularity_hypergraph(nodes, edges, 2, 2), "v", "he")
    assert all(of[a] == of[b] for a, b in got) and len(got) == 16 and all((v, v) in got for v in range(8))


def test_mapper_filters(spark):
    points = spark.createDataFrame(CLOUD, "g long, v long, x array<double>")
    assert dict(rows(Z.scalar_filter(points, kind="feature_sum"), "v", "f"))[7] == pytest.approx(10.2)
    f = dict(rows(Z.scalar_filter(points, kind="feature_pca"), "v", "f"))
    assert f[0] == pytest.approx(0) and f[7] == pytest.approx(10.1, abs=0.05)
    assert dict(rows(Z.scalar_filter(points, kind="svd"), "v", "f"))[4] == pytest.approx(10, abs=0.05)
    path = spark.createDataFrame([(0, k, k + 1) for k in range(7)], "g long, u long, v long")
    f = dict(rows(Z.scalar_filter(points, path, "laplacian"), "v", "f"))
    # Over the roots of the degrees, the second eigenvector falls or rises along a path.
    along = [f[v] / (1 if v in (0, 7) else 2**0.5) for v in range(8)]
    assert along in (sorted(along), sorted(along, reverse=True)) and along[0] * along[7] < 0
    with pytest.raises(ValueError):
        Z.scalar_filter(points, kind="height")


def test_eigenvector_and_pagerank(spark):
    nodes, edges = R.manual_graph(spark)
    nodes = nodes.select("g", "v")
    import numpy as np

    a = np.zeros((8, 8))
    for u, v in R.MANUAL_EDGES:
        a[u, v] = a[v, u] = 1
    top = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = [x for _, x in rows(G.eigenvector(nodes, edges, 40), "v", "x")]
    assert np.allclose(got, top, atol=1e-4)
    rank, d = np.full(8, 1 / 8), a.sum(axis=0)
    for _ in range(6):
        rank = 0.15 / 8 + 0.85 * (a @ (rank / d))
    assert np.allclose([x for _, x in rows(G.pagerank(nodes, edges, 6), "v", "rank")], rank)


def test_distances_stop_at_reach(spark):
    nodes, edges = spark.createDataFrame([(0, v) for v in range(5)], "g long, v long"), spark.createDataFrame([(0, k, k + 1) for k in range(4)], "g long, u long, v long")
    reach = nodes.select("g", F.col("v").alias("centre"), F.when(F.col("v") == 0, 2).otherwise(0).alias("reach"))
    assert rows(G.distances(nodes, edges, 3, reach).where("d > 0"), "centre", "v", "d") == [(0, 1, 1), (0, 2, 2)]


def test_encodings_side_by_side(spark):
    nodes, edges = R.manual_graph(spark)
    out = P.combined_encodings(nodes.select("g", "v"), edges, ["RWSE", "LapPE"], 3, 3)
    x = {r["v"]: r["x"] for r in out.collect()}
    assert {len(e) for e in x.values()} == {6} and x[0][:3] == pytest.approx([0, 0.291667, 0.138889], abs=1e-5)
    with pytest.raises(ValueError):
        P.combined_encodings(nodes, edges, ["other"])


def test_batches_masks_and_losses(spark):
    items = spark.range(103).withColumnRenamed("id", "k")
    assert rows(V.batch_numbers(items, "k", 10), "k", "batch") == [(k, k // 10) for k in range(103)]
    shuffled = rows(V.batch_numbers(items, "k", 10, 3).groupBy("batch").count(), "batch", "count")
    assert shuffled == [(b, 10) for b in range(10)] + [(10, 3)]
    splits = V.random_split(items, "k")
    assert sum(V.masked(items, splits, "k", s).count() for s in ("train", "valid", "test")) == 103
    edges = spark.createDataFrame([(0, 1, 2, -0.5), (0, 1, 3, -1.5)], "g long, a long, b long, logprob double")
    correct = spark.createDataFrame([(0, 1, True)], "g long, v long, correct boolean")
    assert M.sampling_loss(edges, correct).first()["loss"] == pytest.approx(0.5 * -0.5 * (0.6065307 + 0.2231302) / 2)
    assert spark.range(1).select(V.total_loss([F.lit(1.0), F.lit(2.0)], [1.0, 0.5]).alias("x")).first()["x"] == 2.0


def test_sampled_edges(spark):
    points = spark.createDataFrame(CLOUD, "g long, v long, x array<double>")
    got = rows(M.sampled_edges(points, 3, 4.0), "a", "b", "logprob")
    assert got == rows(M.sampled_edges(points, 3, 4.0), "a", "b", "logprob") and len(got) == 24
    # Squared distances across the two groups are near 100: at this temperature noise never bridges that.
    assert all((a < 4) == (b < 4) and p > -2 for a, b, p in got)


def test_kernel_hyperedges(spark):
    from cellweave.operators import liftings as S

    # Two separate edges: the heat kernel is positive inside an edge and 0 across, and half of the entries pass.
    edges = spark.createDataFrame([(0, 0, 1), (0, 2, 3)], "g long, u long, v long")
    got = {}
    for v, he in rows(S.kernel_hypergraph(edges, 0.5), "v", "he"):
        got.setdefault(he, set()).add(v)
    assert sorted(map(sorted, got.values())) == [[0, 1], [2, 3]]
