"""Whole-graph queries in blocks of vertices, and all pairs of points in blocks: against plain computations."""

import itertools
import math

import numpy as np
import pytest

from cellweave.operators import blocks as K
from cellweave.operators import components as CC
from cellweave.operators import connectivity as C
from cellweave.operators import encodings as P
from cellweave.operators import features as X
from cellweave.operators import graph as G
from cellweave.operators import liftings as S
from cellweave.operators import pairs
from cellweave.operators import propagation as M

EDGES = sorted({(g, *sorted((a, b))) for g in (0, 3) for a, b in np.random.default_rng(g).integers(0, 60, (300, 2)).tolist() if a != b} | {(0, 5, v) for v in range(6, 60)})


@pytest.fixture(scope="module")
def graph(spark):
    old, K.BLOCK = K.BLOCK, 128
    edges = spark.createDataFrame(EDGES, "g long, u long, v long")
    lists = K.lists_of_edges(edges)
    yield spark.createDataFrame([(g, v) for g in (0, 3) for v in range(62)], "g long, v long"), edges, lists
    K.BLOCK = old


def near(g):
    to = {}
    for h, u, v in EDGES:
        if h == g:
            to.setdefault(u, set()).add(v)
            to.setdefault(v, set()).add(u)
    return to


def three():
    return {(g, *t) for g in (0, 3) for to in [near(g)] for t in itertools.combinations(sorted(to), 3) if t[1] in to[t[0]] and t[2] in to[t[0]] and t[2] in to[t[1]]}


def rows(df, *columns):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*columns).collect())


def test_packed_lists(spark, graph):
    x = np.array([5, 7, 7, -3, 1 << 62, 0])
    assert K.unpack(K.packs(x)[0]).tolist() == x.tolist() and K.unpack(K.packs(x[:0])[0]).tolist() == []
    assert rows(K.edges_of(graph[2]), "g", "u", "v") == EDGES
    h = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 2, 1), (0, 3, 2), (0, 4, None), (0, 5, None), (0, None, 1), (1, 3, 2)], "g long, v long, he long")
    assert rows(K.edges_of(K.lists_of_hypergraph(h)), "g", "u", "v") == [(0, 1, 2)]


def test_triangles_in_blocks(graph):
    """cells and incidences without joins of names."""
    nodes, edges, lists = graph
    cells = S.clique_complex(nodes, edges, 2, lists)
    want = three()
    assert rows(cells.where("rank = 2"), "g", "verts") == sorted((g, (a, b, c)) for g, a, b, c in want)
    assert rows(C.neighbourhood(cells, "2-down_incidence-2"), "g", "row", "col") == sorted((g, str(v), f"{a}-{b}-{c}") for g, a, b, c in want for v in (a, b, c))
    assert rows(C.data2cells(C.incidence(cells, 1), C.incidence(cells, 2), named=True), "g", "rank", "verts") == sorted([(g, 1, (u, v)) for g, u, v in EDGES] + [(g, 2, (a, b, c)) for g, a, b, c in want])
    sides = X.concatenation_simplices(cells, 2, lambda e: pairs.F.array(e[0], e[1]))
    assert rows(sides, "g", "verts", "x") == sorted((g, (a, b, c), tuple(y for _, e in sorted((f"{p}-{q}", (p, q)) for p, q in ((a, b), (a, c), (b, c))) for y in e)) for g, a, b, c in want)
    assert rows(X.set_lifting_simplices(cells, 2), "g", "verts") == sorted((g, (a, b, c)) for g, a, b, c in want)
    assert rows(S.vietoris_rips(nodes, edges, 1, lists=lists).where("rank = 2"), "g", "verts") == rows(cells.where("rank = 2"), "g", "verts")


def test_sums_over_triangles(graph):
    """F5, F8, F9, F18."""
    nodes, edges, lists = graph
    want, cells = three(), S.clique_complex(nodes, edges, 2, lists)
    linked = {(g, *p) for g, *t in want for p in itertools.permutations(t, 2)}
    assert rows(K.triangle_neighbours(lists), "g", "u", "v") == sorted(linked)
    at = {}
    for g, *t in want:
        for v in t:
            at[g, v] = at.get((g, v), 0) + 1
    assert rows(M.signal_down_simplices(cells.withColumn("x", pairs.F.lit(1)), 2), "g", "id", "x") == sorted((*k, 2 * n) for k, n in at.items())
    full = {}
    for r in C.up_laplacian(cells, 1).collect():
        n, s, c = full.get((r["g"], r["row"]), (0, 0, 0))
        full[r["g"], r["row"]] = (n + 1, s + r["val"], c + int(r["col"].replace("-", "")))
    assert {(r["g"], f"{r['u']}-{r['v']}"): (r["n"], r["val"], r["checksum"]) for r in K.up_laplacian_sums(lists).collect()} == full
    got = {(r["g"], r["k"], r["v"]): r["p"] for r in P.random_walk(None, 3, lists).collect()}
    plain = {}
    for g in (0, 3):
        to = near(g)
        ids = sorted(to)
        w = np.array([[(q in to[p]) / len(to[p]) for q in ids] for p in ids])
        plain |= {(g, k, v): p for k in (2, 3) for v, p in zip(ids, np.diag(np.linalg.matrix_power(w, k)).tolist(), strict=True) if p > 0}
    assert got.keys() == plain.keys() and all(math.isclose(got[k], plain[k]) for k in got)


def test_two_hops_in_blocks(graph):
    """F1, F10, F14."""
    nodes, edges, lists = graph
    assert rows(G.distances(nodes, None, 2, lists=lists), "g", "centre", "v", "d") == rows(G.distances(nodes, edges, 2), "g", "centre", "v", "d")
    assert rows(G.k_hop(nodes, None, 2, lists), "g", "centre", "v") == rows(G.k_hop(nodes, edges, 2), "g", "centre", "v")
    assert rows(S.neighbourhood_complex_sets(nodes, None, lists), "g", "centre", "verts") == rows(S.neighbourhood_complex_sets(nodes, edges), "g", "centre", "verts")


def test_line_graph_sums(graph):
    """F15."""
    want = {}
    for r in S.line_graph(graph[1]).collect():
        n, c = want.get((r["g"], r["u"]), (0, 0))
        want[r["g"], r["u"]] = (n + 1, c + int(r["v"].replace("-", "")))
    assert {(r["g"], r["u"]): (r["n"], r["checksum"]) for r in S.line_graph_sums(graph[1]).collect()} == want


def test_ascending_paths_contract(spark, monkeypatch):
    """F13, F16: a path of ascending ids did not shrink in a round by least neighbours."""
    monkeypatch.setattr(CC, "SMALL", 10)
    monkeypatch.setattr(CC, "MAX_ROUNDS", 20)
    path = spark.createDataFrame([(v, v + 1) for v in range(2, 400) if v != 200], "a long, b long")
    found = {r["node"]: r["component"] for r in CC.connected_components(path).collect()}
    assert found == {v: 2 if v <= 200 else 201 for v in range(2, 401)}


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(1).normal(size=(120, 6))
    x[7] = x[3]
    return x, spark.createDataFrame([(0, i, p) for i, p in enumerate(x.tolist())], "g int, v long, x array<double>")


def test_distances_by_products(points):
    """F12, F17, F20."""
    x, cloud = points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r["a"], r["b"]): r["d"] for r in S.radius_graph(cloud, 1.5).collect()}
    assert got.keys() == {(i, j) for i in range(120) for j in range(120) if i != j and d[i, j] <= 1.5} and all(math.isclose(e, d[k], abs_tol=1e-12) for k, e in got.items())
    got = sorted((r["centre"], r["d"], r["v"]) for r in S.knn(cloud, 3).collect())
    assert [(c, v) for c, _, v in got] == [(i, j) for i in range(120) for j in sorted((j for j in range(120) if j != i), key=lambda j: (d[i, j], j))[:3]]
    want = {}
    for r in S.pair_distances(cloud, "hyperbolic").where("a <> b").collect():
        low, high = want.get(r["a"], (math.inf, 0))
        want[r["a"]] = (min(low, r["d"]), max(high, r["d"]))
    found = {r["v"]: (r["least"], r["most"]) for r in S.hyperbolic_extremes(cloud).collect()}
    assert found.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-9) for v in want for a, b in zip(found[v], want[v], strict=True))


def test_sampled_edges_draw_as_before(spark, points):
    """the same draws as from all pairs scored in SQL (an integer id takes that way still)."""
    _, cloud = points
    F = pairs.F
    noise = F.pmod(F.xxhash64(F.lit(0), "g", "a", "b"), F.lit(1 << 30)) / float(1 << 30) + 1e-8
    best = {}
    for r in S.pair_distances(cloud).select("a", "b", (F.col("d") * F.col("d") - F.log(-F.log(noise))).alias("s")).collect():
        best.setdefault(r["a"], []).append((r["s"], r["b"]))
    got = {(r["a"], r["b"]) for r in M.sampled_edges(cloud, 5, 0.0).collect()}
    assert got == {(a, b) for a, all_ in best.items() for _, b in sorted(all_)[:5]}


@pytest.fixture(scope="module")
def tiled(spark):
    """The same graph with names that say nothing of who is linked, in ranges of few vertices."""
    old, K.TILE = K.TILE, 200
    name = {v: int(n) for v, n in enumerate(np.random.default_rng(5).permutation(62) * 1000003)}
    edges = sorted({(g, *sorted((name[u], name[v]))) for g, u, v in EDGES})
    frame = spark.createDataFrame(edges, "g long, u long, v long")
    yield spark.createDataFrame([(g, name[v]) for g in (0, 3) for v in range(62)], "g long, v long"), frame, K.lists_of_edges(frame), {(g, *sorted(name[v] for v in t)) for g, *t in three()}
    K.TILE = old


def test_tiles_find_all_triangles(tiled):
    """F4, F5, F6, F7, F8, F10: lists go to a few tiles, not to every block that has a neighbour."""
    nodes, edges, lists, want = tiled
    assert rows(K.triangles(lists), "g", "a", "b", "c") == sorted(want)
    cells = S.clique_complex(nodes, K.edges_of(lists), 2, lists)
    assert rows(C.data2cells(C.incidence(cells, 1), C.incidence(cells, 2), named=True), "g", "rank", "verts") == sorted([(r["g"], 1, (r["u"], r["v"])) for r in edges.collect()] + [(g, 2, t) for g, *t in ((g, a, b, c) for g, a, b, c in want) for t in [tuple(t)]])


def test_tiles_sum_over_triangles(tiled):
    """F9, F11, F12, F13."""
    nodes, edges, lists, want = tiled
    assert rows(K.triangle_neighbours(lists), "g", "u", "v") == sorted({(g, *p) for g, *t in want for p in itertools.permutations(t, 2)})
    at = {}
    for g, *t in want:
        for v in t:
            at[g, v] = at.get((g, v), 0) + 1
    assert rows(K.triangle_counts(lists), "g", "v", "n") == sorted((*k, n) for k, n in at.items())
    full = {}
    for r in C.up_laplacian(S.clique_complex(nodes, edges, 2, lists), 1).collect():
        n, s, c = full.get((r["g"], r["row"]), (0, 0, 0))
        full[r["g"], r["row"]] = (n + 1, s + r["val"], c + int(r["col"].replace("-", "")))
    assert {(r["g"], f"{r['u']}-{r['v']}"): (r["n"], r["val"], r["checksum"]) for r in K.up_laplacian_sums(lists).collect()} == full
    to = {}
    for r in edges.collect():
        to.setdefault((r["g"], r["u"]), set()).add(r["v"])
        to.setdefault((r["g"], r["v"]), set()).add(r["u"])
    plain = {}
    for (g, u), near in to.items():
        plain[g, 2, u] = sum(1 / len(near) / len(to[g, v]) for v in near)
        if p := sum(1 / len(near) / len(to[g, v]) / len(to[g, w]) for v in near for w in near & to[g, v]):
            plain[g, 3, u] = p
    got = {(r["g"], r["k"], r["v"]): r["p"] for r in K.returns(lists, 3).collect()}
    assert got.keys() == plain.keys() and all(math.isclose(got[k], plain[k]) for k in got)


def test_two_hop_sums(spark, tiled, graph):
    """numbers and sums of what is two hops away, without a row for each pair."""
    for nodes, lists in ((tiled[0], tiled[2]), (graph[0], graph[2])):
        full = {}
        for r in G.distances(nodes, None, 2, lists=lists).collect():
            n, c = full.get((r["g"], r["centre"], r["d"]), (0, 0))
            full[r["g"], r["centre"], r["d"]] = (n + 1, c + r["v"])
        found = {(r["g"], r["centre"], r["d"]): (r["n"], r["checksum"]) for r in G.two_hop_sums(nodes, lists).collect()}
        assert found == full and {d for _, _, d in full} == {0, 1, 2}
        some = nodes.where("v % 2 = 0")
        assert {r["centre"] for r in G.two_hop_sums(some, lists).collect()} == {r["v"] for r in some.collect()}


def test_named_cells_need_no_shuffle(tiled):
    """F8: a cell is read off one row of its incidence."""
    nodes, _, lists, _ = tiled
    cells = S.clique_complex(nodes, K.edges_of(lists), 2, lists)
    found = C.data2cells(C.incidence(cells, 1), C.incidence(cells, 2), named=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and rows(found, "g", "rank", "verts") == rows(cells.where("rank > 0"), "g", "rank", "verts")
