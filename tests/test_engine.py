"""Components, pipelines, readers, splits and the entry points."""

import random

import pytest

from cellweave.operators import evaluation as V
from cellweave.operators.components import connected_components
from cellweave.plans.pipeline import Pipeline, chain_of, default_lifting, digest, infer_widths
from cellweave.sources import readers as R


def brute(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_chain_and_cache(spark, tmp_path):
    assert chain_of({"liftings": {"a": {"transform_name": "clique", "dim": 2}}}) == [("clique", {"dim": 2})]
    assert digest([("clique", {"dim": 2})]) != digest([("clique", {"dim": 3})])
    assert default_lifting("graph", "hypergraph") == "khop" and infer_widths([4], "concatenation", 2) == [4, 8, 24]
    nodes, edges = R.manual_graph(spark)
    p = Pipeline([("clique", {"dim": 2}), "node_degrees"])
    tables = {"nodes": nodes.select("g", "v"), "edges": edges}
    first, again = p.cached(spark, tables, str(tmp_path)), p.cached(spark, {}, str(tmp_path))
    assert first["cells"].count() == again["cells"].count() == 27
    with pytest.raises(ValueError):
        Pipeline(["nothing"])


def test_readers(spark, tmp_path):
    (tmp_path / "zoo.content").write_text("10 1 0 1\n11 0 1 2\n12 1 1 2\n")
    (tmp_path / "zoo.edges").write_text("10 20\n11 20\n11 21\n12 21\n12 21\n")
    nodes, inc = R.read_content_hypergraph(spark, str(tmp_path), "zoo")
    assert sorted((r["v"], r["y"]) for r in nodes.collect()) == [(0, 0), (1, 1), (2, 1)]
    assert sorted(map(tuple, inc.collect())) == [(0, 0), (1, 0), (1, 1), (2, 1)]
    (tmp_path / "m.json").write_text('[{"triangulation": [[1,2,3],[2,3,4]], "name": "S^2", "genus": 0}]')
    labels, cells = R.read_manifolds(spark, str(tmp_path / "m.json"))
    assert cells.count() == 4 + 5 + 2 and labels.first()["name_index"] == 4
    (tmp_path / "county_stats_2012.csv").write_text("FIPS,DEM,GOP,Rate\n1,10,30,\"1,5\"\n2,20,20,x\n3,5,5,2\n", encoding="ISO-8859-1")
    (tmp_path / "county_graph.csv").write_text("SRC,DST\n1,2\n2,1\n3,3\n1,9\n")
    nodes, edges = R.read_counties(spark, str(tmp_path), 2012)
    assert sorted((r["FIPS"], r["y"], r["Rate"]) for r in nodes.collect()) == [(1, -0.5, 1.5), (2, 0.0, 1.75)] and edges.count() == 1


def test_splits(spark):
    s = V.permutation_splits(20, 0.6, spark)
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 12, "valid": 4, "test": 4}
    with pytest.raises(ValueError):
        V.default_metrics("nothing")


def test_stream_of_events(spark, tmp_path):
    from cellweave.streaming.degrees import windowed_degrees

    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:20:00", 1, 3.0), ("2024-01-01 05:00:00", 2, 1.0), ("2024-01-02 05:00:00", 2, 1.0)], "ts string, user_id long, value double").selectExpr("cast(ts as timestamp) ts", "user_id", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_degrees(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("degrees").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["user_id"], r["degree"], r["total"]) for r in spark.table("degrees").collect()} == {(1, 2, 5.0), (2, 1, 1.0)}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_over_all_orders(spark, tmp_path):
    import __spark_entry__ as entry

    orders = [{0, 1, 2, 3, 4}, {0, 1}, {0, 1, 2}, {0, 1, 2, 3}, {5}, {4, 6}]
    spark.createDataFrame([(k, v) for k, o in enumerate(orders) for v in o], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(v,) for v in range(8)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    arcs = {(a, b) for o in orders for a in o for b in o if a != b}
    to = {v: {b for a, b in arcs if a == v} for v in range(8)}
    rank = [1 / 8] * 8
    for _ in range(2):
        loose = sum(rank[v] for v in range(8) if not to[v])
        rank = [0.15 / 8 + 0.85 * (sum(rank[u] / len(to[u]) for u in to[v]) + loose / 8) for v in range(8)]
    near = {v: [(a, b) for a in to[v] for b in to[v] if a < b] for v in to}
    want = {
        "to_undirected": arcs, "isolated_nodes": {(5,), (7,)}, "one_hot_degree": {(v, len(to[v])) for v in to}, "khop_1": arcs | {(v, v) for v in to}, "universal_strict_rank": {(0, 4), (1, 1), (2, 2), (3, 3), (4, 0), (5, 1)},
        "clustering_coefficient": {(v, round(sum(p in arcs for p in near[v]) / len(near[v]), 6) if near[v] else 0.0) for v in to}, "pagerank_2": {(v, round(rank[v] + 1e-9, 8)) for v in to},
    }
    for name, rows in want.items():
        assert {tuple(r) for r in entry.queries()[f"{name}_whole"](spark, str(tmp_path)).collect()} == rows, name
