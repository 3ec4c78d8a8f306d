"""All queries of the engine's own operators over the driver's tables, with their DuckDB equivalents.

Values that both engines compute in floating point are rounded after adding a small offset, so that
results on a rounding boundary agree. Vertex sets are written as text, vertices joined by "-".
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import backbones as B
from cellweave.operators import blocks as K
from cellweave.operators import connectivity as C
from cellweave.operators import encodings as P
from cellweave.operators import evaluation as V
from cellweave.operators import features as X
from cellweave.operators import graph as G
from cellweave.operators import liftings as S
from cellweave.operators import propagation as M
from cellweave.operators import sampled as Z
from cellweave.sources import readers as R
from cellweave.sources import tables as T
from cellweave.storage import materialise
from cellweave.streaming import degrees as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared parts of the SQL.
H = "H AS (SELECT DISTINCT l_partkey AS v, l_orderkey AS he FROM lineitem)"
E = H + ", E AS (SELECT DISTINCT a.v AS u, b.v AS v FROM H a JOIN H b ON a.he = b.he AND a.v < b.v)"
H3 = H + ", HS AS (SELECT h.* FROM H h JOIN (SELECT he FROM H GROUP BY he HAVING count(*) <= 3) s USING (he))"
#: In place of H3: all orders.
HW = H + ", HS AS (SELECT * FROM H)"
E3 = H3 + ", E AS (SELECT DISTINCT a.v AS u, b.v AS v FROM HS a JOIN HS b ON a.he = b.he AND a.v < b.v)"
N = "E AS (SELECT CAST(a.n_nationkey AS BIGINT) AS u, CAST(b.n_nationkey AS BIGINT) AS v FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"
U = ", U AS (SELECT u AS s, v AS t FROM E UNION ALL SELECT v, u FROM E)"
TRI = ", T AS (SELECT a.u AS a, a.v AS b, b.v AS c FROM E a JOIN E b ON a.v = b.u JOIN E c ON c.u = a.u AND c.v = b.v)"
TET = TRI + ", K AS (SELECT t.a, t.b, t.c, e.v AS d FROM T t JOIN E e ON e.u = t.c JOIN E f ON f.u = t.a AND f.v = e.v JOIN E g ON g.u = t.b AND g.v = e.v)"
#: Signed and unsigned incidences of the complex over E, T, K, as rows (r, i, j, s): face, cell, sign.
EN, TN, KN = "(u || '-' || v)", "(a || '-' || b || '-' || c)", "(a || '-' || b || '-' || c || '-' || d)"
B1 = f", B1 AS (SELECT CAST(u AS VARCHAR) AS i, {EN} AS j, -1 AS s FROM E UNION ALL SELECT CAST(v AS VARCHAR), {EN}, 1 FROM E)"
B2 = f", B2 AS (SELECT b || '-' || c AS i, {TN} AS j, 1 AS s FROM T UNION ALL SELECT a || '-' || c, {TN}, -1 FROM T UNION ALL SELECT a || '-' || b, {TN}, 1 FROM T)"
B3 = f", B3 AS (SELECT b || '-' || c || '-' || d AS i, {KN} AS j, 1 AS s FROM K UNION ALL SELECT a || '-' || c || '-' || d, {KN}, -1 FROM K UNION ALL SELECT a || '-' || b || '-' || d, {KN}, 1 FROM K UNION ALL SELECT a || '-' || b || '-' || c, {KN}, -1 FROM K)"
PARTS = "SELECT p_partkey AS v FROM part"


#: For triangles: degree-ordered edges O, wedges at their lower ends, closed by E.
FAST = (
    ", D AS MATERIALIZED (SELECT v, count(*) AS d FROM (SELECT u AS v FROM E UNION ALL SELECT v FROM E) GROUP BY v)"
    ", O AS MATERIALIZED (SELECT CASE WHEN (p.d, E.u) < (q.d, E.v) THEN E.u ELSE E.v END AS a, CASE WHEN (p.d, E.u) < (q.d, E.v) THEN E.v ELSE E.u END AS b FROM E JOIN D p ON p.v = E.u JOIN D q ON q.v = E.v)"
    ", W AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM O x JOIN O y ON x.a = y.a AND x.b < y.b)"
    ", T AS (SELECT least(p, q) AS a, CASE WHEN p < q THEN q WHEN p < r THEN p ELSE r END AS b, greatest(p, r) AS c FROM W SEMI JOIN E ON E.u = W.q AND E.v = W.r)"
)


def summed(df: DataFrame, key: list[str]) -> DataFrame:
    """A large result in a row for each ``key``: the number of its rows, the sum of ``val`` and a checksum of the other columns."""
    rest = [c for c in df.columns if c not in (*key, "val")]
    # Names are digits joined by "-": without it they are numbers.
    check = F.lit(0).cast("long")
    for k, c in enumerate(rest):
        check = check + (2 * k + 1) * F.translate(F.col(c), "-", "").cast("long") if df.schema[c].dataType.simpleString() == "string" else check + (2 * k + 1) * F.col(c).cast("long")
    sums = [F.sum("val").alias("val")] if "val" in df.columns else []
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *sums, F.sum(check).alias("checksum"))


def summed_sql(sql: str, key: list[str], columns: list[str]) -> str:
    check = " + ".join(f"{2 * k + 1} * CAST(replace(CAST({c} AS VARCHAR), '-', '') AS BIGINT)" for k, c in enumerate(c for c in columns if c not in (*key, "val")))
    sums = "CAST(sum(val) AS BIGINT) AS val, " if "val" in columns else ""
    by = ", ".join(key)
    return f"SELECT {by}, CAST(count(*) AS BIGINT) AS n, {sums}CAST(sum({check}) AS BIGINT) AS checksum FROM ({sql}) GROUP BY {by}"


def query(sql: str | None = None, whole: Callable[[str], str | None] = lambda sql: sql, by: tuple[list[str], list[str]] | None = None, sums: Callable[[SparkSession, str], DataFrame] | None = None):
    """Registers a query; one with a parameter ``whole`` again as ``NAME_whole``, over all orders, with the SQL of all orders (where ``whole`` leaves one).

    With ``by`` (key, columns) the whole result, of millions of rows, is computed and returned in sums for each key;
    ``sums`` computes the same sums without a row for each of the result's.
    """

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        if "whole" in inspect.signature(f).parameters:
            every = functools.partial(f, whole=True)
            QUERIES[f"{f.__name__}_whole"] = sums or (lambda spark, sf: summed(every(spark, sf), by[0])) if by else every
            if sql and (text := whole(sql.replace(H3, HW))):
                ORACLES[f"{f.__name__}_whole"] = summed_sql(text, *by) if by else text
        return f

    return add


def near(x: Column, digits: int = 6) -> Column:
    return F.round(x + 1e-9, digits)


def names(df: DataFrame) -> DataFrame:
    return df.select(*[C.name(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes if c != "g"])


def two_hop_sums(spark: SparkSession, sf: str, *key: str) -> DataFrame:
    """The rows of ``summed`` over all pairs within two hops: both results' checksums are of v alone."""
    found = G.two_hop_sums(T.parts(spark, sf), T.sparse_lists(spark, sf, True))
    return found.groupBy("centre", *key).agg(F.sum("n").alias("n"), F.sum("checksum").alias("checksum"))


def matrix(df: DataFrame) -> DataFrame:
    return df.select(F.col("row").cast("string").alias("i"), F.col("col").cast("string").alias("j"), F.col("val").cast("long").alias("val"))


def nation_cells(spark: SparkSession, sf: str, dim: int = 3) -> DataFrame:
    return S.clique_complex(T.nations(spark, sf), T.nation_graph(spark, sf), dim)


def sparse_cells(spark: SparkSession, sf: str, dim: int = 2, whole: bool = False) -> DataFrame:
    if whole and dim == 2:
        lists = T.sparse_lists(spark, sf, True)
        return S.clique_complex(T.parts(spark, sf), K.edges_of(lists), 2, lists)
    return S.clique_complex(T.parts(spark, sf), T.sparse_graph(spark, sf, whole), dim)


# --- sources, graph primitives


@query(f"WITH {H} SELECT v, he FROM H")
def incidence_hyperedges(spark, sf):
    return T.order_hypergraph(spark, sf).select("v", "he")


@query(f"WITH {E} SELECT u, v FROM E")
def clique_expansion_edges(spark, sf):
    return T.purchase_graph(spark, sf).select("u", "v")


@query(f"WITH {E3}{U} SELECT s AS src, t AS dst FROM U")
def to_undirected(spark, sf, whole=False):
    return G.to_undirected(T.sparse_graph(spark, sf, whole)).select("src", "dst")


@query(f"WITH {E3}{U} SELECT p_partkey AS v FROM part WHERE p_partkey NOT IN (SELECT s FROM U)")
def isolated_nodes(spark, sf, whole=False):
    return G.isolated(T.parts(spark, sf), T.sparse_graph(spark, sf, whole)).select("v")


@query(f"WITH {E}{U} SELECT p.v, CAST(count(U.s) AS BIGINT) AS degree FROM ({PARTS}) p LEFT JOIN U ON U.s = p.v GROUP BY p.v")
def node_degrees(spark, sf):
    return G.degrees(T.parts(spark, sf), T.purchase_graph(spark, sf)).select("v", "degree")


@query(f"WITH {E3}{U}, d AS (SELECT p.v, count(U.s) AS degree FROM ({PARTS}) p LEFT JOIN U ON U.s = p.v GROUP BY p.v) SELECT v, CAST(k AS BIGINT) AS k FROM d, range(0, 41) r(k) WHERE k = degree", lambda sql: sql.replace("range(0, 41)", "range(0, (SELECT max(degree) + 1 FROM d))"))
def one_hot_degree(spark, sf, whole=False):
    degrees = G.degrees(T.parts(spark, sf), T.sparse_graph(spark, sf, whole))
    width = (degrees.agg(F.max("degree")).first()[0] or 0) if whole else 40
    hot = degrees.select("v", X.one_hot(F.col("degree"), width).alias("x"))
    return hot.select("v", F.posexplode("x").alias("k", "x")).where("x = 1").select("v", F.col("k").cast("long").alias("k"))


@query(f"WITH {H} SELECT he, CAST(count(*) AS BIGINT) AS n FROM H GROUP BY he")
def hyperedge_cardinality(spark, sf):
    return T.order_hypergraph(spark, sf).groupBy("he").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E}{FAST} SELECT {TN} AS verts FROM T".replace("E AS (", "E AS MATERIALIZED (", 1))
def triangles(spark, sf):
    return names(G.triangles(T.purchase_graph(spark, sf)))


@query(f"WITH {E3}{TET} SELECT {KN} AS verts FROM K")
def tetrahedra(spark, sf):
    return names(G.cliques(T.sparse_graph(spark, sf), 4))


@query(f"WITH {N}{TET} SELECT {KN} AS verts FROM K")
def tetrahedra_nation(spark, sf):
    return names(G.cliques(T.nation_graph(spark, sf), 4))


@query(f"WITH {E3}{U} SELECT p.v AS centre, p.v FROM ({PARTS}) p UNION SELECT s, t FROM U")
def khop_1(spark, sf, whole=False):
    return G.k_hop(T.parts(spark, sf), T.sparse_graph(spark, sf, whole), 1).select("centre", "v")


@query(f"WITH {E3}{U} SELECT p.v AS centre, p.v FROM ({PARTS}) p UNION SELECT s, t FROM U UNION SELECT a.s, b.t FROM U a JOIN U b ON a.t = b.s", by=(['centre'], ['centre', 'v']), sums=lambda spark, sf: two_hop_sums(spark, sf))
def khop_2(spark, sf, whole=False):
    return G.k_hop(T.parts(spark, sf), None, 2, T.sparse_lists(spark, sf, whole)).select("centre", "v")


@query(f"WITH {E3}{U}, d2 AS (SELECT p.v AS c, p.v AS v, 0 AS d FROM ({PARTS}) p UNION ALL SELECT s, t, 1 FROM U UNION ALL SELECT a.s, b.t, 2 FROM U a JOIN U b ON a.t = b.s) SELECT c AS centre, v, CAST(min(d) AS INTEGER) AS d FROM d2 GROUP BY c, v", by=(['centre', 'd'], ['centre', 'd', 'v']), sums=lambda spark, sf: two_hop_sums(spark, sf, "d"))
def bfs_distance_2(spark, sf, whole=False):
    return G.distances(T.parts(spark, sf), None, 2, lists=T.sparse_lists(spark, sf, whole)).select("centre", "v", "d")


CC = "r(v, root) AS (SELECT v, v FROM nodes UNION SELECT U.t, r.root FROM r JOIN U ON U.s = r.v), c AS (SELECT v, min(root) AS component FROM r GROUP BY v)"


@query(f"WITH RECURSIVE {N}{U}, nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS v FROM nation), {CC} SELECT v, component FROM c")
def connected_components(spark, sf):
    return G.components(T.nations(spark, sf), T.nation_graph(spark, sf)).select("v", "component")


@query(f"WITH RECURSIVE {N}{U}, nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS v FROM nation), {CC}, top AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS index FROM c JOIN top USING (component)")
def largest_component(spark, sf):
    return G.largest_components(T.nations(spark, sf), T.nation_graph(spark, sf)).select("v", "index")


@query(f"WITH {E3}{U}{TRI}, d AS (SELECT p.v, count(U.s) AS d FROM ({PARTS}) p LEFT JOIN U ON U.s = p.v GROUP BY p.v), k AS (SELECT v, count(*) AS t FROM (SELECT a AS v FROM T UNION ALL SELECT b FROM T UNION ALL SELECT c FROM T) GROUP BY v) SELECT d.v, round(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END + 1e-9, 6) AS clustering FROM d LEFT JOIN k USING (v)")
def clustering_coefficient(spark, sf, whole=False):
    return G.clustering(T.parts(spark, sf), T.sparse_graph(spark, sf, whole)).select("v", near(F.col("clustering")).alias("clustering"))


@query(f"WITH RECURSIVE {E3}{U}, d AS (SELECT p.v, count(U.s) AS d FROM ({PARTS}) p LEFT JOIN U ON U.s = p.v GROUP BY p.v), n AS (SELECT count(*) AS n FROM d), s1 AS (SELECT d.v, d, 1.0 / n AS r FROM d, n), "
       "s2 AS (SELECT s1.v, s1.d, 0.15 / n + 0.85 * (coalesce(w, 0) + (SELECT coalesce(sum(r), 0) FROM s1 WHERE d = 0) / n) AS r FROM s1 CROSS JOIN n LEFT JOIN (SELECT t, sum(r / d) AS w FROM U JOIN s1 ON s1.v = U.s GROUP BY t) q ON q.t = s1.v), "
       "s3 AS (SELECT s2.v, 0.15 / n + 0.85 * (coalesce(w, 0) + (SELECT coalesce(sum(r), 0) FROM s2 WHERE d = 0) / n) AS r FROM s2 CROSS JOIN n LEFT JOIN (SELECT t, sum(r / d) AS w FROM U JOIN s2 ON s2.v = U.s GROUP BY t) q ON q.t = s2.v) "
       "SELECT v, round(r + 1e-9, 8) AS rank FROM s3")
def pagerank_2(spark, sf, whole=False):
    return G.pagerank(T.parts(spark, sf), T.sparse_graph(spark, sf, whole), 2).select("v", near(F.col("rank"), 8).alias("rank"))


# --- connectivity algebra


@query(f"WITH {E3}{B1} SELECT i, j, CAST(s AS BIGINT) AS val FROM B1")
def incidence_1_signed(spark, sf, whole=False):
    return matrix(C.incidence(sparse_cells(spark, sf, 1, whole=whole), 1))


@query(f"WITH {E3}{TRI}{B2} SELECT i, j, CAST(s AS BIGINT) AS val FROM B2")
def incidence_2_signed(spark, sf, whole=False):
    return matrix(C.incidence(sparse_cells(spark, sf, whole=whole), 2))


@query(f"WITH {N}{TET}{B3} SELECT i, j, CAST(s AS BIGINT) AS val FROM B3")
def incidence_3_nation(spark, sf):
    return matrix(C.incidence(nation_cells(spark, sf), 3))


@query(f"WITH {E3}{B1} SELECT x.i, y.i AS j, CAST(sum(x.s * y.s) AS BIGINT) AS val FROM B1 x JOIN B1 y ON x.j = y.j GROUP BY 1, 2 HAVING sum(x.s * y.s) <> 0")
def up_laplacian_0(spark, sf, whole=False):
    return matrix(C.up_laplacian(sparse_cells(spark, sf, 1, whole=whole), 0))


@query(f"WITH {E3}{B1} SELECT x.j AS i, y.j AS j, CAST(sum(x.s * y.s) AS BIGINT) AS val FROM B1 x JOIN B1 y ON x.i = y.i GROUP BY 1, 2 HAVING sum(x.s * y.s) <> 0")
def down_laplacian_1(spark, sf):
    return matrix(C.down_laplacian(sparse_cells(spark, sf, 1), 1))


def up_laplacian_1_sums(spark, sf):
    found = K.up_laplacian_sums(T.sparse_lists(spark, sf, True))
    return found.select(F.concat_ws("-", F.col("u").cast("string"), F.col("v").cast("string")).alias("i"), "n", "val", "checksum")


@query(f"WITH {E3}{TRI}{B2} SELECT x.i, y.i AS j, CAST(sum(x.s * y.s) AS BIGINT) AS val FROM B2 x JOIN B2 y ON x.j = y.j GROUP BY 1, 2 HAVING sum(x.s * y.s) <> 0", by=(['i'], ['i', 'j', 'val']), sums=up_laplacian_1_sums)
def up_laplacian_1(spark, sf, whole=False):
    return matrix(C.up_laplacian(sparse_cells(spark, sf, whole=whole), 1))


@query(f"WITH {N}{TRI}{B1}{B2}, z AS (SELECT x.i AS i, y.i AS j, x.s * y.s AS s FROM B2 x JOIN B2 y ON x.j = y.j UNION ALL SELECT x.j, y.j, x.s * y.s FROM B1 x JOIN B1 y ON x.i = y.i) SELECT i, j, CAST(sum(s) AS BIGINT) AS val FROM z GROUP BY 1, 2 HAVING sum(s) <> 0")
def hodge_laplacian_1(spark, sf):
    return matrix(C.hodge_laplacian(nation_cells(spark, sf, 2), 1))


@query(f"WITH {E3}{B1} SELECT DISTINCT x.i, y.i AS j, CAST(1 AS BIGINT) AS val FROM B1 x JOIN B1 y ON x.j = y.j AND x.i <> y.i")
def adjacency_0(spark, sf, whole=False):
    return matrix(C.adjacency(sparse_cells(spark, sf, 1, whole=whole), 0))


@query(f"WITH {E3}{B1} SELECT DISTINCT x.j AS i, y.j AS j, CAST(1 AS BIGINT) AS val FROM B1 x JOIN B1 y ON x.i = y.i AND x.j <> y.j")
def coadjacency_1(spark, sf):
    return matrix(C.coadjacency(sparse_cells(spark, sf, 1), 1))


@query(f"WITH {E3}{TRI}, m AS (SELECT a AS v, {TN} AS t FROM T UNION ALL SELECT b, {TN} FROM T UNION ALL SELECT c, {TN} FROM T) SELECT DISTINCT CAST(x.v AS VARCHAR) AS i, CAST(y.v AS VARCHAR) AS j, CAST(1 AS BIGINT) AS val FROM m x JOIN m y ON x.t = y.t AND x.v <> y.v")
def nbhd_2_up_adjacency_0(spark, sf, whole=False):
    found = K.triangle_neighbours(T.sparse_lists(spark, sf, whole))
    return matrix(found.select(F.col("u").alias("row"), F.col("v").alias("col"), F.lit(1).alias("val")))


@query(f"WITH {E3}{TRI}, m AS (SELECT a AS v, {TN} AS t FROM T UNION ALL SELECT b, {TN} FROM T UNION ALL SELECT c, {TN} FROM T) SELECT CAST(v AS VARCHAR) AS i, t AS j, CAST(1 AS BIGINT) AS val FROM m")
def nbhd_2_down_incidence_2(spark, sf, whole=False):
    return matrix(C.neighbourhood(sparse_cells(spark, sf, whole=whole), "2-down_incidence-2"))


@query(f"WITH {N}{TRI} SELECT {EN} AS i, {TN} AS j, CAST(1 AS BIGINT) AS val FROM E, T WHERE list_has_all([a, b, c], [u, v])")
def combinatorial_incidence(spark, sf):
    return matrix(C.containment(nation_cells(spark, sf, 2), 1, 2))


@query(f"WITH {E3}{TRI} SELECT (SELECT count(*) FROM part) AS n_0, (SELECT count(*) FROM E) AS n_1, (SELECT count(*) FROM T) AS n_2")
def cell_statistics(spark, sf, whole=False):
    return C.cell_statistics(sparse_cells(spark, sf, whole=whole), 2).select("n_0", "n_1", "n_2")


# --- feature liftings

PX = "x AS (SELECT p_partkey AS v, CAST(p_size AS BIGINT) AS x FROM part)"


def part_sizes(spark, sf, name="id"):
    return T.read(spark, sf, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias(name), F.col("p_size").cast("long").alias("x"))


@query(f"WITH {E}, {PX} SELECT (u || '-' || E.v) AS id, p.x + q.x AS x FROM E JOIN x p ON p.v = E.u JOIN x q ON q.v = E.v")
def projection_sum_1(spark, sf):
    cells = G.cliques(T.purchase_graph(spark, sf), 2).withColumn("rank", F.lit(1))
    return X.projection_sum_simplices(cells, part_sizes(spark, sf), 1).select(C.name("verts").alias("id"), "x")


@query(f"WITH {E}{FAST}, {PX} SELECT {TN} AS id, 2 * (p.x + q.x + r.x) AS x FROM T JOIN x p ON p.v = a JOIN x q ON q.v = b JOIN x r ON r.v = c".replace("E AS (", "E AS MATERIALIZED (", 1))
def projection_sum_2(spark, sf):
    cells = G.triangles(T.purchase_graph(spark, sf)).withColumn("rank", F.lit(2))
    return X.projection_sum_simplices(cells, part_sizes(spark, sf), 2).select(C.name("verts").alias("id"), "x")


@query(f"WITH {E3}, {PX} SELECT (u || '-' || E.v) AS id, p.x + q.x AS x FROM E JOIN x p ON p.v = E.u JOIN x q ON q.v = E.v")
def projection_sum_incidence(spark, sf, whole=False):
    b = C.incidence(sparse_cells(spark, sf, 1, whole=whole), 1)
    x = part_sizes(spark, sf).withColumn("id", F.col("id").cast("string"))
    return X.projection_sum(b, x).select("id", F.col("x").cast("long").alias("x"))


@query(f"WITH {H}, {PX} SELECT he, CAST(sum(x) AS BIGINT) AS x FROM H JOIN x USING (v) GROUP BY he")
def projection_sum_hyperedges(spark, sf):
    b = T.order_hypergraph(spark, sf).select("g", F.col("v").alias("row"), F.col("he").alias("col"), F.lit(1).alias("val"))
    return X.projection_sum(b, part_sizes(spark, sf)).select(F.col("id").alias("he"), "x")


@query(f"WITH {E}, {PX} SELECT (u || '-' || E.v) AS id, p.x || ',' || q.x AS x FROM E JOIN x p ON p.v = E.u JOIN x q ON q.v = E.v")
def concatenation_1(spark, sf):
    e = T.purchase_graph(spark, sf)
    b = e.select("g", F.explode(F.array("u", "v")).alias("row"), F.concat_ws("-", "u", "v").alias("col"), F.lit(1).alias("val"))
    x = part_sizes(spark, sf).withColumn("x", F.array("x"))
    return X.concatenation(b, x).select("id", F.array_join(F.col("x").cast("array<string>"), ",").alias("x"))


@query(f"WITH {E3}{TRI} SELECT {TN} AS id, {TN} AS verts FROM T")
def set_lifting_2(spark, sf, whole=False):
    cells = sparse_cells(spark, sf, whole=whole)
    return names(X.set_lifting_simplices(cells, 2))


@query("WITH t AS (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part WHERE p_partkey % 2 = 0) SELECT p_partkey, round((p_retailprice - m) / s + 1e-9, 6) AS x FROM part, t")
def standardize(spark, sf):
    p = T.read(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
    return X.standardise(p, "x", F.col("p_partkey") % 2 == 0).select("p_partkey", near(F.col("x")).alias("x"))


# --- encodings, curvature, homophily


@query(f"WITH {E3}{U}, d AS (SELECT s, count(*) AS d FROM U GROUP BY s), p AS (SELECT U.s, t, 1.0 / d AS p FROM U JOIN d USING (s)), q AS (SELECT a.s, b.t, sum(a.p * b.p) AS p FROM p a JOIN p b ON a.t = b.s GROUP BY 1, 2), r AS (SELECT a.s, b.t, sum(a.p * b.p) AS p FROM q a JOIN p b ON a.t = b.s AND b.t = a.s GROUP BY 1, 2) SELECT CAST(2 AS INTEGER) AS k, s AS v, round(p + 1e-9, 6) AS p FROM q WHERE s = t UNION ALL SELECT 3, s, round(p + 1e-9, 6) FROM r WHERE s = t")
def rwse_k3(spark, sf, whole=False):
    return P.random_walk(None, 3, T.sparse_lists(spark, sf, whole)).select("k", "v", near(F.col("p")).alias("p"))


DEG = f"{B1}{B2}{B3}, d0 AS (SELECT i, count(*) AS d FROM B1 GROUP BY i), d1 AS (SELECT i, count(*) AS d FROM B2 GROUP BY i), d2 AS (SELECT i, count(*) AS d FROM B3 GROUP BY i), c1 AS (SELECT e.j AS id, 4 - sum(d0.d) + 3 * coalesce(any_value(d1.d), 0) AS x FROM B1 e JOIN d0 USING (i) LEFT JOIN d1 ON d1.i = e.j GROUP BY e.j)"


@query(f"WITH {E3}{TET}{DEG} SELECT b.i AS id, CAST(sum(x) AS BIGINT) AS x FROM B1 b JOIN c1 ON c1.id = b.j GROUP BY b.i")
def simplicial_curvature_0(spark, sf):
    return P.curvature(materialise(sparse_cells(spark, sf, 3), "cells"))[0].select("id", F.col("x").cast("long").alias("x"))


@query(f"WITH {E3}{TET}{DEG} SELECT id, CAST(x AS BIGINT) AS x FROM c1")
def simplicial_curvature_1(spark, sf):
    return P.curvature(materialise(sparse_cells(spark, sf, 3), "cells"))[1].select("id", F.col("x").cast("long").alias("x"))


@query(f"WITH {E3}{TET}{DEG}, o AS (SELECT x.j AS i, y.j AS j, 1 AS s FROM B2 x JOIN B2 y ON x.i = y.i UNION ALL SELECT x.i, y.i, -1 FROM B3 x JOIN B3 y ON x.j = y.j), w AS (SELECT i, sum(s) AS s FROM o WHERE i <> j GROUP BY i) SELECT {TN} AS id, CAST(3 + coalesce(d2.d, 0) - coalesce(w.s, 0) AS BIGINT) AS x FROM T LEFT JOIN d2 ON d2.i = {TN} LEFT JOIN w ON w.i = {TN}")
def simplicial_curvature_2(spark, sf):
    return P.curvature(materialise(sparse_cells(spark, sf, 3), "cells"))[2].select("id", F.col("x").cast("long").alias("x"))


GH = f"{H}, y AS (SELECT p_partkey AS v, p_type AS y FROM part), m AS (SELECT H.he, H.v, y FROM H JOIN y USING (v)), z AS (SELECT he, count(*) AS k FROM H GROUP BY he HAVING count(*) > 1), top AS (SELECT k FROM z GROUP BY k ORDER BY count(*) DESC, k LIMIT 3), s AS (SELECT he, y, count(*) AS t FROM m GROUP BY he, y), D AS (SELECT k, v, y, t, count(*) AS d FROM m JOIN z USING (he) JOIN top USING (k) JOIN s USING (he, y) GROUP BY k, v, y, t)"


def part_types(spark, sf):
    return T.read(spark, sf, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("v"), F.col("p_type").alias("y"))


@query(f"WITH {GH} SELECT k, v, y, t, CAST(d AS BIGINT) AS d FROM D")
def group_homophily_d(spark, sf):
    return P.group_degrees(T.order_hypergraph(spark, sf), part_types(spark, sf), 3)


@query(f"WITH {GH}, n AS (SELECT k, y, t, sum(d) AS n FROM D GROUP BY k, y, t) SELECT k, y, t, round(n / sum(n) OVER (PARTITION BY k, y) + 1e-9, 6) AS dt FROM n")
def group_homophily_dt(spark, sf):
    return P.group_affinity(P.group_degrees(T.order_hypergraph(spark, sf), part_types(spark, sf), 3)).select("k", "y", "t", near(F.col("dt")).alias("dt"))


CH = "(CASE WHEN {k} < 0 OR {k} > {n} THEN 0.0 WHEN {k} = 0 THEN 1.0 WHEN {k} = 1 THEN CAST({n} AS DOUBLE) ELSE CAST({n} AS DOUBLE) * ({n} - 1) / 2 END)"


@query("WITH c AS (SELECT p_type AS y, count(*) AS nc, sum(count(*)) OVER () AS n FROM part GROUP BY p_type), r AS (SELECT y, nc, CAST(n AS BIGINT) AS n, k, t FROM c, (VALUES (2), (3)) q(k), (VALUES (1), (2), (3)) w(t) WHERE t <= k) "
       f"SELECT CAST(k AS INTEGER) AS k, y, CAST(t AS INTEGER) AS t, round({CH.format(n='(nc - 1)', k='(t - 1)')} * {CH.format(n='(n - nc)', k='(k - t)')} / {CH.format(n='(n - 1)', k='(k - 1)')} + 1e-9, 6) AS bt FROM r")
def group_homophily_bt(spark, sf):
    return P.group_baseline(part_types(spark, sf), [2, 3]).select("k", "y", "t", near(F.col("bt")).alias("bt"))


MH = f"{H}, y AS (SELECT p_partkey AS v, p_type AS y FROM part), z AS (SELECT he, count(*) AS n FROM H GROUP BY he), dg AS (SELECT v, count(*) AS m FROM H GROUP BY v), e0 AS (SELECT he, y, count(*) * 1.0 / any_value(n) AS p FROM H JOIN y USING (v) JOIN z USING (he) GROUP BY he, y)"


@query(f"WITH {MH} SELECT he, y, round(p + 1e-9, 6) AS p FROM e0")
def mp_homophily_step0(spark, sf):
    out = P.message_passing_homophily(T.order_hypergraph(spark, sf), part_types(spark, sf), 0)
    return out.select("he", "y", near(F.col("p")).alias("p"))


@query(f"WITH {MH}, n0 AS (SELECT v, y, sum(p) / any_value(m) AS p FROM H JOIN e0 USING (he) JOIN dg USING (v) GROUP BY v, y), e1 AS (SELECT he, y, sum(p) / any_value(n) AS p FROM H JOIN n0 USING (v) JOIN z USING (he) GROUP BY he, y) SELECT he, y, round(p + 1e-9, 5) AS p FROM e1")
def mp_homophily_step1(spark, sf):
    out = P.message_passing_homophily(T.order_hypergraph(spark, sf), part_types(spark, sf), 1).where("step = 1")
    return out.select("he", "y", near(F.col("p"), 5).alias("p"))


# --- structural liftings


@query(f"WITH {E3}{U}, d AS (SELECT s, count(*) AS d FROM U GROUP BY s) SELECT u, E.v, CAST(4 - p.d - q.d AS BIGINT) AS frc FROM E JOIN d p ON p.s = u JOIN d q ON q.s = E.v")
def forman_ricci_edges(spark, sf, whole=False):
    return S.forman_ricci(T.parts(spark, sf), T.sparse_graph(spark, sf, whole)).select("u", "v", "frc")


@query(f"WITH RECURSIVE {N}, d AS (SELECT u, v, 4 - 4 - 4 + (u % 3) AS frc FROM E), cut AS (SELECT quantile_cont(frc, 0.5) AS c FROM d), F AS (SELECT u, v FROM d, cut WHERE frc <= c), U AS (SELECT u AS s, v AS t FROM F UNION ALL SELECT v, u FROM F), nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS v FROM nation), {CC} SELECT v, component AS he FROM c")
def forman_ricci_hyperedges(spark, sf):
    nodes, edges = T.nations(spark, sf), T.nation_graph(spark, sf)
    curved = S.forman_ricci(nodes, edges).withColumn("frc", F.col("frc") + F.col("u") % 3)
    return S.forman_ricci_hyperedges(nodes, curved, 0.5).select("v", "he")


@query(f"WITH {E3}{U}, s AS (SELECT p.v AS c, p.v FROM ({PARTS}) p UNION SELECT a.s, b.t FROM U a JOIN U b ON a.t = b.s), k AS (SELECT c, v FROM s WHERE (c, v) NOT IN (SELECT s, t FROM U)) SELECT c AS centre, string_agg(v, '-' ORDER BY v) AS verts FROM k GROUP BY c")
def neighborhood_complex_sets(spark, sf, whole=False):
    return names(S.neighbourhood_complex_sets(T.parts(spark, sf), None, T.sparse_lists(spark, sf, whole)))


@query(f"WITH {E3}, x AS (SELECT {EN} AS e, u AS p FROM E UNION ALL SELECT {EN}, v FROM E) SELECT DISTINCT a.e AS u, b.e AS v FROM x a JOIN x b ON a.p = b.p AND a.e < b.e", by=(['u'], ['u', 'v']), sums=lambda spark, sf: S.line_graph_sums(K.edges_of(T.sparse_lists(spark, sf, True))).select("u", "n", "checksum"))
def line_graph_edges(spark, sf, whole=False):
    return S.line_graph(T.sparse_graph(spark, sf, whole)).select("u", "v")


@query(f"WITH {E3}{U}, w AS (SELECT list_sort([b.s, a.s, b.t]) AS x FROM U a JOIN U b ON a.t = b.s AND b.t <> a.s) SELECT DISTINCT array_to_string(x, '-') AS verts FROM w")
def graph_induced_2(spark, sf):
    return names(S.connected_subsets(T.sparse_graph(spark, sf), 3))


@query(f"WITH {E3}{U}, b AS (SELECT p.v AS c, p.v FROM ({PARTS}) p UNION SELECT s, t FROM U) SELECT DISTINCT x.v || '-' || y.v || '-' || z.v AS verts FROM b x JOIN b y ON x.c = y.c AND x.v < y.v JOIN b z ON z.c = x.c AND y.v < z.v")
def khop_simplices(spark, sf):
    return names(S.neighbourhood_simplices(T.parts(spark, sf), T.sparse_graph(spark, sf), 2))


@query(f"WITH {N}{TRI} SELECT {TN} AS verts FROM T")
def vietoris_rips_triangles(spark, sf):
    return names(S.vietoris_rips(T.nations(spark, sf), T.nation_graph(spark, sf), 1).where("rank = 2").select("g", "verts"))


@query(f"WITH {N}{TRI} SELECT {EN} AS verts FROM E UNION ALL SELECT {TN} FROM T")
def eccentricity_simplices(spark, sf):
    return names(S.eccentricity_simplices(T.nations(spark, sf), T.nation_graph(spark, sf), 3))


@query(f"WITH {N}{TRI}, s AS (SELECT {TN} AS t, [a, b, c] AS m, b || '-' || c AS e FROM T UNION ALL SELECT {TN}, [a, b, c], a || '-' || c FROM T UNION ALL SELECT {TN}, [a, b, c], a || '-' || b FROM T), n AS (SELECT x.t, list_sort(list_distinct(flatten(list(y.m)))) AS m FROM s x JOIN s y ON x.e = y.e GROUP BY x.t) SELECT DISTINCT array_to_string(m, '-') AS verts FROM n")
def coface_3cells(spark, sf):
    return names(S.coface_cells(nation_cells(spark, sf, 2)))


HU = "S AS (SELECT he, count(*) AS n FROM HS GROUP BY he)"
INS = "J AS (SELECT x.he AS a, y.he AS b FROM HS x JOIN HS y ON x.v = y.v AND x.he <> y.he JOIN S p ON p.he = x.he JOIN S q ON q.he = y.he WHERE p.n < q.n GROUP BY x.he, y.he, p.n HAVING count(*) = p.n)"


@query(f"WITH {H3}, {HU}, {INS}, r1 AS (SELECT S.he, n, CASE WHEN n = 1 THEN 0 ELSE 1 END AS r FROM S), r2 AS (SELECT r1.he, greatest(r, coalesce(max(q.r0) + 1, 0)) AS r FROM r1 LEFT JOIN (SELECT J.b, r1.r AS r0 FROM J JOIN r1 ON r1.he = J.a) q ON q.b = r1.he GROUP BY r1.he, r), "
       "r3 AS (SELECT r2.he, greatest(r, coalesce(max(q.r0) + 1, 0)) AS r FROM r2 LEFT JOIN (SELECT J.b, r2.r AS r0 FROM J JOIN r2 ON r2.he = J.a) q ON q.b = r2.he GROUP BY r2.he, r) SELECT he, CAST(r AS INTEGER) AS rank FROM r3", lambda sql: None)
def universal_strict_rank(spark, sf, whole=False):
    return S.universal_strict_rank(T.small_orders(spark, sf, whole)).select("he", "rank")


@query()
def triangle_cc_cells(spark, sf):
    return names(S.triangle_cells(T.sparse_graph(spark, sf)))


@query(f"WITH {N}, p AS (SELECT CAST(n_nationkey AS VARCHAR) AS n, [CAST(n_nationkey AS BIGINT)] AS s, 0 AS d FROM nation UNION ALL SELECT {EN}, [u, v], 1 FROM E) SELECT CAST(a.d + b.d AS INTEGER) AS rank, a.n AS a, b.n AS b FROM p a, p b WHERE NOT list_has_any(a.s, b.s)")
def dcc_k2_cells(spark, sf):
    return S.configuration_cells(T.nations(spark, sf), T.nation_graph(spark, sf)).select("rank", "a", "b")


MC = "f AS (SELECT p_partkey AS v, p_retailprice AS f FROM part), z AS (SELECT min(f) - 1e-3 AS lo, (max(f) + 1e-3 - (min(f) - 1e-3)) / (10 - 9 * 0.3) AS w FROM f)"


@query(f"WITH {MC} SELECT v, CAST(k AS INTEGER) AS bin FROM f, z, range(0, 10) r(k) WHERE f >= lo + k * w * 0.7 AND f <= lo + k * w * 0.7 + w")
def mapper_cover(spark, sf):
    f = T.read(spark, sf, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("v"), F.col("p_retailprice").alias("f"))
    return S.mapper_cover(f).select("v", "bin")


@query()
def mapper_clusters(spark, sf, whole=False):
    f = T.read(spark, sf, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("v"), F.col("p_retailprice").alias("f"))
    return S.mapper_clusters(S.mapper_cover(f), T.sparse_graph(spark, sf, whole)).select("v", "bin", "cluster")


@query(f"WITH {E3}{U}, d AS (SELECT s, count(*) AS d FROM U GROUP BY s), m AS (SELECT count(*) AS m FROM E) SELECT u, E.v, round(1 - p.d * q.d / (2.0 * m) + 1e-9, 6) AS b FROM E JOIN d p ON p.s = u JOIN d q ON q.s = E.v, m")
def modularity_matrix(spark, sf, whole=False):
    return S.modularity_matrix(T.parts(spark, sf), T.sparse_graph(spark, sf, whole)).select("u", "v", near(F.col("b")).alias("b"))


@query()
def cycle_basis_cells(spark, sf):
    return names(S.fundamental_cycles(T.nations(spark, sf), T.nation_graph(spark, sf)))


@query()
def kernel_hyperedges(spark, sf):
    return S.kernel_hypergraph(T.nation_graph(spark, sf)).select("v", "he")


# --- point clouds

PD = "p AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), w AS (SELECT a.v AS a, b.v AS b, list_distance(a.x, b.x) AS d FROM p a, p b WHERE a.v <> b.v)"


@query(f"WITH {PD}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM w) SELECT a AS centre, b AS v, round(d + 1e-9, 6) AS d FROM r WHERE r <= 3")
def knn_k3_embeddings(spark, sf):
    return S.knn(T.points(spark, sf), 3).select("centre", "v", near(F.col("d")).alias("d"))


@query(f"WITH {PD} SELECT a, b, round(d + 1e-9, 6) AS d FROM w WHERE d <= 1.1")
def radius_graph_embeddings(spark, sf):
    return S.radius_graph(T.points(spark, sf), 1.1).select("a", "b", near(F.col("d")).alias("d"))


@query("WITH p AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT v AS he, x AS y FROM p WHERE v < 8) SELECT v, arg_min(he, list_distance(x, y)) AS he FROM p, s GROUP BY v")
def voronoi_assign(spark, sf):
    p = T.points(spark, sf)
    return S.voronoi(p, p.where("v < 8").select("g", "v")).select("v", "he")


@query("WITH p AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT v AS he, x AS y FROM p WHERE v < 8), b AS (SELECT v, he FROM p, s WHERE list_distance(x, y) <= 1.2) SELECT v, he FROM b UNION ALL SELECT v, v FROM p WHERE v NOT IN (SELECT v FROM b)")
def pointnet_balls(spark, sf):
    p = T.points(spark, sf)
    return S.pointnet(p, p.where("v < 8").select("g", "v"), 1.2).select("v", "he")


@query()
def farthest_points(spark, sf):
    return S.farthest_points(T.points(spark, sf), 0.02).select("v")


@query()
def random_flag_betti(spark, sf):
    nodes = T.nations(spark, sf)
    edges = S.random_flag_edges(nodes, 0.1, 2)
    return S.betti_numbers(S.clique_complex(nodes, edges, 2), 1).select("dim", "betti")


# --- splits, batching, pooling, metrics, losses

@query("WITH h AS (SELECT p_partkey, ('0x' || substr(md5('42-' || p_partkey), 1, 8))::BIGINT / 4294967296.0 AS h FROM part) SELECT p_partkey, CASE WHEN h < 0.5 THEN 'train' WHEN h < 0.75 THEN 'valid' ELSE 'test' END AS split FROM h")
def random_split(spark, sf):
    return V.random_split(T.read(spark, sf, "part"), "p_partkey")


@query("SELECT p_partkey, p_type, CAST((row_number() OVER (PARTITION BY p_type ORDER BY md5('0-' || p_partkey), p_partkey) - 1) % 5 AS INTEGER) AS fold FROM part")
def kfold(spark, sf):
    return V.k_fold(T.read(spark, sf, "part"), "p_partkey", "p_type", 5)


@query("WITH s AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT g, n, (row_number() OVER (ORDER BY g) - 1) // 8 AS batch FROM s) SELECT g, n, CAST(batch AS BIGINT) AS batch, CAST(sum(n) OVER (PARTITION BY batch ORDER BY g) - n AS BIGINT) AS \"offset\" FROM b")
def batch_offsets(spark, sf):
    return V.batch_offsets(T.read(spark, sf, "customer").select(F.col("c_nationkey").alias("g")), 8)


@query("SELECT c_nationkey, CAST(sum(CAST(c_acctbal * 100 AS BIGINT)) AS BIGINT) AS sum_x, round(avg(CAST(c_acctbal * 100 AS BIGINT)) + 1e-9, 3) AS mean_x, max(CAST(c_acctbal * 100 AS BIGINT)) AS max_x FROM customer GROUP BY c_nationkey")
def graph_pool(spark, sf):
    c = T.read(spark, sf, "customer").select("c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("x"))
    return V.pool(c, "c_nationkey", "x").withColumn("mean_x", near(F.col("mean_x"), 3))


def scored(spark, sf):
    p = T.read(spark, sf, "part")
    return p.select("p_partkey", (F.col("p_partkey") % 4).alias("label"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 5).alias("pred"), F.col("p_size").cast("double").alias("score"), (F.col("p_partkey") % 3 == 0).alias("positive"))


SC = "r AS (SELECT p_partkey % 4 AS label, (p_partkey * 7 + p_size) % 5 AS pred, CAST(p_size AS DOUBLE) AS score, p_partkey % 3 = 0 AS positive FROM part)"


@query(f"WITH {SC} SELECT label, pred, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY label, pred")
def confusion_matrix(spark, sf):
    return V.confusion(scored(spark, sf), "pred", "label")


@query(f"WITH {SC}, c AS (SELECT DISTINCT label AS c FROM r UNION SELECT pred FROM r), m AS (SELECT c, (SELECT count(*) FROM r WHERE label = c) AS s, (SELECT count(*) FROM r WHERE pred = c) AS k, (SELECT count(*) FROM r WHERE pred = c AND label = c) AS t FROM c), f AS (SELECT *, CASE WHEN k > 0 THEN t / k ELSE 0 END AS p, CASE WHEN s > 0 THEN t / s ELSE 0 END AS q FROM m), "
       "x AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f FROM f) SELECT round(sum(t) / sum(s) + 1e-9, 6) AS accuracy, round(avg(p) + 1e-9, 6) AS precision, round(avg(q) + 1e-9, 6) AS recall, round(avg(f) + 1e-9, 6) AS f1_macro, round(sum(f * s) / sum(s) + 1e-9, 6) AS f1_weighted FROM x")
def classification_report(spark, sf):
    out = V.classification_report(scored(spark, sf), "pred", "label")
    return out.select(*(near(F.col(c)).alias(c) for c in out.columns))


@query(f"WITH {SC}, k AS (SELECT positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM r) SELECT round((sum(rk) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)) + 1e-9, 6) AS auroc FROM k")
def auroc(spark, sf):
    return V.auroc(scored(spark, sf), "score", "positive").select(near(F.col("auroc")).alias("auroc"))


@query("WITH r AS (SELECT p_retailprice AS y, 900 + 10.0 * p_size AS p FROM part) SELECT round(avg(abs(p - y)) + 1e-9, 4) AS mae, round(avg((p - y) * (p - y)) + 1e-9, 3) AS mse, round(sqrt(avg((p - y) * (p - y))) + 1e-9, 4) AS rmse, round(1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) + 1e-9, 6) AS r2 FROM r")
def regression_report(spark, sf):
    out = V.regression_report(T.read(spark, sf, "part").select(F.col("p_retailprice").alias("y"), (900 + 10.0 * F.col("p_size")).alias("p")), "p", "y")
    return out.select(near(F.col("mae"), 4).alias("mae"), near(F.col("mse"), 3).alias("mse"), near(F.col("rmse"), 4).alias("rmse"), near(F.col("r2")).alias("r2"))


@query("SELECT p_partkey, round(ln(exp(p_size / 10.0) + exp(p_size / 20.0) + exp(1.0)) - CASE p_partkey % 3 WHEN 0 THEN p_size / 10.0 WHEN 1 THEN p_size / 20.0 ELSE 1.0 END + 1e-9, 6) AS loss FROM part")
def cross_entropy(spark, sf):
    p = T.read(spark, sf, "part")
    logits = F.array(F.col("p_size") / 10.0, F.col("p_size") / 20.0, F.lit(1.0))
    return p.select("p_partkey", near(V.cross_entropy(logits, (F.col("p_partkey") % 3).cast("int"))).alias("loss"))


@query("WITH r AS (SELECT p_partkey, p_size / 10.0 - 2 AS x, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 2 AS DOUBLE) END AS y, 1.0 - p_size / 25.0 AS x2, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 1.0 END AS y2 FROM part), l AS (SELECT p_partkey, greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) AS a, greatest(x2, 0) - x2 * y2 + ln(1 + exp(-abs(x2))) AS b FROM r) SELECT p_partkey, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END + 1e-9, 6) AS loss FROM l")
def bce_masked(spark, sf):
    p = T.read(spark, sf, "part")
    k = F.col("p_partkey")
    logits = F.array(F.col("p_size") / 10.0 - 2, 1.0 - F.col("p_size") / 25.0)
    targets = F.array(F.when(k % 5 != 0, (k % 2).cast("double")), F.when(k % 7 != 0, F.lit(1.0)))
    return p.select("p_partkey", near(V.bce_masked(logits, targets)).alias("loss"))


@query("SELECT user_id AS run, event_id AS epoch, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r = 1")
def best_epoch(spark, sf):
    e = T.read(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), "value")
    return V.best_epoch(e, "run", "value")


@query("SELECT event_type, round(avg(value) + 1e-9, 6) AS mean_s, round(stddev_pop(value) + 1e-9, 6) AS std_s FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r > 10 GROUP BY event_type")
def timer_stats(spark, sf):
    out = V.timer_stats(T.read(spark, sf, "events"), "event_type", "event_id", "value")
    return out.select("event_type", near(F.col("mean_s")).alias("mean_s"), near(F.col("std_s")).alias("std_s"))


# --- forward passes, ETL, streams


@query(f"WITH {E3}{U}, d AS (SELECT p.v, count(U.s) + 1 AS d FROM ({PARTS}) p LEFT JOIN U ON U.s = p.v GROUP BY p.v), a AS (SELECT s, t FROM U UNION ALL SELECT v, v FROM d), {PX} SELECT s AS v, round(sum(x.x / sqrt(p.d * q.d)) + 1e-9, 6) AS x FROM a JOIN d p ON p.v = s JOIN d q ON q.v = t JOIN x ON x.v = t GROUP BY s")
def gcn_propagation(spark, sf, whole=False):
    op = M.normalised_adjacency(T.parts(spark, sf), T.sparse_graph(spark, sf, whole))
    return M.propagate(op, part_sizes(spark, sf)).select(F.col("id").alias("v"), near(F.col("x")).alias("x"))


@query(f"WITH {H}, {PX}, m AS (SELECT he, avg(x) AS m FROM H JOIN x USING (v) GROUP BY he), b AS (SELECT v, avg(m) AS m FROM H JOIN m USING (he) GROUP BY v) SELECT x.v, round(0.5 * coalesce(m, 0) + 0.5 * x + 1e-9, 6) AS x FROM x LEFT JOIN b USING (v)")
def hypergraph_mean_pass(spark, sf):
    return M.hypergraph_mean_pass(T.order_hypergraph(spark, sf), part_sizes(spark, sf)).select(F.col("id").alias("v"), near(F.col("x")).alias("x"))


@query(f"WITH {E3}{TRI}, m AS (SELECT a AS v FROM T UNION ALL SELECT b FROM T UNION ALL SELECT c FROM T) SELECT CAST(v AS VARCHAR) AS v, CAST(2 * count(*) AS BIGINT) AS x FROM m GROUP BY v")
def signal_down(spark, sf, whole=False):
    if whole:
        # A signal of 1 on every triangle: twice their number at a vertex.
        found = K.triangle_counts(T.sparse_lists(spark, sf, True))
        return found.select(F.col("v").cast("string").alias("v"), (2 * F.col("n")).alias("x"))
    cells = sparse_cells(spark, sf, whole=whole)
    return M.signal_down_simplices(cells.withColumn("x", F.lit(1)), 2).select(F.col("id").cast("string").alias("v"), F.col("x").cast("long").alias("x"))


@query("WITH s AS (SELECT c_custkey AS f, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS d, 1000.0 + c_custkey AS p FROM customer), m AS (SELECT avg(d) AS m FROM s), c AS (SELECT f, coalesce(d, m) AS d, p FROM s, m), l AS (SELECT o_custkey AS a, (o_custkey * 7 + o_orderkey) % 2000 AS b FROM orders), k AS (SELECT a, b FROM l WHERE a IN (SELECT f FROM c) AND b IN (SELECT f FROM c)), o AS (SELECT a AS f FROM k INTERSECT SELECT b FROM k), j AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM k WHERE a <> b AND a IN (SELECT f FROM o) AND b IN (SELECT f FROM o)), q AS (SELECT u AS f FROM j UNION SELECT v FROM j) "
       "SELECT f AS fips, CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS v, round((d - p) / (d + p) + 1e-9, 6) AS y FROM c WHERE f IN (SELECT f FROM q)")
def county_etl(spark, sf):
    c = T.read(spark, sf, "customer")
    text = F.when(F.col("c_custkey") % 11 == 0, "n/a").otherwise(F.regexp_replace(F.col("c_acctbal").cast("string"), r"\.", ","))
    stats = c.select(F.col("c_custkey").alias("FIPS"), text.alias("DEM"), (1000.0 + F.col("c_custkey")).cast("string").alias("GOP"))
    o = T.read(spark, sf, "orders")
    links = o.select(F.col("o_custkey").alias("SRC"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 2000).alias("DST"))
    nodes, _ = R.county_etl(stats, links)
    return nodes.select(F.col("FIPS").alias("fips"), "v", near(F.col("y")).alias("y"))


@query("SELECT date_trunc('hour', ts) AS start, user_id, CAST(count(*) AS BIGINT) AS degree, round(sum(value) + 1e-9, 4) AS total FROM events GROUP BY 1, 2")
def windowed_degrees(spark, sf):
    out = D.windowed_degrees(T.read(spark, sf, "events"))
    return out.withColumn("total", near(F.col("total"), 4))


@query()
def laplacian_pe(spark, sf):
    out = P.laplacian_pe(T.nations(spark, sf), T.nation_graph(spark, sf), 4)
    return out.select("v", F.array_join(F.transform("pe", lambda e: F.round(F.abs(e), 4).cast("string")), ",").alias("pe"))



# --- seeded and spectral liftings, further forward passes


LINES = E3.replace(" E AS (", " EE AS MATERIALIZED (") + ", X AS MATERIALIZED (SELECT (u || '-' || v) AS e, u AS p FROM EE UNION ALL SELECT (u || '-' || v), v FROM EE), E AS MATERIALIZED (SELECT DISTINCT a.e AS u, b.e AS v FROM X a JOIN X b ON a.p = b.p AND a.e < b.e)"


@query(f"WITH {LINES}{FAST} SELECT a || '-' || b || '-' || c AS verts FROM T")
def line_lifting_triangles(spark, sf):
    return names(Z.line_simplices(T.sparse_graph(spark, sf), 3))


@query(f"WITH {E3}, {PX} SELECT (u || '-' || E.v) AS id, round((p.x + q.x) / 2.0 + 1e-9, 6) AS x FROM E JOIN x p ON p.v = E.u JOIN x q ON q.v = E.v")
def line_lifting_features(spark, sf, whole=False):
    return Z.line_features(T.sparse_graph(spark, sf, whole), part_sizes(spark, sf)).select("id", near(F.col("x")).alias("x"))


def nation_points(spark, sf):
    return T.nations(spark, sf).select("g", "v", F.array(F.col("v").cast("double")).alias("x"))


@query("WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS v, n_regionkey AS r FROM nation), k AS (SELECT a.v, b.v AS he, row_number() OVER (PARTITION BY a.v ORDER BY abs(a.v - b.v), b.v) AS i FROM n a JOIN n b USING (r)) SELECT v, he FROM k WHERE i <= 3")
def modularity_hyperedges(spark, sf):
    return Z.modularity_hypergraph(nation_points(spark, sf), T.nation_graph(spark, sf), 5, 3).select("v", "he")


MN = "f AS (SELECT CAST(n_nationkey AS BIGINT) AS v, n_regionkey AS r, CAST(n_nationkey AS DOUBLE) AS f FROM nation), z AS (SELECT min(f) - 1e-3 AS lo, (max(f) + 1e-3 - (min(f) - 1e-3)) / (4 - 3 * 0.3) AS w FROM f)"


@query(f"WITH {N}{U}, {MN}, c AS (SELECT v, r, k FROM f, z, range(0, 4) q(k) WHERE f >= lo + k * w * 0.7 AND f <= lo + k * w * 0.7 + w) SELECT s AS v, 'e:' || s || '-' || t AS he FROM U UNION ALL SELECT t, 'e:' || s || '-' || t FROM U UNION ALL SELECT v, 'c:' || k || ':' || min(v) OVER (PARTITION BY k, r) FROM c")
def mapper_hyperedges(spark, sf):
    f = Z.scalar_filter(nation_points(spark, sf), kind="feature_sum")
    return Z.mapper_hypergraph(f, T.nation_graph(spark, sf), 4).select("v", "he")


@query("SELECT vec_id AS v, round(list_sum(CAST(embedding AS DOUBLE[])) + 1e-9, 6) AS f FROM embeddings")
def mapper_filter_sum(spark, sf):
    return Z.scalar_filter(T.points(spark, sf), kind="feature_sum").select("v", near(F.col("f")).alias("f"))


@query()
def mapper_filter_svd(spark, sf):
    return Z.scalar_filter(T.points(spark, sf), kind="svd").select("v", near(F.col("f")).alias("f"))


@query()
def mapper_filter_pca(spark, sf):
    return Z.scalar_filter(T.points(spark, sf), kind="feature_pca").select("v", near(F.col("f")).alias("f"))


@query()
def mogmst_hyperedges(spark, sf):
    return Z.mixture_tree(T.points(spark, sf), 2, 4).select("v", "he")


@query()
def dnd_simplices(spark, sf):
    return names(Z.dice_simplices(T.nations(spark, sf), T.nation_graph(spark, sf), 2))


@query()
def latent_clique_cells(spark, sf):
    return names(Z.latent_clique_complex(T.nations(spark, sf), T.nation_graph(spark, sf), 2).select("g", "rank", "verts"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS v, CAST(0.2 AS DOUBLE) AS x FROM nation")
def eigenvector_centrality(spark, sf):
    return G.eigenvector(T.nations(spark, sf), T.nation_graph(spark, sf)).select("v", near(F.col("x")).alias("x"))


@query(f"WITH {MH} SELECT y, round(avg(s) + 1e-9, 6) AS p FROM (SELECT v, y, sum(p) / any_value(m) AS s FROM H JOIN y USING (v) JOIN dg USING (v) JOIN e0 USING (he, y) WHERE m > 1 GROUP BY v, y) GROUP BY y")
def class_homophily(spark, sf):
    h, labels = T.order_hypergraph(spark, sf), part_types(spark, sf)
    return P.class_homophily(h, labels, P.message_passing_homophily(h, labels, 0)).select("y", near(F.col("p")).alias("p"))


@query(f"WITH {E3}{U}, d AS (SELECT s, count(*) AS d FROM U GROUP BY s) SELECT CAST(s AS VARCHAR) AS i, CAST(s AS VARCHAR) AS j, CAST(0.5 AS DOUBLE) AS val FROM d UNION ALL SELECT CAST(U.s AS VARCHAR), CAST(U.t AS VARCHAR), round(0.5 / sqrt(p.d * q.d) + 1e-9, 6) FROM U JOIN d p ON p.s = U.s JOIN d q ON q.s = U.t")
def normalised_laplacian_0(spark, sf, whole=False):
    out = M.normalised_laplacian(C.up_laplacian(sparse_cells(spark, sf, 1, whole=whole), 0))
    return out.select(F.col("row").alias("i"), F.col("col").alias("j"), near(F.col("val")).alias("val"))


CN = "s AS (SELECT c_nationkey AS g, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1)"


def customer_rows(spark, sf):
    return T.read(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.array("c_acctbal").alias("x"))


@query(f"WITH {CN} SELECT c_custkey AS id, round((c_acctbal - m) / sqrt(v + 1e-5) + 1e-9, 5) AS x FROM customer JOIN s ON g = c_nationkey")
def graph_norm(spark, sf):
    return M.graph_norm(customer_rows(spark, sf)).select("id", near(F.element_at("x", 1), 5).alias("x"))


@query(f"WITH {CN}, r AS (SELECT c_custkey AS id, (c_acctbal - m) / sqrt(v + 1e-5) AS x FROM customer JOIN s ON g = c_nationkey) SELECT id, round(greatest(2 * x + 0.5, 0) + 1e-9, 5) AS x_1, round(greatest(0.25 - x, 0) + 1e-9, 5) AS x_2 FROM r")
def cell_encoder(spark, sf):
    out = M.encode(customer_rows(spark, sf), [[2.0], [-1.0]], [0.5, 0.25])
    return out.select("id", near(F.element_at("x", 1), 5).alias("x_1"), near(F.element_at("x", 2), 5).alias("x_2"))


@query("SELECT n_regionkey AS g, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS x FROM nation GROUP BY 1")
def flat_encoder(spark, sf):
    n = T.read(spark, sf, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("id"), F.array("n_nationkey").alias("x"))
    return M.flatten_graphs(n).select("g", F.array_join(F.col("x").cast("array<string>"), ",").alias("x"))


@query(f"WITH {N}{TRI} SELECT '0:' || x AS src, '1:' || {EN} AS dst FROM E, unnest([u, v]) q(x) UNION ALL SELECT '1:' || q.e, '2:' || {TN} FROM T, unnest([a || '-' || b, a || '-' || c, b || '-' || c]) q(e)")
def hasse_graph(spark, sf):
    return M.hasse_graph(nation_cells(spark, sf, 2), ["up_incidence-0", "up_incidence-1"]).select("src", "dst")


@query(f"WITH {N}{B1}, c AS (SELECT DISTINCT x.j AS i, y.j AS j FROM B1 x JOIN B1 y ON x.i = y.i AND x.j <> y.j), x AS (SELECT {EN} AS id, u - 10 AS x FROM E), p AS (SELECT id, CAST(x AS DOUBLE) AS x FROM x UNION ALL SELECT c.i, 0.5 * x.x FROM c JOIN x ON x.id = c.j UNION ALL SELECT c.i, 0.25 * x.x FROM c JOIN x ON x.id = c.j) SELECT id, round(greatest(sum(x), 0) + 1e-9, 6) AS x FROM p GROUP BY id")
def edge_cell_layer(spark, sf):
    cells = nation_cells(spark, sf, 2)
    x = cells.where("rank = 1").select("g", C.name("verts").alias("id"), (F.element_at("verts", 1) - 10).cast("double").alias("x"))
    # Edges of a complete graph that share a vertex lie in one triangle: both operators have the same pattern.
    out = M.edge_cell_layer(x, C.coadjacency(cells, 1), C.adjacency(cells, 1), 1.0, 0.5, 0.25)
    return out.select("id", near(F.col("x")).alias("x"))


@query()
def dgm_edges(spark, sf):
    return M.sampled_edges(T.points(spark, sf), 5, 0.0).select("a", "b", near(F.col("logprob")).alias("logprob"))


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS BIGINT) AS batch FROM part")
def batch_numbers(spark, sf):
    return V.batch_numbers(T.read(spark, sf, "part"), "p_partkey", 64)


# --- layers with given weights

FX = "f AS (SELECT p_partkey AS v, p_size / 50.0 AS a, 1.0 - p_size / 50.0 AS b FROM part)"


def part_pairs(spark, sf):
    return part_sizes(spark, sf).select("g", "id", F.array(F.col("x") / 50.0, 1.0 - F.col("x") / 50.0).alias("x"))


def pairs_out(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("v"), near(F.col("x")[0]).alias("a"), near(F.col("x")[1]).alias("b"))


def neighbour_sql(agg: str) -> str:
    return f"WITH {E3}{U}, {FX}, m AS (SELECT U.t AS v, {agg}(f.a) AS a, {agg}(f.b) AS b FROM U JOIN f ON f.v = U.s GROUP BY U.t) SELECT f.v, round(f.a + coalesce(m.a, 0) + 1e-9, 6) AS a, round(f.b + coalesce(m.b, 0) + 1e-9, 6) AS b FROM f LEFT JOIN m ON m.v = f.v"


def neighbours(spark, sf, how, whole=False):
    return pairs_out(B.neighbour_pass(G.to_undirected(T.sparse_graph(spark, sf, whole)), part_pairs(spark, sf), how))


@query(neighbour_sql("sum"))
def neighbour_sum(spark, sf, whole=False):
    return neighbours(spark, sf, "sum", whole)


@query(neighbour_sql("avg"))
def neighbour_mean(spark, sf, whole=False):
    return neighbours(spark, sf, "mean", whole)


@query(neighbour_sql("max"))
def neighbour_max(spark, sf, whole=False):
    return neighbours(spark, sf, "max", whole)


@query(f"WITH {E3}{U}, {FX}, r AS (SELECT s, t FROM U UNION ALL SELECT v, v FROM f), z AS (SELECT r.t, p.a, p.b, 0.5 * p.a + p.b - 2.0 * q.a + 0.5 * q.b AS s FROM r JOIN f p ON p.v = r.s JOIN f q ON q.v = r.t), "
       "w AS (SELECT t, a, b, exp(CASE WHEN s > 0 THEN s ELSE 0.2 * s END) AS w FROM z) SELECT t AS v, round(sum(w * a) / sum(w) + 1e-9, 6) AS a, round(sum(w * b) / sum(w) + 1e-9, 6) AS b FROM w GROUP BY t")
def attention_pass(spark, sf, whole=False):
    return pairs_out(B.attention_pass(G.to_undirected(T.sparse_graph(spark, sf, whole)), part_pairs(spark, sf), [0.5, 1.0], [-2.0, 0.5]))


WS = "exp(CASE WHEN 2.0 * a - b > 0 THEN 2.0 * a - b ELSE 0.2 * (2.0 * a - b) END)"


@query(f"WITH {H}, {FX}, w AS (SELECT *, {WS} AS w FROM f), e AS (SELECT he, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b FROM H JOIN w USING (v) GROUP BY he), y AS (SELECT *, {WS} AS w FROM e) SELECT v, round(sum(w * a) / sum(w) + 1e-9, 6) AS a, round(sum(w * b) / sum(w) + 1e-9, 6) AS b FROM H JOIN y USING (he) GROUP BY v")
def hypergraph_attention(spark, sf):
    return pairs_out(B.hypergraph_attention(T.order_hypergraph(spark, sf), part_pairs(spark, sf), [2.0, -1.0]))


@query("WITH r AS (SELECT c_nationkey AS g, c_custkey AS v, c_acctbal / 1000.0 AS a, (c_custkey % 7) / 7.0 - 0.5 AS b FROM customer), p AS (SELECT *, CASE WHEN a > 0 THEN a + 1 ELSE exp(a) END AS fa, CASE WHEN b > 0 THEN b + 1 ELSE exp(b) END AS fb FROM r), "
       "s AS (SELECT g, sum(fa * a) AS aa, sum(fa * b) AS ab, sum(fb * a) AS ba, sum(fb * b) AS bb, sum(fa) AS na, sum(fb) AS nb FROM p GROUP BY g) SELECT v, round((fa * aa + fb * ba) / (fa * na + fb * nb) + 1e-9, 6) AS a, round((fa * ab + fb * bb) / (fa * na + fb * nb) + 1e-9, 6) AS b FROM p JOIN s USING (g)")
def linear_attention(spark, sf):
    c = T.read(spark, sf, "customer")
    rows = c.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000.0, F.col("c_custkey") % 7 / 7.0 - 0.5).alias("x"))
    return pairs_out(B.linear_attention(rows))


def restriction_maps(spark, sf, whole=False):
    one = F.lit(1.0)
    u, v = F.col("u"), F.col("v")
    return T.sparse_graph(spark, sf, whole).select("g", "u", "v", F.array(one + (u + v) % 3, one).alias("fu"), F.array(one, one - 2 * (u * v % 2)).alias("fv"))


@query(f"WITH {E3}, m AS (SELECT u, v, 0 AS k, 1.0 + (u + v) % 3 AS p, 1.0 AS q FROM E UNION ALL SELECT u, v, 1, 1.0, 1.0 - 2 * (u * v % 2) FROM E), l AS (SELECT k, u AS i, u AS j, p * p AS x FROM m UNION ALL SELECT k, v, v, q * q FROM m UNION ALL SELECT k, u, v, -p * q FROM m UNION ALL SELECT k, v, u, -p * q FROM m), "
       "w AS (SELECT k, i, j, CAST(sum(x) AS DOUBLE) AS x FROM l GROUP BY k, i, j), d AS (SELECT k, i, x FROM w WHERE i = j) SELECT w.k AS stalk, w.i, w.j, round(w.x / sqrt(p.x * q.x) + 1e-9, 6) AS val FROM w JOIN d p ON p.k = w.k AND p.i = w.i JOIN d q ON q.k = w.k AND q.i = w.j")
def sheaf_laplacian(spark, sf, whole=False):
    return B.sheaf_laplacian(restriction_maps(spark, sf, whole)).select("stalk", F.col("row").alias("i"), F.col("col").alias("j"), near(F.col("val")).alias("val"))


@query(f"WITH {E3}{U}, {PX}, l AS (SELECT s AS i, s AS j, CAST(count(*) AS DOUBLE) AS a FROM U GROUP BY s UNION ALL SELECT s, t, -1.0 FROM U), y AS (SELECT i AS v, sum(a * x) AS x FROM l JOIN x ON x.v = l.j GROUP BY i), z AS (SELECT i AS v, sum(a * x) AS x FROM l JOIN y ON y.v = l.j GROUP BY i) "
       "SELECT CAST(x.v AS VARCHAR) AS v, round(x.x + 0.5 * coalesce(y.x, 0) + 0.25 * coalesce(z.x, 0) + 1e-9, 6) AS x FROM x LEFT JOIN y ON y.v = x.v LEFT JOIN z ON z.v = x.v")
def laplacian_polynomial(spark, sf, whole=False):
    x = part_sizes(spark, sf).withColumn("id", F.col("id").cast("string"))
    return B.polynomial(C.up_laplacian(sparse_cells(spark, sf, 1, whole=whole), 0), x, [1, 0.5, 0.25]).select(F.col("id").alias("v"), near(F.col("x")).alias("x"))


@query(f"WITH {N}{TRI}{B1}{B2}, ld AS (SELECT a.j AS i, b.j, sum(a.s * b.s) AS s FROM B1 a JOIN B1 b ON a.i = b.i GROUP BY 1, 2), lu AS (SELECT a.i, b.i AS j, sum(a.s * b.s) AS s FROM B2 a JOIN B2 b ON a.j = b.j GROUP BY 1, 2), "
       "x AS (SELECT DISTINCT j AS i, 1.0 AS x FROM B1), p AS (SELECT j AS i, sum(s * CAST(i AS DOUBLE)) AS x FROM B1 GROUP BY j), q AS (SELECT i, sum(s) AS x FROM B2 GROUP BY i), a AS (SELECT * FROM x UNION ALL SELECT * FROM p UNION ALL SELECT * FROM q "
       "UNION ALL SELECT ld.i, 0.5 * ld.s * x.x FROM ld JOIN x ON x.i = ld.j UNION ALL SELECT lu.i, 0.5 * lu.s * x.x FROM lu JOIN x ON x.i = lu.j UNION ALL SELECT ld.i, 0.5 * ld.s * p.x FROM ld JOIN p ON p.i = ld.j UNION ALL SELECT lu.i, 0.5 * lu.s * q.x FROM lu JOIN q ON q.i = lu.j) SELECT i AS id, round(sum(x) + 1e-9, 6) AS x FROM a GROUP BY i")
def simplicial_layer_1(spark, sf):
    cells = nation_cells(spark, sf, 2)
    ones = cells.select("g", "rank", C.name("verts").alias("id"), F.lit(1.0).alias("x"))
    x = {0: cells.where("rank = 0").select("g", C.name("verts").alias("id"), F.element_at("verts", 1).cast("double").alias("x"))}
    x |= {r: ones.where(f"rank = {r}").select("g", "id", "x") for r in (1, 2)}
    b = {r: C.incidence(cells, r) for r in (1, 2)}
    out = B.simplicial_layer(x, b, {r: C.down_laplacian(cells, r) for r in (1, 2)}, {r: C.up_laplacian(cells, r) for r in (0, 1)}, [1.0, 0.5])
    return out[1].select("id", near(F.col("x")).alias("x"))


@query(f"WITH {H}, {PX}, d AS (SELECT v, count(*) AS d FROM H GROUP BY v), m AS (SELECT he, avg(x) AS m, avg(d) AS e FROM H JOIN d USING (v) JOIN x USING (v) GROUP BY he) SELECT v, round(sum(m / sqrt(e)) / sqrt(any_value(d)) + 1e-9, 6) AS x FROM H JOIN m USING (he) JOIN d USING (v) GROUP BY v")
def unified_hypergraph_pass(spark, sf):
    return B.unified_hypergraph_pass(T.order_hypergraph(spark, sf), part_sizes(spark, sf)).select(F.col("id").alias("v"), near(F.col("x")).alias("x"))


@query("WITH h AS (SELECT p_partkey, ('0x' || substr(md5('42-' || p_partkey), 1, 8))::BIGINT / 4294967296.0 AS h FROM part) SELECT p_partkey, CAST(h < 0.5 AS BIGINT) AS train_mask, CAST(h >= 0.5 AND h < 0.75 AS BIGINT) AS val_mask, CAST(h >= 0.75 AS BIGINT) AS test_mask FROM h")
def split_masks(spark, sf):
    parts = T.read(spark, sf, "part").select("p_partkey")
    return V.split_masks(parts, V.random_split(parts, "p_partkey"), "p_partkey")


@query("WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS BIGINT) AS v FROM nation), a AS (SELECT v AS s, v * 3 % 25 AS t FROM n UNION SELECT v, (v * v + 1) % 25 FROM n), r AS (SELECT v AS s, v AS t FROM n UNION SELECT r.s, a.t FROM r JOIN a ON a.s = r.t) "
       "SELECT x.s AS v, min(x.t) AS component FROM r x JOIN r y ON y.s = x.t AND y.t = x.s GROUP BY x.s")
def strong_components(spark, sf):
    v = F.col("v")
    nodes = T.nations(spark, sf).select(F.lit(0).alias("g"), v.cast("long").alias("v"))
    arcs = nodes.select("g", v.alias("src"), F.explode(F.array(v * 3 % 25, (v * v + 1) % 25)).alias("dst"))
    return G.strong_components(nodes, arcs).select("v", "component")


@query("WITH p AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT v, list_transform(x, lambda e: e / (greatest(sqrt(list_sum(list_transform(x, lambda q: q * q))), 1.0) * 1.01)) AS x FROM p), m AS (SELECT v, x, list_sum(list_transform(x, lambda q: q * q)) AS s FROM n), "
       "w AS (SELECT a.v AS a, b.v AS b, 1e-6 + 1 + 2 * power(list_distance(a.x, b.x), 2) / ((1 - a.s) * (1 - b.s)) AS c FROM m a JOIN m b ON a.v <> b.v), d AS (SELECT a, b, ln(c + sqrt(c * c - 1)) AS d FROM w) SELECT a AS v, round(min(d) + 1e-9, 5) AS least, round(max(d) + 1e-9, 5) AS most FROM d GROUP BY a")
def hyperbolic_distances(spark, sf):
    d = S.hyperbolic_extremes(T.points(spark, sf))
    return d.select("v", near(F.col("least"), 5).alias("least"), near(F.col("most"), 5).alias("most"))


from cellweave.plans import registry_tables  # noqa: E402, F401
