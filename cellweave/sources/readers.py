"""Readers of the file formats that datasets come in, and the small built-in datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators.connectivity import closure
from cellweave.operators.features import positions_as_features
from cellweave.operators.graph import canonical

#: The built-in example graphs, as canonical edges.
MANUAL_EDGES = [(0, 1), (0, 2), (0, 4), (0, 7), (1, 2), (1, 4), (2, 3), (2, 4), (2, 5), (2, 7), (3, 6), (5, 6), (5, 7)]
MANUAL_X = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0]
MANUAL_Y = [0, 1, 1, 1, 0, 0, 0, 0]
NAMES = ["Klein bottle", "", "RP^2", "T^2", "S^2", "S^3", "S^2 twist S^1", "S^2 x S^1"]


def graph_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Parquet datasets of one or many graphs: nodes and edges keyed by g, and labels and splits where they exist."""
    out = {name: spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "edges")}
    for name in ("labels", "splits"):
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def manual_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, v, x, y) and edges (g, u, v) of the built-in eight-node graph."""
    nodes = spark.createDataFrame([(0, i, [x], y) for i, (x, y) in enumerate(zip(MANUAL_X, MANUAL_Y, strict=True))], "g long, v long, x array<double>, y int")
    return nodes, spark.createDataFrame([(0, u, v) for u, v in MANUAL_EDGES], "g long, u long, v long")


def county_etl(stats: DataFrame, links: DataFrame, target: str = "Election") -> tuple[DataFrame, DataFrame]:
    """Clean ``stats(FIPS, DEM, GOP, ...)`` of text numbers and ``links(SRC, DST)``.

    Decimal commas become points; what is no number is imputed by its column's mean; rows without an
    id go. Links stay between known ids, counties stay that occur on both ends; loops go, directions
    merge, ids become dense, and Election = (DEM - GOP) / (DEM + GOP) replaces the two columns.
    Returns nodes (v, y, x...) and edges (g, u, v).
    """
    values = [c for c in stats.columns if c != "FIPS"]
    number = lambda c: F.expr(f"try_cast(replace(cast(`{c}` as string), ',', '.') as double)")
    clean = stats.select(F.expr("try_cast(FIPS as bigint)").alias("FIPS"), *(number(c).alias(c) for c in values))
    means = clean.agg(*(F.avg(c).alias(f"{c}_mean") for c in values))
    clean = clean.crossJoin(F.broadcast(means)).select("FIPS", *(F.coalesce(c, f"{c}_mean").alias(c) for c in values)).na.drop()  # one row of means
    ids = clean.select("FIPS").distinct()
    links = links.join(ids.withColumnRenamed("FIPS", "SRC"), "SRC", "left_semi").join(ids.withColumnRenamed("FIPS", "DST"), "DST", "left_semi")
    both = links.select(F.col("SRC").alias("FIPS")).distinct().join(links.select(F.col("DST").alias("FIPS")), "FIPS", "left_semi")
    links = links.join(both.withColumnRenamed("FIPS", "SRC"), "SRC", "left_semi").join(both.withColumnRenamed("FIPS", "DST"), "DST", "left_semi")
    edges = canonical(links.select(F.lit(0).alias("g"), F.col("SRC").alias("src"), F.col("DST").alias("dst")))
    used = edges.select(F.explode(F.array("u", "v")).alias("FIPS")).distinct()
    kept = clean.join(used, "FIPS", "left_semi")
    dense = kept.select("FIPS").distinct().withColumn("v", F.row_number().over(Window.orderBy("FIPS")) - 1)
    election = ((F.col("DEM") - F.col("GOP")) / (F.col("DEM") + F.col("GOP"))).alias("Election")
    nodes = kept.join(dense, "FIPS").select("FIPS", "v", election, *[c for c in values if c not in ("DEM", "GOP")])
    left = edges.join(dense.select(F.col("FIPS").alias("u"), F.col("v").alias("i")), "u").join(dense.select(F.col("FIPS").alias("v"), F.col("v").alias("j")), "v")
    features = [c for c in nodes.columns if c not in ("FIPS", "v", target)]
    return nodes.select("FIPS", "v", F.col(target).alias("y"), *features), left.select("g", F.col("i").alias("u"), F.col("j").alias("v"))


def read_counties(spark: SparkSession, folder: str, year: int, target: str = "Election") -> tuple[DataFrame, DataFrame]:
    stats = spark.read.csv(f"{folder}/county_stats_{year}.csv", header=True, encoding="ISO-8859-1")
    return county_etl(stats, spark.read.csv(f"{folder}/county_graph.csv", header=True, schema="SRC long, DST long"), target)


def citation_hypergraph(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, he): ``members(he, nodes array)`` exploded and merged, with a hyperedge of its own for every isolated node."""
    pairs = members.select("he", F.explode("nodes").alias("v")).select("v", "he").distinct()
    top = pairs.agg(F.coalesce(F.max("he"), F.lit(-1)).alias("top"))
    alone = nodes.select("v").join(pairs, "v", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("v")))
    return pairs.union(alone.crossJoin(F.broadcast(top)).select("v", F.col("top") + F.col("k")))  # one row


def read_content_hypergraph(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``{name}.content`` (id, features..., label) and ``{name}.edges`` (node id, hyperedge id): nodes (v, id, x, y from 0) and (v, he)."""
    parts = spark.read.text(f"{folder}/{name}.content").where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = parts.select(F.element_at("p", 1).alias("id"), F.expr("transform(slice(p, 2, size(p) - 2), e -> cast(e as double))").alias("x"), F.element_at("p", -1).cast("int").alias("y"))
    dense = rows.withColumn("v", F.row_number().over(Window.orderBy(F.expr("try_cast(id as bigint)"), "id")) - 1)
    nodes = dense.select("v", "id", "x", (F.col("y") - F.min("y").over(Window.partitionBy())).alias("y"))
    pairs = spark.read.text(f"{folder}/{name}.edges").where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    pairs = pairs.select(F.element_at("p", 1).alias("id"), F.element_at("p", 2).alias("edge"))
    edges = pairs.select("edge").distinct().withColumn("he", F.row_number().over(Window.orderBy(F.expr("try_cast(edge as bigint)"), "edge")) - 1)
    return nodes, pairs.join(dense.select("id", "v"), "id").join(edges, "edge").select("v", "he").distinct()


def read_manifolds(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Triangulations from a JSON array: labels (g, ...) and cells (g, rank, verts) closed downwards; ``most`` keeps that many by position."""
    raw = spark.read.json(path, multiLine=True)
    raw = raw.withColumn("g", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long") - 1)
    if most is not None:
        raw = raw.where(F.col("g") < most)
    tops = raw.select("g", F.explode("triangulation").alias("verts")).select("g", F.expr("transform(verts, v -> cast(v as bigint))").alias("verts"))
    labels = raw.drop("triangulation")
    if "name" in labels.columns:
        labels = labels.withColumn("name_index", F.array_position(F.array(*map(F.lit, NAMES)), F.coalesce("name", F.lit(""))) - 1)
    return labels, closure(tops, 4)


def one_skeleton(cells: DataFrame) -> DataFrame:
    """A complex as a graph: (g, u, v)."""
    return cells.where("rank = 1").select("g", F.element_at("verts", 1).alias("u"), F.element_at("verts", 2).alias("v"))


def point_clouds(spark: SparkSession, folder: str, parts: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """Point clouds (g, v, x, y, part) from Parquet tables of points, the parts one after another, positions as features."""
    out = None
    for part in parts:
        points = positions_as_features(spark.read.parquet(f"{folder}/{part}")).withColumn("part", F.lit(part))
        out = points if out is None else out.unionByName(points)
    return out
