"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructType

from cellweave.storage import materialise, release

MAX_ROUNDS = 64
#: So many contracted edges, counted first, are settled by one task instead of further rounds.
SMALL = 200_000


def _ordered(kind) -> bool:
    """Whether values order alike in Python: numbers and texts, and structs of them."""
    return all(_ordered(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else isinstance(kind, (IntegralType, StringType))


def _settle(edges: DataFrame) -> DataFrame:
    """(v, m): every node of a few edges with the least node that it reaches, by union-find in one task."""
    of = edges.schema["a"].dataType
    kind, names = of.simpleString(), of.fieldNames() if isinstance(of, StructType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while (p := root.setdefault(x, x)) != x:
                root[x] = root[p]
                x = p
            return x

        # Structs order by their fields, as tuples do.
        read = (lambda column: [tuple(x.values()) for x in column.to_pylist()]) if names else (lambda column: column.to_pylist())
        back = (lambda keys: [dict(zip(names, x, strict=True)) for x in keys]) if names else (lambda keys: keys)
        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            for a, b in zip(read(batch.column(0)), read(batch.column(1)), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = list(root)
        for k in range(0, len(nodes), 10_000):
            part = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(back(x), types) for x in (part, [find(x) for x in part])], names=["v", "m"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"v {kind}, m {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; component is the smallest reachable node.

    Each round maps a node to the one of its closed neighbourhood that comes first in an order drawn
    anew for the round, and contracts the edges along that map. So stars vanish, and a path shrinks by
    a share in each round whatever its ids are (by ids, a path of ascending ids would only move along).
    Hubs only meet partial ``min`` aggregates and joins whose large side adaptive execution can split.
    Null endpoints and self-loops link nothing; repeated edges count once; no edges: no rows.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    left = materialise(left, "cc-edges")
    labels = None
    plain = _ordered(left.schema["a"].dataType) and left.schema["a"].dataType.simpleString() == left.schema["b"].dataType.simpleString()
    for turn in range(MAX_ROUNDS):
        n = left.count()
        if not n:
            break
        if plain and n <= SMALL:
            near = materialise(_settle(left), "cc-map")
            if labels is not None:
                near = materialise(labels.join(near.select(F.col("v").alias("m"), F.col("m").alias("mm")), "m", "left").select("v", F.coalesce("mm", "m").alias("m")), "cc-labels")
            labels = near
            break
        both = left.union(left.select("b", "a").toDF("a", "b"))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("m"))  # noqa: B023, E731
        near = both.groupBy(F.col("a").alias("v")).agg(F.min(drawn("b")).alias("first"))
        near = materialise(near.select("v", F.least("first", drawn("v"))["m"].alias("m")), "cc-near")
        # The map may chain (v -> m(v) -> m(m(v))); one jump shortens the chain.
        jump = near.join(near.select(F.col("v").alias("m"), F.col("m").alias("mm")), "m", "left").select("v", F.coalesce("mm", "m").alias("m"))
        first, near = near, materialise(jump, "cc-map")
        release(first)
        if labels is None:
            labels = near
        else:
            old = labels
            labels = labels.join(near.select(F.col("v").alias("m"), F.col("m").alias("mm")), "m", "left").select("v", F.coalesce("mm", "m").alias("m"))
            labels = materialise(labels, "cc-labels")
            release(old)
        step = left.join(near.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a").select("ma", "b")
        step = step.join(near.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b").where("ma <> mb")
        done, left = left, materialise(step.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "cc-edges")
        release(done)
        if labels is not near:
            release(near)
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Names of contracted nodes are drawn ones: a component takes its least node's.
    least = materialise(labels.groupBy("m").agg(F.min("v").alias("component")), "cc-least")
    return labels.join(least, "m").select(F.col("v").alias("node"), "component")
