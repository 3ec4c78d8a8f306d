"""Splits, batches, losses and the smaller helpers on small tables."""

import pytest

from cellweave.operators import evaluation as V
from cellweave.operators import splits as L
from cellweave.operators.components import connected_components
from cellweave.plans import pipeline
from cellweave.sources.readers import point_clouds


def test_splits_cover_and_are_written_once(spark, tmp_path):
    items = spark.range(40).select("id")
    given = items.selectExpr("id", "if(id < 20, 'train', 'test') AS split")
    assert L.make_split(items, "id", "fixed", given=given).count() == 40
    with pytest.raises(ValueError, match="not every item"):
        L.make_split(items, "id", "fixed", given=given.where("id < 39"))
    with pytest.raises(ValueError, match="unknown split"):
        L.make_split(items, "id", "other")
    made = []
    make = lambda: made.append(1) or L.make_split(items, "id", seed=3)
    first = {tuple(r) for r in L.written_once(spark, str(tmp_path), 0, make).collect()}
    assert first == {tuple(r) for r in L.written_once(spark, str(tmp_path), 0, make).collect()} and made == [1]


def test_helpers(spark, tmp_path):
    report = spark.createDataFrame([(0.5, 0.25)], "accuracy double, f1 double")
    assert V.metric_value(report, "f1") == 0.25 and V.count_parameters({"w": [[1, 2], [3, 4]], "b": [0.0, 1.0]}) == 6
    with pytest.raises(ValueError, match="no metric"):
        V.metric_value(report, "auroc")
    for part, v in (("train", 1), ("test", 2)):
        spark.createDataFrame([(0, v, [1.0, 2.0], 5)], "g long, v long, pos array<double>, y int").write.parquet(f"{tmp_path}/{part}")
    assert {(r["v"], tuple(r["x"]), r["part"]) for r in point_clouds(spark, str(tmp_path)).collect()} == {(1, (1.0, 2.0), "train"), (2, (1.0, 2.0), "test")}

    @pipeline.register("drop_labels")
    def drop_labels(tables):
        return {k: v for k, v in tables.items() if k != "labels"}

    try:
        assert set(pipeline.TRANSFORMS["drop_labels"]({"nodes": 1, "labels": 2})) == {"nodes"}
        with pytest.raises(ValueError, match="exists"):
            pipeline.register("drop_labels")(drop_labels)
    finally:
        del pipeline.TRANSFORMS["drop_labels"]


def test_components_agree_with_and_without_the_last_task(spark, monkeypatch):
    from cellweave.operators import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 30), (30, 25), (7, 7), (None, 3)], "a long, b long")
    one = {tuple(r) for r in connected_components(edges).collect()}
    monkeypatch.setattr(components, "SMALL", 0)
    assert one == {tuple(r) for r in connected_components(edges).collect()} == {(i, 0) for i in range(13)} | {(k, 20) for k in (20, 25, 30)}
