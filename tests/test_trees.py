"""Trees grown from histograms against MLlib's own, node for node."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from litrewise.plans import forecasting, trees

COLUMNS = ["a", "b", "c", "d"]
FOREST = {"labelCol": "prix", "numTrees": 5, "maxDepth": 6, "seed": 42}
BOOSTED = {"labelCol": "prix", "maxIter": 4, "maxDepth": 4, "seed": 42}


def irregular(spark, n=2000, partitions=1):
    """Numbers with and without many values, one of them constant."""
    rng = random.Random(5)
    rows = [(rng.gauss(0, 9), float(rng.randrange(5)), rng.random() ** 3, 1.0) for _ in range(n)]
    rows = [(*r, 7 * r[0] + r[1] ** 2 - 40 * r[2] + rng.gauss(0, 3)) for r in rows]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "a double, b double, c double, d double, prix double")
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(frame)


def nodes(model):
    return model.toDebugString.split("\n")[1:]


@pytest.mark.parametrize(
    "more",
    [
        {},
        {"bootstrap": False, "featureSubsetStrategy": "all"},
        {"subsamplingRate": 0.5, "minInstancesPerNode": 20},
        {"minInfoGain": 2.0, "maxBins": 8, "minWeightFractionPerNode": 0.01},
        {"numTrees": 1, "featureSubsetStrategy": "2"},
        {"numTrees": 20, "maxDepth": 8, "maxMemoryInMB": 1},
    ],
)
def test_forest_is_that_of_mllib(spark, more):
    rows = irregular(spark)
    own, theirs = trees.Forest(**(FOREST | more)).fit(rows), RandomForestRegressor(**(FOREST | more)).fit(rows)
    assert len(nodes(own)) > 20 and nodes(own) == nodes(theirs)
    assert own.featureImportances == theirs.featureImportances
    assert own.getOrDefault("labelCol") == "prix" and own.treeWeights == theirs.treeWeights


def test_boosted_trees_are_those_of_mllib(spark):
    rows = irregular(spark)
    own, theirs = trees.BoostedTrees(**BOOSTED).fit(rows), GBTRegressor(**BOOSTED).fit(rows)
    assert len(nodes(own)) > 100 and nodes(own) == nodes(theirs)
    assert own.treeWeights == theirs.treeWeights == [1.0, 0.1, 0.1, 0.1]


def test_many_parts_and_blocks_give_the_same(spark, monkeypatch):
    """Splits by a sample of the rows, small blocks, and sums merged in tasks of their own."""
    rows = irregular(spark, 12000, 30)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 150)
    monkeypatch.setattr(trees, "MAX_DRIVER_BYTES", 0)
    for own, theirs in ((trees.Forest(**FOREST), RandomForestRegressor(**FOREST)), (trees.BoostedTrees(**BOOSTED), GBTRegressor(**BOOSTED))):
        both = own.fit(rows).transform(rows).withColumnRenamed("prediction", "own")
        both = theirs.fit(rows).transform(both).select("own", "prediction").collect()
        assert len({r["own"] for r in both}) > 100
        assert all(r["own"] == pytest.approx(r["prediction"], rel=1e-9) for r in both)


def test_odd_rows_as_in_mllib(spark):
    frame = irregular(spark, 300)
    odd = {
        "one row": frame.limit(1),
        "equal rows": frame.limit(1).crossJoin(spark.range(40)),
        "equal labels": frame.withColumn("prix", F.lit(3.0)),
        "one in two parts": frame.limit(1).union(frame.limit(0)),
        "two labels": frame.withColumn("prix", F.when(F.col("a") > 0, 1.0).otherwise(-1.0)),
    }
    for name, rows in odd.items():
        rows = rows.coalesce(1)
        assert nodes(trees.Forest(**FOREST).fit(rows)) == nodes(RandomForestRegressor(**FOREST).fit(rows)), name
        assert nodes(trees.BoostedTrees(**BOOSTED).fit(rows)) == nodes(GBTRegressor(**BOOSTED).fit(rows)), name
    with pytest.raises(Exception, match="empty"):
        trees.Forest(**FOREST).fit(frame.limit(0))


def test_weights_are_left_to_mllib(spark):
    rows = irregular(spark).withColumn("w", F.col("b") + 1)
    more = FOREST | {"weightCol": "w"}
    assert nodes(trees.Forest(**more).fit(rows)) == nodes(RandomForestRegressor(**more).fit(rows))


@pytest.mark.parametrize("model", ["random_forest", "boosted_trees"])
def test_rows_of_a_fit_take_no_memory(spark, monkeypatch, model):
    """What a fit goes over at each level is on disk only, some bytes a row, and gone at its end."""
    rows, passed = irregular(spark, 2000).drop("features"), trees._pass
    context = spark.sparkContext
    before, seen = set(context._jsc.getPersistentRDDs()), []

    def watched(blocks, *rest):
        best = passed(blocks, *rest)
        kept = {i: r for i, r in context._jsc.getPersistentRDDs().items() if i not in before}
        seen.append([r.getStorageLevel() for r in kept.values()])
        # Labels and predictions, a byte a feature and a tree.
        n_bytes = sum(a.nbytes for block in blocks.collect() for a in block if a is not None)
        assert n_bytes <= 2000 * (16 + len(COLUMNS) + forecasting.FOREST_TREES)
        return best

    monkeypatch.setattr(trees, "_pass", watched)
    forecasting.fit(rows, getattr(forecasting, model)(depth=3), COLUMNS)
    assert seen and all(level.useDisk() and not level.useMemory() for levels in seen for level in levels)
    assert set(context._jsc.getPersistentRDDs()) == before
