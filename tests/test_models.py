"""Splits, metrics and models."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from litrewise.operators import metrics, reports, splits
from litrewise.plans import forecasting
from litrewise.sources import read_stage

DAY = dt.date(2023, 1, 1)


def linear(spark, n=200):
    rows = [(DAY + dt.timedelta(i), float(i % 17), float(i % 5), 2.0 + 3.0 * (i % 17) - (i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "day_date date, a double, b double, prix double").coalesce(1)


def test_linear_series_is_recovered(spark):
    train, test = splits.split_by_date(linear(spark), "2023-06-01")
    model = forecasting.fit(train, forecasting.linear_regression(), ["a", "b"])
    predicted = forecasting.predict(model, test)
    assert "features" not in predicted.columns
    assert all(abs(r["prix"] - r["prediction"]) < 1e-6 for r in predicted.collect())


def test_metrics_equal_the_evaluator(spark):
    rows = linear(spark).withColumn("prediction", F.col("prix") * 1.1 + F.col("a"))
    own = metrics.evaluate(rows).first()
    for name in metrics.METRICS:
        theirs = RegressionEvaluator(labelCol="prix", predictionCol="prediction", metricName=name).evaluate(rows)
        assert own[name] == pytest.approx(theirs, rel=1e-9)


def test_same_seed_same_metrics(spark):
    train, test = splits.split_by_date(linear(spark), "2023-06-01")
    models = {"forest": forecasting.random_forest(trees=5, depth=3), "boosted": forecasting.boosted_trees(iterations=3)}
    runs = [sorted(forecasting.compare_models(train, test, models, ["a", "b"]).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    single = {
        name: metrics.evaluate(forecasting.predict(forecasting.fit(train, m, ["a", "b"]), test)).first()["rmse"]
        for name, m in models.items()
    }
    assert {r["model"]: r["rmse"] for r in runs[0]} == pytest.approx(single)
    assert single["forest"] != single["boosted"]


def test_full_size_trees_fit_well(spark):
    train, test = splits.split_by_date(linear(spark), "2023-06-01")
    for model in (forecasting.random_forest(), forecasting.boosted_trees()):
        predicted = forecasting.predict(forecasting.fit(train, model, ["a", "b"]), test)
        assert metrics.evaluate(predicted).first()["r2"] > 0.9


def test_training_rows_leave_the_memory_to_the_trees(spark, monkeypatch):
    """The rows of a fit are kept once, on disk, and dropped at its end."""
    levels = []
    persist = type(spark.range(0)).persist
    monkeypatch.setattr(type(spark.range(0)), "persist", lambda df, level: levels.append((df, level)) or persist(df, level))
    forecasting.fit(linear(spark), forecasting.random_forest(trees=2, depth=2), ["a", "b"])
    [(kept, level)] = levels
    assert level.useDisk and not level.useMemory
    assert not kept.storageLevel.useDisk


def test_comparison_counts_series_in_the_survey(spark, monkeypatch, tmp_path):
    """The compared fuel's series are not counted by a pass of their own."""
    from checks import queries

    def counted(df, series=None):
        raise AssertionError("a pass that counts the series")

    rows = [(o, 1, o % 3, 0, "A", DAY + dt.timedelta(-9500 + o // 3 * 2), 100.0 + o % 7) for o in range(1, 6000)]
    schema = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_linestatus string, day date, l_extendedprice double"
    items = spark.createDataFrame(rows, schema).withColumn("l_shipdate", F.col("day").cast("timestamp")).drop("day")
    others = items.limit(40).withColumns({"l_partkey": F.col("l_orderkey") % 2 + 1, "l_linenumber": F.lit(2)})
    items.unionByName(others).write.parquet(str(tmp_path / "lineitem.parquet"))
    fuels = [(0, queries.FUEL), (1, "ECONOMY"), (2, "LARGE")]
    spark.createDataFrame(fuels, "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, k) for k in range(3)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(forecasting, "series_sizes", counted)
    found = {r["model"] for r in queries.registered()["model_comparison"](spark, str(tmp_path)).collect()}
    assert found == {"linear_regression", "random_forest", "boosted_trees"}


def test_forest_export(spark, tmp_path):
    rows = linear(spark).withColumns({"name": F.lit("E10"), "cp": F.lit(1000)})
    train, test = splits.split_by_date(rows, "2023-06-01")
    model = forecasting.fit(train, forecasting.random_forest(trees=50), ["a", "b"])
    forecasting.export_forecast(forecasting.predict(model, test), str(tmp_path / "out"))
    found = read_stage(spark, str(tmp_path / "out"))
    assert found.columns == ["day_date", "name", "dept", "prix", "prediction"]
    assert found.count() == test.count() and {r["dept"] for r in found.collect()} == {"01"}


def test_quantile_cut_does_not_depend_on_the_time_zone(spark):
    rows = linear(spark, 100)
    zone = spark.conf.get("spark.sql.session.timeZone")
    cuts = []
    for z in ("UTC", "Pacific/Auckland", "America/Los_Angeles"):
        spark.conf.set("spark.sql.session.timeZone", z)
        cuts.append(splits.quantile_day(rows, 0.8).first()["cut"])
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert cuts == [DAY + dt.timedelta(79)] * 3


def test_both_sides_of_a_cut(spark):
    rows = linear(spark, 10)
    train, test = splits.split_by_date(rows, "2023-01-04")
    assert (train.count(), test.count()) == (3, 7)
    assert {r["part"]: r["n_rows"] for r in splits.split_counts(rows, "2023-01-04").collect()} == {"train": 3, "test": 7}
    parted = splits.with_part(rows, "2023-01-04").groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parted} == {"train": 3, "test": 7}


def test_range_covers_all_frames(spark):
    a = spark.createDataFrame([(1.0, 2.0)], "prix double, prediction double")
    b = spark.createDataFrame([(0.5, 9.0)], "prix double, prediction double")
    assert metrics.value_range(a, b).first().asDict() == {"lower": 0.5, "upper": 9.0}


def test_series_of_the_first_station(spark):
    rows = spark.createDataFrame(
        [(i, DAY, "a", float(i), float(i)) for i in (3, 2, 5)], "id long, day_date date, name string, prix double, prediction double"
    )
    assert [r["prix"] for r in forecasting.first_station_series(rows).collect()] == [2.0]
    assert forecasting.first_station_series(rows.filter("id > 9")).count() == 0
    assert [r["prix"] for r in reports.station_series(rows, 5).collect()] == [5.0]


# A regression tree in plain Python: the split of greatest fall in squared error at each node.


def plain_tree(rows, labels, depth):
    mean = sum(labels) / len(labels)
    whole = sum((y - mean) ** 2 for y in labels)
    best = None
    for j in range(len(rows[0])):
        values = sorted({r[j] for r in rows})
        for low, high in zip(values, values[1:]):
            sides = [[y for r, y in zip(rows, labels) if (r[j] <= low) == left] for left in (True, False)]
            error = sum(sum((y - sum(s) / len(s)) ** 2 for y in s) for s in sides)
            if best is None or error < best[0] - 1e-9:
                best = (error, j, (low + high) / 2)
    if depth == 0 or best is None or whole - best[0] <= 1e-9:
        return mean
    _, j, cut = best
    parts = [([r for r in rows if (r[j] <= cut) == left], [y for r, y in zip(rows, labels) if (r[j] <= cut) == left]) for left in (True, False)]
    return (j, cut, *[plain_tree(*p, depth - 1) for p in parts])


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def irregular(spark, n=150):
    """Rows whose splits never tie, with fewer different values than the trees have bins."""
    import random

    rng = random.Random(12)
    rows = [(float(rng.randrange(17)) ** 1.3, float(rng.randrange(11)) * 0.7) for _ in range(n)]
    labels = [10 * a**0.5 - b * b + (5 if a > 8 and b < 3 else 0) + rng.gauss(0, 1) for a, b in rows]
    frame = spark.createDataFrame([(*r, y) for r, y in zip(rows, labels)], "a double, b double, prix double").coalesce(1)
    return frame, rows, labels


def test_forest_of_full_depth_equals_plain_trees(spark):
    frame, rows, labels = irregular(spark)
    forest = forecasting.random_forest(trees=3).setBootstrap(False).setFeatureSubsetStrategy("all")
    found = forecasting.predict(forecasting.fit(frame, forest, ["a", "b"]), frame).collect()
    tree = plain_tree(rows, labels, forecasting.FOREST_DEPTH)
    expected = {r: plain_value(tree, r) for r in rows}
    assert len(set(expected.values())) > 40
    assert all(r["prediction"] == pytest.approx(expected[r["a"], r["b"]], rel=1e-6) for r in found)


def test_all_boosting_rounds_equal_plain_boosting(spark):
    frame, rows, labels = irregular(spark)
    found = forecasting.predict(forecasting.fit(frame, forecasting.boosted_trees(), ["a", "b"]), frame).collect()
    # Squared loss: the first tree fits the labels, each other one twice what is left, at a tenth.
    tree = plain_tree(rows, labels, 5)
    fitted = [plain_value(tree, r) for r in rows]
    for _ in range(forecasting.BOOSTING_ROUNDS - 1):
        tree = plain_tree(rows, [2 * (y - f) for y, f in zip(labels, fitted)], 5)
        fitted = [f + 0.1 * plain_value(tree, r) for f, r in zip(fitted, rows)]
    expected = dict(zip(rows, fitted))
    assert all(r["prediction"] == pytest.approx(expected[r["a"], r["b"]], rel=1e-6) for r in found)


def test_comparison_equals_the_metrics_of_plain_models(spark):
    """All three default models, bagging apart: least squares by numpy, and plain boosting."""
    import numpy as np

    frame, rows, labels = irregular(spark)
    found = {r["model"]: r for r in forecasting.compare_models(frame, frame, forecasting.default_models(), ["a", "b"]).collect()}
    design = np.array([(1.0, *r) for r in rows])
    fitted = design @ np.linalg.lstsq(design, np.array(labels), rcond=None)[0]
    error = np.array(labels) - fitted
    assert found["linear_regression"]["rmse"] == pytest.approx(float(np.sqrt((error**2).mean())), rel=1e-6)
    assert found["linear_regression"]["mae"] == pytest.approx(float(np.abs(error).mean()), rel=1e-6)
    # A forest's trees are fitted to rows drawn again, so that it lies between one tree and a line.
    tree = plain_tree(rows, labels, forecasting.FOREST_DEPTH)
    own = float(np.sqrt(np.mean([(y - plain_value(tree, r)) ** 2 for r, y in zip(rows, labels)])))
    assert own < found["random_forest"]["rmse"] < found["linear_regression"]["rmse"]
