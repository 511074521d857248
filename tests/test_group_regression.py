"""Regressions of all groups at once against Spark's own fit."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litrewise.plans import forecasting, group_regression

FEATURES = [f"x{i}" for i in range(7)]


def rows(spark, n=900):
    rng = random.Random(8)
    made = []
    for i in range(n):
        x = [rng.gauss(0, 10 ** (k % 4)) + 100 * k for k in range(7)]
        x[6] = x[5] * 0.999 + rng.gauss(0, 0.01)  # nearly the same as another
        group = "abc"[i % 3]
        made.append((group, *x, sum((k + ord(group) % 5) * v for k, v in enumerate(x)) + rng.gauss(0, 3)))
    made += [("d", *[1.0] * 7, 5.0)] * 4  # nothing varies
    made += [("e", *[float(k) for k in range(7)], 2.0)]  # one row
    made += [(None, *[float(rng.random()) for _ in range(7)], rng.random()) for _ in range(50)]
    made += [("a", None, *[1.0] * 6, 1.0), ("f", *[None] * 7, 1.0)]
    return spark.createDataFrame(made, "name string, " + ", ".join(f"{c} double" for c in FEATURES) + ", prix double").repartition(5)


def test_equals_the_iterative_fit_of_each_group(spark):
    frame = rows(spark)
    models = group_regression.fit_by_group(frame, FEATURES)
    predicted = group_regression.predict_by_group(frame.dropna(subset=FEATURES), models, FEATURES)
    assert predicted.columns == [*frame.columns, "prediction"]
    for group in ("a", "b", "c"):
        own = frame.filter(F.col("name") == group).dropna()
        fitted = forecasting.predict(forecasting.fit(own, forecasting.linear_regression(), FEATURES), own)
        theirs = sorted((r["prix"], r["prediction"]) for r in fitted.collect())
        ours = sorted((r["prix"], r["prediction"]) for r in predicted.filter(F.col("name") == group).collect())
        assert np.array(ours) == pytest.approx(np.array(theirs), rel=1e-5)


def test_groups_that_do_not_vary(spark):
    models = {r["name"]: r for r in group_regression.fit_by_group(rows(spark), FEATURES).collect()}
    assert set(models) == {"a", "b", "c", "d", "e", None}
    assert models["d"]["intercept"] == 5.0 and models["d"]["coefficients"] == [0.0] * 7
    assert models["e"]["n_rows"] == 1 and models["e"]["intercept"] == 2.0
    assert models["a"]["n_rows"] == 300


def test_rows_without_a_model_have_no_prediction(spark):
    models = group_regression.fit_by_group(rows(spark).filter("name = 'a'"), FEATURES[:2])
    found = group_regression.predict_by_group(rows(spark).dropna(subset=FEATURES), models, FEATURES[:2])
    assert found.filter("name = 'b' and prediction is not null").count() == 0
    assert found.filter("name = 'a' and prediction is null").count() == 0
    assert group_regression.fit_by_group(rows(spark).filter("false"), FEATURES).count() == 0


def test_one_aggregation_and_no_iteration(spark):
    plan = group_regression.moments(rows(spark), FEATURES, "prix", ["name"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_covar_pop" in plan
