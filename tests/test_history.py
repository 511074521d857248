"""Lags, rolling means, pieces, incomplete rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from litrewise.operators import history
from litrewise.plans import forecasting
from litrewise.plans.history import series_sizes, with_history

ORDER = ["day_date", "k"]
DAY = dt.date(2023, 1, 1)


def series(spark, rows):
    """Rows of (id, name, day offset, k, prix)."""
    full = [(i, n, DAY + dt.timedelta(d), k, p) for i, n, d, k, p in rows]
    return spark.createDataFrame(full, "id long, name string, day_date date, k int, prix double")


def ten(spark):
    return series(spark, [(1, "a", d, 0, float(d + 1)) for d in range(10)])


def test_row_eight(spark):
    row = history.add_history(ten(spark), order=ORDER).filter("prix = 8").first()
    assert (row["price_lag_1"], row["price_lag_7"], row["rolling_avg_7"]) == (7.0, 1.0, 4.0)


def test_partial_frames_and_the_first_row(spark):
    rows = {r["prix"]: r for r in history.add_history(ten(spark), order=ORDER).collect()}
    assert rows[1.0]["rolling_avg_7"] is None and rows[3.0]["rolling_avg_7"] == 1.5


@pytest.mark.parametrize("lags,rolling", [((0,), 7), ((-1,), None), ((1,), 0)])
def test_only_the_past(spark, lags, rolling):
    with pytest.raises(ValueError):
        history.add_history(ten(spark), lags=lags, rolling=rolling, order=ORDER)
    with pytest.raises(ValueError):
        with_history(ten(spark), series_sizes(ten(spark)), lags=lags, rolling=rolling, order=ORDER)


@pytest.mark.parametrize("limit", [3, 50])
@pytest.mark.parametrize("lags,rolling", [((1, 7), 7), ((2,), None), ((), 3)])
def test_pieces_equal_the_plain_window(spark, limit, lags, rolling):
    rows = [(i, n, d // 2, d % 2, float((d * 37 + i * 11) % 101)) for i in (1, 2) for n in "ab" for d in range(60 + i)]
    df = series(spark, [*rows, *[(3, "a", d, 0, 1.0) for d in range(4)], *[(None, "a", d, 0, 2.0) for d in range(70)]])
    plain = history.add_history(df, lags=lags, rolling=rolling, order=ORDER)
    pieced = with_history(df, series_sizes(df), lags=lags, rolling=rolling, order=ORDER, max_series_rows=limit)
    assert sorted(plain.collect(), key=str) == sorted(pieced.select(plain.columns).collect(), key=str)


def test_daily_means_make_day_lags(spark):
    df = series(spark, [(1, "a", d, k, float(10 * d + k)) for d in (0, 1, 3) for k in (0, 1)])
    df = df.withColumns({"lat": F.lit(1.0), "long": F.lit(2.0)})
    days = history.add_history(history.daily_means(df), lags=(1,), rolling=None, order=["day_date"])
    assert [r["price_lag_1"] for r in days.orderBy("day_date").collect()] == [None, 0.5, 10.5]


def test_null_in_any_column_drops_the_row(spark):
    df = ten(spark).withColumn("other", F.when(F.col("prix") != 9, F.lit(1)))
    assert history.drop_incomplete(history.add_history(df, order=ORDER)).count() == 2
    kept = forecasting.complete_history(df, keep=["id", "name", *ORDER, "prix"], order=ORDER)
    assert sorted(r["prix"] for r in kept.collect()) == [8.0, 10.0]


def test_nan_counts_as_lacking(spark):
    df = series(spark, [(1, "a", d, 0, float("nan") if d == 12 else float(d)) for d in range(24)])
    table = forecasting.feature_table(df.withColumns({"lat": F.lit(1.0), "month": F.lit(1)}), forecasting.FeatureSet((1, 7), ("day_of_week",)), order=ORDER)
    values = [r[c] for r in table.collect() for c in ("prix", "price_lag_1", "price_lag_7", "rolling_avg_7")]
    assert values and all(v == v for v in values)
    whole = history.drop_incomplete(history.add_history(df, order=ORDER))
    assert table.count() == whole.count()


def test_day_of_week_counts_from_sunday(spark):
    rows = ten(spark).withColumns({"lat": F.lit(1.0), "month": F.lit(1)})
    table = forecasting.feature_table(rows, forecasting.FEATURES_A, order=ORDER)
    assert {r["day_date"]: r["day_of_week"] for r in table.collect()}[dt.date(2023, 1, 8)] == 1
