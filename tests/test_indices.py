"""Price and week index, the salted join, samples and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from litrewise.operators import indices, reports


def prices(spark, rows):
    return spark.createDataFrame(rows, "day_date date, name string, prix double")


def test_average_zero_gives_no_index(spark):
    rows = prices(spark, [(dt.date(2023, 1, 1), "a", 0.0), (dt.date(2023, 1, 1), "a", 0.0)])
    joined = indices.add_price_index(indices.join_national_average(rows))
    assert [r["price_index"] for r in joined.collect()] == [None, None]


def test_index_and_null_prices(spark):
    day = dt.date(2023, 1, 1)
    rows = prices(spark, [(day, "a", 1.0), (day, "a", 3.0), (day, "a", None), (day, "b", 5.0)])
    joined = indices.add_price_index(indices.join_national_average(rows))
    assert sorted(((r["prix"], r["price_index"]) for r in joined.collect()), key=str) == sorted(
        [(1.0, 50.0), (3.0, 150.0), (None, None), (5.0, 100.0)], key=str
    )


def test_salted_join_equals_broadcast_join(spark):
    day = dt.date(2023, 1, 1)
    rows = prices(spark, [(day + dt.timedelta(i % 3), "ab"[i % 2], float(i)) for i in range(200)])
    daily = indices.national_daily_average(rows)
    both = [sorted(indices.attach_per_day(rows, daily, "left", broadcast=b).collect()) for b in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 200
    assert sorted(indices.attach_per_day(rows, daily, "left", salts=3).collect()) == both[0]


def test_week_index(spark):
    days = [dt.date(2022, 1, 1), dt.date(2022, 12, 31), dt.date(2023, 1, 1), dt.date(2024, 12, 30)]
    rows = spark.createDataFrame([(d,) for d in days], "day_date date")
    assert [r["week_index"] for r in indices.add_week_index(rows, 2022).collect()] == [52, 52, 104, 105]
    iso = [r["week_index"] for r in indices.add_week_index(rows, 2022, iso=True).collect()]
    assert iso == [0, 52, 52, 157]


def test_sample_does_not_depend_on_layout(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    samples = [sorted(r["k"] for r in reports.sample_rows(rows.repartition(n), ["k"], 0.1, 7).collect()) for n in (1, 7)]
    assert samples[0] == samples[1] and 60 < len(samples[0]) < 140


def test_empty_selection_gives_zeros(spark):
    rows = spark.createDataFrame([], "id long, prix double")
    assert reports.headline_numbers(rows).first().asDict() == {"n_rows": 0, "avg_price": 0.0, "n_stations": 0}


def test_options_without_rare_fuels(spark):
    rows = spark.createDataFrame([(2020, "a"), (2021, "b"), (2022, "c"), (2022, "c")], "year int, name string")
    found = [(r["kind"], r["value"]) for r in reports.filter_options_without_rare_fuels(rows, 2).collect()]
    assert found == [("name", "c"), ("year", "2022")]


def test_operators_start_no_job(spark):
    """Building any of these frames runs nothing on the cluster."""
    day = dt.date(2023, 1, 1)
    rows = spark.createDataFrame(
        [(1, "75000", 1.0, 1.0, day, "a", 1.0, 2023, 1)],
        "id long, cp string, lat double, long double, day_date date, name string, prix double, year int, week_index int",
    ).withColumn("date_parsed", F.col("day_date").cast("timestamp"))
    from litrewise.operators import calendar_history, cubes, folds, history, metrics, prepare, sketches, splits, tiles

    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    prepare.clean_prices(rows.withColumn("date", F.lit("2023-01-01 00:00:00")))
    prepare.without_fuels(rows, prepare.rarest_fuels(rows))
    prepare.without_fuels(rows, ["a"])
    indices.add_price_index(indices.join_national_average(rows))
    history.drop_incomplete(history.add_history(rows))
    history.piece_history(rows.withColumns({"_salt": F.lit(0.1), "_piece": F.lit(1)}))
    reports.department_map(rows.select(F.lit("75").alias("dept")), reports.department_average(rows, "prix"), "a")
    reports.average_without_rare_fuels(rows, ["week_index", "name"], "prix", "x")
    splits.with_part(rows, "2023-01-01"), splits.quantile_day(rows), splits.split_counts(rows, "2023-01-01")
    calendar_history.add_calendar_history(rows)
    cubes.cube_headlines(cubes.headline_cube(rows))
    folds.evaluate_by_cut(rows.withColumn("prediction", F.col("prix")), ["2023-01-01"])
    sketches.rank_bounds(rows, sketches.sketched_day(sketches.merged_sketch(sketches.day_sketches(rows))))
    tiles.heat_tiles(rows, "prix")
    metrics.evaluate(rows.withColumn("prediction", F.col("prix")))
    reports.station_series(rows.withColumn("prediction", F.col("prix")), 1)
    assert len(tracker.getJobIdsForGroup(None)) == before
