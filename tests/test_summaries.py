"""Quantile sketches, the headline cube, tiles, calendar lags and folds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from litrewise.operators import calendar_history, cubes, folds, metrics, reports, sketches, splits, tiles
from litrewise.sources import read_stage, stage_sketches, write_sketched_stage, write_stage

DAY = dt.date(2020, 1, 1)
PRICES = "id long, name string, day_date date, year int, prix double"


def prices(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = DAY + dt.timedelta(int(rng.random() ** 3 * 900))
        rows.append((rng.randrange(300), rng.choice(["a", "b", "c", None]), day, day.year, float(rng.randrange(1000))))
    rows += [(1, "a", None, None, 5.0), (2, "a", DAY, DAY.year, None)]
    return spark.createDataFrame(rows, PRICES).repartition(5)


def share_before(days, cut):
    return sum(d < cut for d in days) / len(days), sum(d <= cut for d in days) / len(days)


def test_merged_sketches_stay_within_their_error(spark):
    skew = F.floor(F.pow(F.rand(3), 4) * 200_000).cast("int")
    rows = spark.range(300_000).select((F.col("id") % 7).alias("name"), F.date_from_unix_date(skew).alias("day_date")).persist()
    whole = sketches.merged_sketch(sketches.day_sketches(rows))
    parts = sketches.merged_sketch(sketches.day_sketches(rows, ["name"]))
    assert whole.first()["n_rows"] == parts.first()["n_rows"] == 300_000
    for q in (0.01, 0.5, 0.8, 0.99):
        for sketch in (whole, parts):
            bounds = sketches.rank_bounds(rows, sketches.sketched_day(sketch, q)).first()
            assert bounds["before"] <= q + 0.001 and bounds["upto"] >= q - 0.001
    rows.unpersist()


def test_sketch_beside_a_stage_spares_its_rows(spark, tmp_path):
    path = str(tmp_path / "stage")
    stage = write_sketched_stage(prices(spark), path, by=["name"])
    found = stage_sketches(spark, path)
    cut = sketches.sketched_day(sketches.merged_sketch(found), 0.8)
    assert cut.inputFiles() and all("_day_sketches" in f for f in cut.inputFiles())
    assert cut.first()["cut"] == splits.quantile_day(stage, 0.8).first()["cut"]
    assert read_stage(spark, path).count() == 4002


def test_sketch_of_nothing(spark):
    empty = prices(spark).filter("id < 0")
    for by in ([], ["name"]):
        assert sketches.sketched_day(sketches.merged_sketch(sketches.day_sketches(empty, by))).first()["cut"] is None
    undated = prices(spark).filter("day_date is null")
    assert sketches.sketched_day(sketches.merged_sketch(sketches.day_sketches(undated, ["name"]))).first()["cut"] is None


def test_cube_answers_any_selection(spark, tmp_path):
    rows = prices(spark)
    write_stage(cubes.headline_cube(rows), str(tmp_path / "cube"))
    cube = read_stage(spark, str(tmp_path / "cube"))
    selections = [
        None,
        cubes.years_and_fuels([2020], ["a", "b"]),
        cubes.years_and_fuels([2021, 2022], ["c"]),
        cubes.years_and_fuels([], ["a"]),
        cubes.years_and_fuels([1890], ["a"]),
        F.col("name").isNull(),
    ]
    for chosen in selections:
        found = cubes.cube_headlines(cube, chosen)
        expected = reports.headline_numbers(rows if chosen is None else rows.filter(chosen)).first().asDict()
        assert found.first().asDict() == pytest.approx(expected)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and all("/cube/" in f for f in found.inputFiles())
    assert cube.count() <= 4 * 4


def test_stations_of_a_large_cube_are_within_the_stated_error(spark):
    rows = spark.range(400_000).select(
        (F.col("id") % 50_000).alias("id"), F.lit(2020).alias("year"), (F.col("id") % 3).cast("string").alias("name"), F.lit(1.0).alias("prix")
    )
    found = cubes.cube_headlines(cubes.headline_cube(rows)).first()
    assert found["n_rows"] == 400_000
    assert abs(found["n_stations"] - 50_000) < 3 * 0.0081 * 50_000


def places(spark):
    rng = random.Random(2)
    rows = [("ab"[i % 2], rng.uniform(-90, 90), rng.uniform(-180, 180), float(rng.randrange(80, 130))) for i in range(500)]
    rows += [("a", 90.0, 180.0, 100.0), ("a", -90.0, -180.0, 100.0), ("a", 95.0, 0.0, 1.0), ("a", None, 0.0, 1.0), ("a", 0.0, 0.0, None)]
    return spark.createDataFrame(rows, "name string, lat double, long double, price_index double")


def test_tiles_sum_up_to_their_parents(spark):
    found = tiles.heat_tiles(places(spark), zoom=6).collect()
    by_key = {(r["name"], r["zoom"], r["tile"]): r for r in found}
    assert len(by_key) == len(found)
    for (name, zoom, tile), parent in by_key.items():
        children = [by_key[k] for k in ((name, zoom + 1, 4 * tile + i) for i in range(4)) if k in by_key]
        if zoom < 6:
            assert sum(c["n_rows"] for c in children) == parent["n_rows"]
            assert sum(c["total"] for c in children) == parent["total"]
    tops = [r for r in found if r["zoom"] == 0]
    assert sum(r["n_rows"] for r in tops) == 502 and {r["tile"] for r in tops} == {0}
    assert all((r["weight"] is None) == (r["total"] / r["n_rows"] <= 90) for r in found)
    assert ("a", 6, 0) in by_key and ("a", 6, 4**6 - 1) in by_key


def test_tile_keys_are_interleaved(spark):
    from litrewise.functions.tiles import tile_key

    rows = spark.createDataFrame([(-89.0, -179.0), (-89.0, 179.0), (89.0, -179.0), (89.0, 179.0), (1.0, 91.0)], "lat double, long double")
    keys = [r[0] for r in rows.select(tile_key(F.col("lat"), F.col("long"), 2)).collect()]
    assert keys == [0b0000, 0b0101, 0b1010, 0b1111, 0b1101]
    assert rows.select(tile_key(F.col("lat"), F.col("long"), 0)).distinct().collect() == [(0,)]
    for zoom in (-1, 25):
        with pytest.raises(ValueError):
            tile_key(F.col("lat"), F.col("long"), zoom)


def test_calendar_lags_leave_gaps(spark):
    rng = random.Random(4)
    rows = []
    for station, name in ((1, "a"), (1, None), (None, "a"), (2, "b")):
        for day in rng.sample(range(40), 25):
            for _ in range(rng.choice([1, 1, 3])):
                price = None if rng.random() < 0.1 else float(rng.randrange(100))
                rows.append((station, name, DAY + dt.timedelta(day), 2020, price))
    rows.append((1, "a", None, None, 3.0))
    frame = spark.createDataFrame(rows, PRICES).repartition(3)

    def mean(station, name, day, first, last):
        days = {day + dt.timedelta(k) for k in range(first, last + 1)}
        found = [r[4] for r in rows if r[:2] == (station, name) and r[2] in days and r[4] is not None]
        return sum(found) / len(found) if found else None

    found = calendar_history.add_calendar_history(frame, lags=(1, 3), rolling=5).collect()
    assert len(found) == len(rows)
    nulls = 0
    for r in found:
        if r["day_date"] is None:
            assert r["price_1d_ago"] is None and r["avg_last_5d"] is None
            continue
        spans = {"price_1d_ago": (-1, -1), "price_3d_ago": (-3, -3), "avg_last_5d": (-5, -1)}
        for column, span in spans.items():
            expected = mean(r["id"], r["name"], r["day_date"], *span)
            assert r[column] == (None if expected is None else pytest.approx(expected))
            nulls += expected is None
    assert nulls > 20
    with pytest.raises(ValueError):
        calendar_history.add_calendar_history(frame, lags=(0,))


def predictions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        price = 1e6 + rng.random()
        rows.append((DAY + dt.timedelta(rng.randrange(300)), price, None if i % 50 == 0 else price + rng.gauss(0, 0.3)))
    rows.append((None, 1.0, 1.0))
    return spark.createDataFrame(rows, "day_date date, prix double, prediction double").repartition(4)


def test_folds_equal_single_evaluations(spark):
    rows = predictions(spark)
    cuts = ["2020-09-01", "2020-03-01", "2020-06-15"]
    found = {(str(r["cut"]), r["horizon"]): r for r in folds.evaluate_by_cut(rows, cuts).collect()}
    assert len(found) == 6
    ordered = sorted(cuts)
    for i, cut in enumerate(ordered):
        train, rest = splits.split_by_date(rows, cut)
        following = splits.split_by_date(rest, ordered[i + 1])[0] if i + 1 < len(ordered) else rest
        for horizon, test in (("rest", rest), ("next", following)):
            row = found[cut, horizon]
            assert (row["n_train"], row["n_test"]) == (train.count(), test.count())
            expected = metrics.evaluate(test).first()
            for m in metrics.METRICS:
                assert row[m] == pytest.approx(expected[m], rel=1e-6)


def test_folds_without_test_rows(spark):
    found = folds.evaluate_by_cut(predictions(spark), ["1999-01-01", "2030-01-01"]).collect()
    late = [r for r in found if r["cut"].year == 2030]
    assert all(r["n_test"] == 0 and r["rmse"] is None and r["r2"] is None and r["n_train"] == 600 for r in late)
    early = [r for r in found if r["cut"].year == 1999]
    assert all(r["n_train"] == 0 and r["n_test"] == 600 for r in early)
    with pytest.raises(ValueError):
        folds.evaluate_by_cut(predictions(spark), [])
