"""Reading and cleaning: bad dates, prices, names, postal codes."""

from __future__ import annotations

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from litrewise.functions import department
from litrewise.operators import prepare
from litrewise.sources import RAW_SCHEMA, read_price_files

COLUMNS = "id long, cp string, pop string, lat double, long double, date string, type int, name string, prix string"


def raw(spark, *rows):
    """Rows of (date, name, prix)."""
    full = [(1, "1000", "R", 4800000.0, 200000.0, d, 1, n, p) for d, n, p in rows]
    return spark.createDataFrame(full, COLUMNS)


def test_two_observations_from_gzip(spark, tmp_path):
    lines = (
        "41;1200;A;4615000;-75000;2021-07-14T06:30:10;6;SP98;1.701\n"
        "97;33700;R;4483000;562500;2021-12-31 23:05:00;5;E85;0.749\n"
    )
    with gzip.open(tmp_path / "Prix2023.csv.gz", "wt") as file:
        file.write(lines)
    for infer in (False, True):
        rows = read_price_files(spark, str(tmp_path / "Prix*.csv.gz"), infer_schema=infer)
        assert rows.columns == RAW_SCHEMA.names
        cleaned = prepare.clean_prices(rows).orderBy("id").collect()
        assert len(cleaned) == 2
        first = cleaned[0]
        assert (first["lat"], first["long"], first["year"], first["month"], first["week"]) == (46.15, -0.75, 2021, 7, 28)
        assert first["prix"] == 1.701 and first["date_parsed"] == dt.datetime(2021, 7, 14, 6, 30, 10)
        assert isinstance(first["prix"], float)


def test_years_are_united_and_rows_dealt(spark, tmp_path):
    for year in (2022, 2023):
        with gzip.open(tmp_path / f"Prix{year}.csv.gz", "wt") as file:
            file.write(f"1;75000;R;1;1;{year}-05-01 00:00:00;1;E10;1.5\n")
    rows = read_price_files(spark, str(tmp_path / "Prix*.csv.gz"), partitions=3)
    assert rows.rdd.getNumPartitions() == 3
    assert {r["year"] for r in prepare.clean_prices(rows).collect()} == {2022, 2023}


def test_bad_dates_go_both_spellings_stay(spark):
    rows = raw(spark, ("n/a", "E10", "1"), ("2023-02-30 00:00:00", "E10", "1"), ("2023-01-01T12:00:00", "E10", "1"),
               ("2023-01-01 12:00:00", "E10", "1"), (None, "E10", "1"), ("2023-01-01", "E10", "1"))
    assert prepare.clean_prices(rows).count() == 2


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_typed_dates_are_kept(spark, kind):
    rows = raw(spark, ("2023-03-04", "E10", "1"), (None, "E10", "1")).withColumn("date", F.col("date").cast(kind))
    found = prepare.clean_prices(rows).collect()
    assert [r["day_date"] for r in found] == [dt.date(2023, 3, 4)]


def test_bad_prices_become_null(spark):
    rows = raw(spark, *[("2023-01-01 00:00:00", "E10", p) for p in ("abc", "NaN", "Infinity", "-Infinity", None, "1.5")])
    assert [r["prix"] for r in prepare.clean_prices(rows).collect()] == [None] * 5 + [1.5]


def test_rarest_fuels_ties_by_name(spark):
    rows = raw(spark, *[("2023-01-01 00:00:00", n, "1") for n in "aabbccddd"])
    assert [r["name"] for r in prepare.rarest_fuels(rows, 2).collect()] == ["a", "b"]


def test_null_names_neither_rank_nor_stay(spark):
    rows = raw(spark, *[("2023-01-01 00:00:00", n, "1") for n in (None, "a", "b", "b", "c", "c", "c")])
    rarest = prepare.rarest_fuels(rows, 2)
    for fuels in (["a", "b"], rarest):
        assert {r["name"] for r in prepare.without_fuels(rows, fuels).collect()} == {"c"}
    assert prepare.without_fuels(rows, []).count() == 6


def test_groups_can_be_dropped_after_grouping(spark):
    rows = raw(spark, *[(f"2023-01-0{1 + i % 3} 00:00:00", n, "1") for i, n in enumerate("aabbbcccccdddd")])
    groups = rows.groupBy("name", "date").agg(F.count(F.lit(1)).alias("n_rows"))
    late = prepare.groups_without_rare_fuels(groups, 2).orderBy("name", "date").collect()
    names = [r["name"] for r in prepare.rarest_fuels(rows, 2).collect()]
    early = prepare.without_fuels(rows, names).groupBy("name", "date").agg(F.count(F.lit(1)).alias("n_rows"))
    assert late == early.orderBy("name", "date").collect()


def test_department_restores_the_zero(spark):
    rows = spark.createDataFrame([(1000,), (69000,)], "cp int").select(department(F.col("cp")).alias("d"))
    assert [r["d"] for r in rows.collect()] == ["01", "69"]
