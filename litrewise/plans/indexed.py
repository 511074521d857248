"""From raw observations to indexed observations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.operators.history import SERIES
from litrewise.operators.indices import (
    AVERAGE,
    DAY_AND_FUEL,
    add_price_index,
    add_week_index,
    attach_per_day,
    join_national_average,
    national_daily_average,
)
from litrewise.operators.prepare import clean_prices, rarest_fuels, without_fuels
from litrewise.placement import MAX_BROADCAST_BYTES, fits_broadcast, settle

# Up to so many dropped fuels are named in a filter; more are anti-joined.
MAX_NAMED_FUELS = 1000


class Survey(NamedTuple):
    """What one pass over the cleaned observations tells, written once.

    `daily`: rows and average price per day and fuel; `sizes`: rows per station and fuel.
    """

    daily: DataFrame
    sizes: DataFrame


def survey(prepared: DataFrame) -> Survey:
    keys = ["id", "name", "day_date"]
    cells = prepared.select(*keys, "prix").groupingSets(
        [["id", "name"], ["day_date", "name"]], "id", "name", "day_date"
    )
    both = settle(
        cells.agg(
            F.grouping("id").alias("per_day"), F.count(F.lit(1)).alias("n_rows"), F.avg("prix").alias(AVERAGE)
        )
    )
    daily = both.filter("per_day = 1").select(*DAY_AND_FUEL, "n_rows", AVERAGE)
    return Survey(daily, both.filter("per_day = 0").select(*SERIES, "n_rows"))


def survey_days(prepared: DataFrame) -> DataFrame:
    """Rows and average price per day and fuel, written once: all that the indices need."""
    daily = prepared.groupBy(*DAY_AND_FUEL).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("prix").alias(AVERAGE))
    return settle(daily)


def rare_fuels(sizes: DataFrame, n: int) -> DataFrame | list[str]:
    """The `n` rarest fuels by the rows of their groups: names for a filter, if they are few."""
    totals = sizes.filter(F.col("name").isNotNull()).groupBy("name").agg(F.sum("n_rows").alias("n_rows"))
    rarest = totals.orderBy("n_rows", "name").limit(n).select("name")
    return [r["name"] for r in rarest.collect()] if n <= MAX_NAMED_FUELS else settle(rarest)


def kept_observations(raw: DataFrame, *, drop_n: int = 2) -> DataFrame:
    """Cleaned observations without the `drop_n` rarest fuels, which are ranked once."""
    prepared = clean_prices(raw)
    rarest = rarest_fuels(prepared, drop_n).select("name")
    if drop_n <= MAX_NAMED_FUELS:
        return without_fuels(prepared, [r["name"] for r in rarest.collect()])
    return without_fuels(prepared, settle(rarest))


def surveyed_observations(raw: DataFrame, *, drop_n: int = 2) -> tuple[DataFrame, Survey]:
    """Kept observations and the survey of all cleaned ones: one pass for the survey, and one
    for whatever reads the observations."""
    prepared = clean_prices(raw)
    found = survey(prepared)
    return without_fuels(prepared, rare_fuels(found.sizes, drop_n)), found


def weekly_observations(
    raw: DataFrame, *, first_year: int, drop_n: int = 2, iso: bool = False
) -> DataFrame:
    """Kept observations with their week index, for reports that need no price index."""
    return add_week_index(kept_observations(raw, drop_n=drop_n), first_year, iso=iso)


def with_national_average(
    df: DataFrame, *, max_broadcast_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Every observation with the average of its day and fuel, computed and measured here."""
    average = settle(national_daily_average(df))
    return join_national_average(df, average, broadcast=fits_broadcast(average, max_broadcast_bytes))


def index_surveyed(
    kept: DataFrame,
    daily: DataFrame,
    *,
    first_year: int,
    digits: int | None = 2,
    iso: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add national average, price and week index to observations, from their settled daily
    averages."""
    averages = daily.select(*DAY_AND_FUEL, AVERAGE)
    small = fits_broadcast(averages, max_broadcast_bytes)
    joined = attach_per_day(kept, averages, "inner", broadcast=small)
    return add_week_index(add_price_index(joined, digits=digits), first_year, iso=iso)


def indexed_observations(
    raw: DataFrame,
    *,
    first_year: int,
    drop_n: int = 2,
    digits: int | None = 2,
    iso: bool = False,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Clean, drop the rarest fuels, and add national average, price and week index.

    Equal to composing the single operators, with two passes over the observations, which are
    never shuffled while the daily table is small enough to broadcast.
    """
    prepared = clean_prices(raw)
    daily = survey_days(prepared)
    kept = without_fuels(prepared, rare_fuels(daily, drop_n))
    return index_surveyed(
        kept, daily, first_year=first_year, digits=digits, iso=iso, max_broadcast_bytes=max_broadcast_bytes
    )
