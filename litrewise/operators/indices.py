"""National averages, the price index and the week index. Nothing here starts a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.functions import price_index, week_number

AVERAGE = "avg_day_price_france"
DAY_AND_FUEL = ["day_date", "name"]
SALTS = 32


def national_daily_average(df: DataFrame) -> DataFrame:
    """Average price per day and fuel. Partial sums are formed before the shuffle, so
    a day or fuel with very many rows reaches the reducer as one row per map task."""
    return df.groupBy(*DAY_AND_FUEL).agg(F.avg("prix").alias(AVERAGE))


def attach_per_day(
    df: DataFrame,
    daily: DataFrame,
    how: str,
    *,
    broadcast: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """Join a table with one row per day and fuel to the observations.

    With `broadcast`, for a daily side whose size the caller has measured, the observations
    are not shuffled at all. Otherwise both sides are shuffled with a salt, so that the
    rows of one busy day and fuel are spread over `salts` tasks.
    """
    if broadcast:
        return df.join(F.broadcast(daily), DAY_AND_FUEL, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    return (
        df.withColumn("_salt", salt)
        .join(daily.withColumn("_salt", every_salt), [*DAY_AND_FUEL, "_salt"], how)
        .drop("_salt")
    )


def join_national_average(
    df: DataFrame,
    average: DataFrame | None = None,
    *,
    broadcast: bool = False,
) -> DataFrame:
    """Every observation with the average of its day and fuel; all rows are kept."""
    if average is None:
        average = national_daily_average(df)
    return attach_per_day(df, average, "left", broadcast=broadcast)


def add_price_index(df: DataFrame, *, digits: int | None = 2) -> DataFrame:
    """Add `price_index` to observations that carry their national average."""
    index = price_index(F.col("prix"), F.col(AVERAGE), digits=digits)
    return df.withColumn("price_index", index)


def add_week_index(df: DataFrame, first_year: int, *, iso: bool = False) -> DataFrame:
    return df.withColumn("week_index", week_number(F.col("day_date"), first_year, iso=iso))
