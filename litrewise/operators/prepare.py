"""Cleaning and the removal of rarely sold fuels. Nothing here starts a Spark job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litrewise.functions import degrees, observed_at

SALTS = 32


def clean_prices(raw: DataFrame) -> DataFrame:
    """Parse time and price, scale coordinates, and drop rows without a valid time.

    Adds `date_parsed`, `day_date`, `year`, `month` and `week`. `date` may be text, a date
    or a timestamp. A price that is not a finite number ("abc", "NaN", "Infinity") becomes
    null and its row stays.
    """
    moment = F.col("date")
    if isinstance(raw.schema["date"].dataType, T.StringType):
        moment = observed_at(moment)
    day = F.col("day_date")
    price = F.col("prix").try_cast("double")
    finite = F.abs(price) < F.lit(float("inf"))
    return (
        raw.filter(moment.isNotNull())
        # The filter has tested the spelling; a plain cast does not test it again.
        .withColumn("date_parsed", F.col("date").try_cast("timestamp"))
        .withColumn("day_date", F.to_date("date_parsed"))
        .withColumns(
            {
                "year": F.year(day),
                "month": F.month(day),
                "week": F.weekofyear(day),
                "lat": degrees(F.col("lat")),
                "long": degrees(F.col("long")),
                "prix": F.when(finite, price),
            }
        )
    )


def fuel_counts(df: DataFrame) -> DataFrame:
    """Rows per fuel, rarest first."""
    return df.groupBy("name").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("n_rows", "name")


def rarest_fuels(df: DataFrame, n: int = 2) -> DataFrame:
    """The `n` named fuels with the fewest rows; equal counts are ranked by name."""
    return fuel_counts(df.filter(F.col("name").isNotNull())).limit(n)


def without_fuels(df: DataFrame, fuels: DataFrame | Sequence[str], *, salts: int = SALTS) -> DataFrame:
    """Rows with a name that is not among `fuels`.

    A list becomes a filter that reaches the scan. A frame is anti-joined with a salt, so
    that the rows of one much sold fuel are spread over `salts` tasks.
    """
    named = df.filter(F.col("name").isNotNull())
    if not isinstance(fuels, DataFrame):
        return named.filter(~F.col("name").isin(list(fuels))) if fuels else named
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    every_salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    salted = fuels.select("name").distinct().withColumn("_salt", every_salt)
    return named.withColumn("_salt", salt).join(salted, ["name", "_salt"], "left_anti").select(*df.columns)


def groups_without_rare_fuels(groups: DataFrame, n: int = 2, rows: str = "n_rows") -> DataFrame:
    """Groups, each of one fuel and with its number of rows, but those of the `n` rarest.

    The same as dropping the fuels before grouping, as the groups carry what the ranking needs.
    Only the total of each fuel is ranked, as a top-n, and `n` names at most are broadcast.
    Equal counts are ranked by name. Both steps read `groups`: settle them first, and the
    observations are read once.
    """
    named = groups.filter(F.col("name").isNotNull())
    totals = named.groupBy("name").agg(F.sum(rows).alias("_total"))
    rarest = totals.orderBy("_total", "name").limit(n).select("name")
    return named.join(F.broadcast(rarest), "name", "left_anti").select(*groups.columns)


def filter_fuel(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("name") == name)


def filter_years_and_fuels(df: DataFrame, years: list[int], names: list[str]) -> DataFrame:
    """Rows of the selected years and fuels; an empty selection selects nothing."""
    return df.filter(F.col("year").isin(years) & F.col("name").isin(names))
