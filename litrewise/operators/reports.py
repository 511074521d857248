"""Grouped, filtered and sorted reports over prepared or indexed observations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litrewise.functions import department, key_hash_sample
from litrewise.operators.prepare import groups_without_rare_fuels


def average_by(df: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(alias))


# Fixed text of the report's statement: four clauses that its definition leaves no choice in.
def yearly_average_sql(spark: SparkSession, view: str = "gas_prices") -> DataFrame:
    """Average price per year and fuel, from a registered view."""
    return spark.sql(
        "select year, name, avg(prix) as avg_price from {prices} group by year, name"
        " order by year, name",
        prices=spark.table(view),
    )


def weekly_average(df: DataFrame) -> DataFrame:
    keys = ["week_index", "name"]
    return average_by(df, keys, "prix", "avg_weekly_price").orderBy(*keys)


Step = Callable[[DataFrame], DataFrame]


def average_without_rare_fuels(
    df: DataFrame, keys: Sequence[str], value: str, alias: str, n: int = 2, *, settle: Step | None = None
) -> DataFrame:
    """`average_by` without the `n` rarest fuels: groups are made first and dropped by the row
    counts they carry. `keys` must hold `name`. With `settle` (as that of `placement`) the groups
    are written once, so that the observations are read once."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias(alias))
    return groups_without_rare_fuels(settle(groups) if settle else groups, n).select(*keys, alias)


def daily_average(df: DataFrame) -> DataFrame:
    keys = ["day_date", "name"]
    return average_by(df, keys, "prix", "avg_daily_price").orderBy(*keys)


def with_department(df: DataFrame) -> DataFrame:
    return df.withColumn("dept", department(F.col("cp")))


def department_average(df: DataFrame, metric: str = "price_index") -> DataFrame:
    """Average of `metric` per department and fuel, all fuels in one pass."""
    return average_by(with_department(df), ["dept", "name"], metric, "avg_index")


def coordinate_average(df: DataFrame, metric: str = "price_index") -> DataFrame:
    """Average of `metric` per fuel and coordinate, all fuels in one pass."""
    return average_by(df, ["name", "lat", "long"], metric, "avg_index")


def heat_points(coordinates: DataFrame, floor: float = 90.0) -> DataFrame:
    """Coordinates whose average lies above `floor`, weighted by the excess."""
    excess = F.col("avg_index") - F.lit(floor)
    return coordinates.filter(F.col("avg_index") > floor).select(
        "name", "lat", "long", excess.alias("weight")
    )


def department_map(areas: DataFrame, averages: DataFrame, fuel: str) -> DataFrame:
    """Every area of the map with its average for one fuel, null where there is none."""
    one_fuel = averages.filter(F.col("name") == fuel).select("dept", "avg_index")
    return areas.join(one_fuel, "dept", "left")


def headline_numbers(df: DataFrame) -> DataFrame:
    """Rows, mean price and number of stations; zeros for an empty selection."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.avg("prix"), F.lit(0.0)).alias("avg_price"),
        F.count_distinct("id").alias("n_stations"),
    )


def filter_options(df: DataFrame) -> DataFrame:
    """Sorted selectable values, one row per (`kind`, `value`).

    One distinct over the data; the two lists are then drawn from its small result.
    """
    return _options(df.select("year", "name").distinct())


def filter_options_without_rare_fuels(
    df: DataFrame, n: int = 2, *, settle: Step | None = None
) -> DataFrame:
    """`filter_options` without the `n` rarest fuels; `settle` as in `average_without_rare_fuels`."""
    groups = df.groupBy("year", "name").agg(F.count(F.lit(1)).alias("n_rows"))
    return _options(groups_without_rare_fuels(settle(groups) if settle else groups, n))


def _options(pairs: DataFrame) -> DataFrame:
    option = F.explode(
        F.array(
            F.struct(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value")),
            F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")),
        )
    )
    return pairs.select(option.alias("o")).select("o.*").distinct().orderBy("kind", "value")


def peak_week(weekly: DataFrame) -> DataFrame:
    """The highest weekly average; the earliest week and first name win ties."""
    ranked = weekly.orderBy(F.desc("avg_weekly_price"), "week_index", "name")
    return ranked.limit(1)


def station_context(
    df: DataFrame,
    stations: Sequence[int],
    first_day: str,
    last_day: str,
    *,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Prices of the given stations within a date range, in time order per station."""
    chosen = F.col("id").isin(list(stations))
    in_range = F.col("day_date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    order = ["id", "day_date", *tiebreak]
    return df.filter(chosen & in_range).orderBy(*order).select("id", "day_date", "prix", *tiebreak)


def first_rows(
    df: DataFrame, order: Sequence[str], n: int, columns: Sequence[str] | None = None
) -> DataFrame:
    """The first `n` rows in `order`, kept as a top-n so that no full sort is needed."""
    top = df.orderBy(*order).limit(n)
    return top if columns is None else top.select(*columns)


def sample_rows(
    df: DataFrame, keys: Sequence[str], fraction: float = 0.05, seed: int = 42
) -> DataFrame:
    return df.filter(key_hash_sample(keys, fraction, seed))


def station_series(
    predictions: DataFrame, station: int | None, *, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Actual and predicted prices of one station in time order; none for no station."""
    columns = ["day_date", "name", "prix", "prediction", *tiebreak]
    return predictions.filter(F.col("id") == F.lit(station)).select(*columns).orderBy("day_date", "name", *tiebreak)
