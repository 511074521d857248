"""Lags and rolling means by calendar days, where a day without a price is a gap. Nothing here
starts a Spark job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litrewise.operators.history import SERIES, check_depths


def days_ago_name(days: int) -> str:
    return f"price_{days}d_ago"


def rolling_days_name(days: int) -> str:
    return f"avg_last_{days}d"


def calendar_days(df: DataFrame, *, value: str = "prix", series: Sequence[str] = SERIES) -> DataFrame:
    """Sum and count of `value` per series and day: a series has no more rows than the calendar
    has days, however often its price changes."""
    return df.groupBy(*series, "day_date").agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))


def calendar_columns(days: DataFrame, lags: Sequence[int], rolling: int | None, series: Sequence[str] = SERIES) -> DataFrame:
    """Mean price exactly k days ago, and over the `rolling` days before the day, by range frames
    over day numbers; null where those days have no price."""
    number = F.unix_date("day_date")
    ordered = Window.partitionBy(*series).orderBy(number)

    def mean(first: int, last: int) -> Column:
        frame = ordered.rangeBetween(first, last)
        return F.try_divide(F.sum("_sum").over(frame), F.sum("_n").over(frame))

    columns = {days_ago_name(k): mean(-k, -k) for k in lags}
    if rolling is not None:
        columns[rolling_days_name(rolling)] = mean(-rolling, -1)
    return days.withColumns(columns).drop("_sum", "_n")


def add_calendar_history(
    df: DataFrame,
    *,
    lags: Sequence[int] = (1, 7),
    rolling: int | None = 7,
    value: str = "prix",
    series: Sequence[str] = SERIES,
) -> DataFrame:
    """Every observation with the calendar columns of its series and day.

    Days are summed first (before the shuffle where a task holds several prices of a day), so
    that the windows run over days and a series with very many observations does not make a
    large window. The join back deals by series and day. Rows without a day have no history;
    a null in `series` is an ordinary value. Raises ValueError for depths below 1.
    """
    check_depths(lags, rolling)
    dated = df.filter(F.col("day_date").isNotNull())
    days = calendar_columns(calendar_days(dated, value=value, series=series), lags, rolling, series)
    keys = [*series, "day_date"]
    renamed = days.withColumnsRenamed({c: f"_key_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return df.join(renamed, same, "left").drop(*[f"_key_{c}" for c in keys])
