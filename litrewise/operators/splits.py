"""Chronological train and test splits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(cut: str | dt.date) -> Column:
    return F.lit(cut).cast("date")


def split_by_date(df: DataFrame, cut: str | dt.date) -> tuple[DataFrame, DataFrame]:
    """Rows before the cut day, and rows from the cut day on."""
    return df.filter(F.col("day_date") < _as_date(cut)), df.filter(F.col("day_date") >= _as_date(cut))


def with_part(df: DataFrame, cut: str | dt.date) -> DataFrame:
    """Both sides in one frame, told apart by `part`: train before the cut day, test from it on."""
    before = F.col("day_date") < _as_date(cut)
    dated = df.filter(F.col("day_date").isNotNull())
    return dated.withColumn("part", F.when(before, "train").otherwise("test"))


def quantile_day(df: DataFrame, q: float = 0.8, *, accuracy: int | None = None) -> DataFrame:
    """One row, `cut`: the day at the `q` quantile of all rows.

    The exact form keeps one counter per distinct day and merges those, so its state is
    bounded by the calendar. With `accuracy` a sketch of relative error 1/accuracy is
    used. Days are counted as day numbers, so the session time zone has no influence.
    """
    days = df.select(F.unix_date("day_date").alias("d"))
    if accuracy is None:
        number = F.expr(f"percentile_disc({q}) within group (order by d)")
    else:
        number = F.percentile_approx("d", q, accuracy)
    return days.agg(F.date_from_unix_date(number.cast("int")).alias("cut"))


def split_by_quantile(
    df: DataFrame, q: float = 0.8, *, accuracy: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split at `quantile_day`. The one date is fetched first: as a literal it reaches
    the scan, and the many jobs of a model fit do not compute it again."""
    cut = quantile_day(df, q, accuracy=accuracy).first()["cut"]
    return split_by_date(df, cut)


def split_counts(df: DataFrame, cut: str | dt.date) -> DataFrame:
    """Rows on each side of the cut, in one pass."""
    before = F.col("day_date") < _as_date(cut)
    part = F.when(before, "train").otherwise("test")
    dated = df.filter(F.col("day_date").isNotNull())
    return dated.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
