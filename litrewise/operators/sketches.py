"""Mergeable quantile sketches of days, kept beside a stage. Nothing here starts a Spark job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: with this size the rank error of a sketch, and of merged ones, stays below 0.001
# with a probability above 99 %. A sketch then holds some tens of thousands of numbers at most.
SKETCH_SIZE = 8192


def day_sketches(df: DataFrame, by: Sequence[str] = (), *, size: int = SKETCH_SIZE) -> DataFrame:
    """One sketch of the days of each group of `by`, with its rows (`n_rows`; rows without a day
    do not count). Partial sketches are merged before the shuffle, so a group is never one task's
    rows."""
    day = F.unix_date("day_date").cast("long")
    return df.groupBy(*by).agg(F.count("day_date").alias("n_rows"), F.kll_sketch_agg_bigint(day, size).alias("sketch"))


def merged_sketch(sketches: DataFrame, *, size: int = SKETCH_SIZE) -> DataFrame:
    """One row: the sketch of all rows that the given sketches stand for."""
    filled = sketches.filter("n_rows > 0")
    return filled.agg(F.sum("n_rows").alias("n_rows"), F.kll_merge_agg_bigint("sketch", size).alias("sketch"))


def sketched_day(merged: DataFrame, q: float = 0.8) -> DataFrame:
    """One row, `cut`: the day at the `q` quantile by a merged sketch; null if it has no rows."""
    number = F.when(F.col("n_rows") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)))
    return merged.select(F.date_from_unix_date(number.cast("int")).alias("cut"))


def rank_bounds(df: DataFrame, cut: DataFrame) -> DataFrame:
    """The shares of rows before the day `cut` (one row) and up to it, beside the cut."""
    dated = df.filter(F.col("day_date").isNotNull()).join(F.broadcast(cut.limit(1)))
    share = [F.avg(F.when(test, 1.0).otherwise(0.0)) for test in (F.col("day_date") < F.col("cut"), F.col("day_date") <= F.col("cut"))]
    return dated.groupBy("cut").agg(F.count(F.lit(1)).alias("n_rows"), share[0].alias("before"), share[1].alias("upto"))
