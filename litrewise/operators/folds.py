"""Rolling-origin evaluation: one pass over the predictions for all cuts. Nothing here starts a
Spark job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _days(cuts: Sequence[str | dt.date]) -> list[dt.date]:
    days = sorted({c if isinstance(c, dt.date) else dt.date.fromisoformat(c) for c in cuts})
    if not days:
        raise ValueError("name at least one cut day")
    return days


def segment_of(day: Column, cuts: Sequence[dt.date]) -> Column:
    """How many of the sorted cut days lie on or before the day."""
    return sum((F.when(day >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))


def segment_sums(df: DataFrame, cuts: Sequence[str | dt.date], *, prediction: str = "prediction", label: str = "prix") -> DataFrame:
    """Per chronological segment between cuts, sums that can be merged: rows, rows with both
    values, squared and absolute errors, and mean and squared deviations of the label."""
    both = F.when(F.col(prediction).isNotNull(), F.col(label))
    error = F.col(label) - F.col(prediction)
    return (
        df.filter(F.col("day_date").isNotNull())
        .groupBy(segment_of(F.col("day_date"), _days(cuts)).alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(error).alias("n"),
            F.sum(error * error).alias("squared"),
            F.sum(F.abs(error)).alias("absolute"),
            F.avg(both).alias("mean"),
            (F.var_pop(both) * F.count(both)).alias("deviation"),
        )
    )


def evaluate_by_cut(
    predictions: DataFrame, cuts: Sequence[str | dt.date], *, prediction: str = "prediction", label: str = "prix"
) -> DataFrame:
    """Per cut day and horizon: train and test rows, RMSE, MAE and R² of the test rows.

    Horizon `next` tests on the days up to the next cut, `rest` on all days from the cut on;
    train rows are those before the cut. Every row is read once and belongs to one segment; the
    folds are merged from the sums of the segments, one row for each cut. The variance of merged
    segments is that of their means plus those within, which is stable. Without test rows the
    metrics are null.
    """
    days = _days(cuts)
    sums = segment_sums(predictions, days, prediction=prediction, label=label)
    every = predictions.sparkSession.createDataFrame([(0, None), *[(i + 1, d) for i, d in enumerate(days)]], "segment int, cut date")
    rows = every.join(F.broadcast(sums), "segment", "left").na.fill(0, ["n_rows", "n", "squared", "absolute", "deviation"])
    # Means are taken from the mean of all, so that the small difference of large squares below
    # loses no digits.
    everything = Window.partitionBy()
    overall = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(everything), F.sum("n").over(everything))
    rows = rows.withColumn("shift", F.coalesce(F.col("mean") - overall, F.lit(0.0)))
    ordered = Window.orderBy("segment")  # one row for each cut
    spans = {"next": ordered.rowsBetween(0, 0), "rest": ordered.rowsBetween(0, Window.unboundedFollowing)}
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    folds = []
    for horizon, span in spans.items():
        n = F.sum("n").over(span)
        centre = F.try_divide(F.sum(F.col("n") * F.col("shift")).over(span), n)
        folds.append(
            F.struct(
                F.lit(horizon).alias("horizon"),
                F.sum("n_rows").over(span).alias("n_test"),
                n.alias("n"),
                F.sum("squared").over(span).alias("squared"),
                F.sum("absolute").over(span).alias("absolute"),
                F.sum("deviation").over(span).alias("within"),
                F.sum(F.col("n") * F.col("shift") * F.col("shift")).over(span).alias("moment"),
                centre.alias("centre"),
            )
        )
    merged = rows.select("cut", F.sum("n_rows").over(before).alias("n_train"), F.array(*folds).alias("folds"))
    merged = merged.filter(F.col("cut").isNotNull()).select("cut", "n_train", F.explode("folds").alias("f")).select("cut", "n_train", "f.*")
    total = F.col("within") + F.coalesce(F.col("moment") - F.col("n") * F.col("centre") * F.col("centre"), F.lit(0.0))
    return merged.select(
        "cut",
        "horizon",
        "n_train",
        "n_test",
        F.sqrt(F.try_divide(F.col("squared"), F.col("n"))).alias("rmse"),
        F.try_divide(F.col("absolute"), F.col("n")).alias("mae"),
        F.when(F.col("n") > 0, F.lit(1) - F.try_divide(F.col("squared"), total)).alias("r2"),
    )
