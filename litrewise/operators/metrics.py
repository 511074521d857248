"""Accuracy measures of predictions, each set from a single pass."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("rmse", "mae", "r2")


def metric_columns(prediction: str = "prediction", label: str = "prix") -> dict[str, Column]:
    """RMSE, MAE and R² as aggregates; the variance is the numerically stable one."""
    error = F.col(label) - F.col(prediction)
    squared = F.sum(error * error)
    both = F.when(F.col(prediction).isNotNull(), F.col(label))
    total = F.var_pop(both) * F.count(error)
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": F.lit(1) - F.try_divide(squared, total),
    }


def evaluate(
    predictions: DataFrame, *, prediction: str = "prediction", label: str = "prix"
) -> DataFrame:
    columns = metric_columns(prediction, label)
    return predictions.agg(*[c.alias(name) for name, c in columns.items()])


def evaluate_side_by_side(
    predictions: DataFrame, models: Mapping[str, str], *, label: str = "prix"
) -> DataFrame:
    """One row per model from one frame that holds a prediction column per model."""
    rows = [
        F.struct(
            F.lit(model).alias("model"),
            *[c.alias(name) for name, c in metric_columns(column, label).items()],
        )
        for model, column in models.items()
    ]
    return predictions.agg(F.explode(F.array(*rows)).alias("m")).select("m.*")


def value_range(*frames: DataFrame, label: str = "prix", prediction: str = "prediction") -> DataFrame:
    """Smallest and largest value among actual and predicted prices of all frames."""
    pairs = reduce(DataFrame.union, [f.select(label, prediction) for f in frames])
    return pairs.agg(
        F.least(F.min(label), F.min(prediction)).alias("lower"),
        F.greatest(F.max(label), F.max(prediction)).alias("upper"),
    )
