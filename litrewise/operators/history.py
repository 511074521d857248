"""Lag and rolling features over each station and fuel's own past. Nothing here starts a job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F

SERIES = ("id", "name")
ORDER = ("day_date", "date_parsed", "prix")


def lag_name(rows: int) -> str:
    return f"price_lag_{rows}"


def rolling_name(rows: int) -> str:
    return f"rolling_avg_{rows}"


def check_depths(lags: Sequence[int], rolling: int | None) -> None:
    if any(k < 1 for k in lags) or (rolling is not None and rolling < 1):
        raise ValueError("lags and rolling count rows of the past: 1 or more")


def history_columns(
    window: WindowSpec, lags: Sequence[int], rolling: int | None, value: str
) -> dict[str, Column]:
    columns = {lag_name(k): F.lag(value, k).over(window) for k in lags}
    if rolling is not None:
        columns[rolling_name(rolling)] = F.avg(value).over(window.rowsBetween(-rolling, -1))
    return columns


def add_history(
    df: DataFrame,
    *,
    lags: Sequence[int] = (1, 7),
    rolling: int | None = 7,
    value: str = "prix",
    series: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add `price_lag_k` and `rolling_avg_n`, counted in rows of the same series.

    The rolling mean covers the `rolling` rows before the current one, fewer at the
    start of a series. `order` should be total within a series; rows equal in the
    default order carry the same price, so their features do not depend on which comes
    first. All columns share one window: one shuffle and one sort, with a task for each
    series. `plans.history` does the same for series too long for a task.

    Raises ValueError for lags or a rolling width below 1.
    """
    check_depths(lags, rolling)
    window = Window.partitionBy(*series).orderBy(*order)
    return df.withColumns(history_columns(window, lags, rolling, value))


def piece_history(
    pieces: DataFrame,
    *,
    lags: Sequence[int] = (1, 7),
    rolling: int | None = 7,
    value: str = "prix",
    series: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The columns of `add_history` for series cut into pieces.

    `pieces` is range-partitioned on series and order, with the number of the part as
    `_piece` and a last tie-break `_salt`, both fixed. A window per piece serves every row
    with enough rows before it in its piece. The first rows of each piece get theirs from a
    second window over only the first and last rows of all pieces: whatever precedes such a
    row within the depth is among them.
    """
    check_depths(lags, rolling)
    depth = max([*lags, rolling or 0])
    piece = Window.partitionBy(*series, "_piece")
    ordered = piece.orderBy(*order, "_salt")
    ranked = pieces.withColumns(
        {
            **history_columns(ordered, lags, rolling, value),
            "_rank": F.row_number().over(ordered),
            "_size": F.count(F.lit(1)).over(piece),
        }
    )
    helpers = ["_salt", "_piece", "_rank", "_size"]
    inner = ranked.filter(F.col("_rank") > depth).drop(*helpers)
    whole = Window.partitionBy(*series).orderBy(*order, "_salt")
    edges = (
        ranked.filter((F.col("_rank") <= depth) | (F.col("_rank") > F.col("_size") - depth))
        .withColumns(history_columns(whole, lags, rolling, value))
        .filter(F.col("_rank") <= depth)
        .drop(*helpers)
    )
    return inner.unionByName(edges)


def complete(columns: Sequence[str], types: dict[str, str]) -> Column:
    """Whether no column holds a null or, for floating-point numbers, a NaN."""
    tests = [
        F.col(c).isNotNull() & ~F.isnan(c) if types[c] in ("float", "double") else F.col(c).isNotNull()
        for c in columns
    ]
    return reduce(Column.__and__, tests, F.lit(True))


def daily_means(
    df: DataFrame, *, value: str = "prix", context: Sequence[str] = ("lat", "long")
) -> DataFrame:
    """One row per station, fuel and day, so that row lags become observed-day lags.

    `value` is averaged; `context` columns keep their smallest value of the day.
    """
    kept = [F.min(c).alias(c) for c in context]
    return df.groupBy(*SERIES, "day_date").agg(F.avg(value).alias(value), *kept)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column, or in any column of `subset`."""
    return df.dropna(subset=list(subset) if subset is not None else None)
