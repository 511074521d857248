"""History features for series of any length."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litrewise.operators.history import ORDER, SERIES, add_history, check_depths, piece_history
from litrewise.placement import fits_broadcast, settle

# A series longer than this is cut into pieces of about this many rows.
MAX_SERIES_ROWS = 1_000_000


def series_sizes(df: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Rows of each series (`n_rows`)."""
    return df.groupBy(*series).agg(F.count(F.lit(1)).alias("n_rows"))


def _matching(df: DataFrame, keys: DataFrame, series: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on the series columns, treating null as an ordinary value."""
    renamed = keys.select(*[F.col(c).alias(f"_key_{c}") for c in series])
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in series]
    return df.join(F.broadcast(renamed), reduce(Column.__and__, same), how)


def _pieces(df: DataFrame, n: int, series: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partitions as pieces; the random salt can part even equal rows, and writing
    the result freezes salt and partition number."""
    ranged = df.withColumn("_salt", F.rand(seed=17)).repartitionByRange(n, *series, *order, "_salt")
    return settle(ranged.withColumn("_piece", F.spark_partition_id()))


def with_history(
    df: DataFrame,
    sizes: DataFrame,
    *,
    lags: Sequence[int] = (1, 7),
    rolling: int | None = 7,
    value: str = "prix",
    series: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """`add_history`, with series above `max_series_rows` computed in pieces; equal results.

    `sizes` has the rows of each series (or more than those that are left in `df`), so that
    looking for long series reads that small table and not the observations.
    """
    check_depths(lags, rolling)
    depth = {"lags": lags, "rolling": rolling, "value": value, "series": series, "order": order}
    long_series = sizes.filter(F.col("n_rows") > max_series_rows)
    total = long_series.agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("rows")).first()
    if total["n"] == 0:
        return add_history(df, **depth)
    keys = settle(long_series.select(*series))
    if not fits_broadcast(keys):
        # Then nearly all series are long: cut all of them.
        rows = sizes.agg(F.sum("n_rows").alias("rows")).first()["rows"]
        return piece_history(_pieces(df, -(-rows // max_series_rows) + 1, series, order), **depth)
    ordinary = add_history(_matching(df, keys, series, "left_anti"), **depth)
    long_rows = _matching(df, keys, series, "left_semi")
    pieces = _pieces(long_rows, -(-total["rows"] // max_series_rows) + 1, series, order)
    return ordinary.unionByName(piece_history(pieces, **depth))
