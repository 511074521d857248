"""Headline numbers of any selection from a small cube. Nothing here starts a Spark job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: two to this power counters. Counts of stations are exact, but for rounding, up to
# about 1,500 of them; above, the relative standard error is 1.04 / sqrt(2^14) = 0.8 %.
STATION_BITS = 14

CELL = ("year", "name")


def headline_cube(df: DataFrame, cell: Sequence[str] = CELL, *, bits: int = STATION_BITS) -> DataFrame:
    """Per cell: rows, prices, sum of prices, and a mergeable sketch of the stations.

    Sums and sketches are merged before the shuffle, so that no cell is one task's rows; the
    cube has a row for each year and fuel, however many observations there are.
    """
    return df.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("prix").alias("n_prices"),
        F.sum("prix").alias("total"),
        F.hll_sketch_agg("id", F.lit(bits)).alias("stations"),
    )


def cube_headlines(cube: DataFrame, selection: Column | None = None) -> DataFrame:
    """`reports.headline_numbers` of the cells that `selection` (a condition on the cell's
    columns) names, without reading observations; zeros for an empty selection."""
    cells = cube if selection is None else cube.filter(selection)
    return cells.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.try_divide(F.sum("total"), F.sum("n_prices")), F.lit(0.0)).alias("avg_price"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("stations")), F.lit(0)).alias("n_stations"),
    )


def years_and_fuels(years: Sequence[int], names: Sequence[str]) -> Column:
    """The selection of some years and fuels; an empty list selects nothing."""
    return F.col("year").isin(list(years)) & F.col("name").isin(list(names))
