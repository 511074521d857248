"""Price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_index(price: Column, average: Column, *, digits: int | None = 2) -> Column:
    """Price relative to an average, 100 meaning equal; null when the average is zero."""
    relative_gap = F.try_divide(price - average, average)
    index = F.lit(100) * (relative_gap + F.lit(1))
    return index if digits is None else F.round(index, digits)
