"""Time expressions: tolerant parsing and the continuous week number."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the two accepted spellings of an observation time,
# "yyyy-MM-dd HH:mm:ss" and "yyyy-MM-ddTHH:mm:ss".
OBSERVED_AT_PATTERN = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"


def observed_at(text: Column) -> Column:
    """Timestamp of an observation, null when the text is not a valid time.

    The shape is tested first and the value is then cast. A formatter-based parse
    raises and catches a Java exception for every bad value; the cast does not.
    """
    return F.when(text.rlike(OBSERVED_AT_PATTERN), text.try_cast("timestamp"))


def week_number(day: Column, first_year: int, *, iso: bool = False) -> Column:
    """Week counter that runs on across years, 1 in the first week of `first_year`.

    By default the calendar year is combined with the ISO week of the year and a year
    counts as 52 weeks, which jumps at year edges (1 January may belong to week 52).
    With `iso=True` whole weeks are counted from the first ISO Monday of `first_year`.
    """
    if not iso:
        return (F.year(day) - F.lit(first_year)) * F.lit(52) + F.weekofyear(day)
    first_monday = dt.date.fromisocalendar(first_year, 1, 1)
    monday = F.trunc(day, "week")
    return (F.datediff(monday, F.lit(first_monday)) / F.lit(7)).cast("int") + F.lit(1)
