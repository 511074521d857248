"""Location expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coordinates are stored as degrees times 100000, postal codes have five
# characters and start with the two-character department code.
COORDINATE_SCALE = 100000
POSTAL_CODE_WIDTH = 5
DEPARTMENT_WIDTH = 2


def degrees(stored: Column) -> Column:
    return stored / F.lit(COORDINATE_SCALE)


def department(postal_code: Column) -> Column:
    """Department of a postal code; a code read as a number gets its lost zero back."""
    padded = F.lpad(postal_code.cast("string"), POSTAL_CODE_WIDTH, "0")
    return F.substring(padded, 1, DEPARTMENT_WIDTH)
