"""Column expressions shared by the operators; all stay inside JVM codegen."""

from litrewise.functions.calendar import observed_at, week_number
from litrewise.functions.geography import degrees, department
from litrewise.functions.pricing import price_index
from litrewise.functions.sampling import key_hash_sample

__all__ = [
    "degrees",
    "department",
    "key_hash_sample",
    "observed_at",
    "price_index",
    "week_number",
]
