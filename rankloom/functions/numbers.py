"""Rounding and ratio helpers.

Every rounded figure goes through ``DECIMAL(18,6)`` first and is rounded half-up, so the
result does not depend on the last bits of a floating-point sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(18,6)"), digits).cast("double")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, 0.0 where the whole is zero or missing."""
    safe = F.coalesce(part, F.lit(0)) / F.nullif(whole, F.lit(0))
    return F.coalesce(rounded(safe, digits), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
