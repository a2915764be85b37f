"""Column expressions over measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kilobytes(total_bytes: Column) -> Column:
    return F.round(total_bytes / 1024, 2)


def whole(col: Column) -> Column:
    """Rounded to an integer for charts."""
    return F.round(col, 0).cast("bigint")


def three_places(col: Column) -> Column:
    return F.round(col, 3).cast("double")


def percent(part: Column, total: Column) -> Column:
    """Share in percent with two decimals, rounded half up in whole numbers."""
    hundredths = F.call_function("div", part * 20000 + total, total * 2)
    return hundredths / F.lit(100.0)
