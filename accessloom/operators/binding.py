"""Evaluate an expression once and use it many times.

Catalyst copies a projected expression into each of its uses, and common subexpressions
are only shared where they are evaluated unconditionally.  The output of a generator is
never copied, so a one-row generator pins a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with further columns, each computed exactly once per row."""
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.inline(F.array(row)))
