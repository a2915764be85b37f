"""Exact distinct counts by grouping twice.

The first grouping leaves one row per value, the second counts rows.  No task ever holds
the set of values of a group, and it is the form a stream accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_and_all(
    df: DataFrame, value: str, *keys: Column | str, distinct: str = "ip_num", total: str = "pv_num"
) -> DataFrame:
    """Per ``keys``: how many different ``value`` there are, and how many rows."""
    per_value = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    names = [c for c in per_value.columns if c not in (value, "__n")]
    return per_value.groupBy(*names).agg(
        F.count(value).alias(distinct), F.sum("__n").alias(total)
    )
