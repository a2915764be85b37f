"""Equi-join on the first characters of a name, first match wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessloom.functions.text import first_chars


def prefix_join(
    df: DataFrame, dim: DataFrame, *, key: str, dim_key: str, dim_order: str, n: int = 2
) -> DataFrame:
    """Inner join of ``df.key`` and ``dim.dim_key`` on their first ``n`` characters.

    Of several dimension rows with one prefix the first by ``dim_order`` counts.  Which
    side is broadcast, if any, is left to the sizes seen while running.
    """
    unique = (
        dim.groupBy(first_chars(F.col(dim_key), n).alias("__prefix"))
        .agg(F.min_by(F.struct(*dim.columns), dim_order).alias("__first"))
        .select("__prefix", "__first.*")
    )
    return df.withColumn("__prefix", first_chars(F.col(key), n)).join(unique, "__prefix").drop("__prefix")
