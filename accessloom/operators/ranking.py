"""Top-k and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessloom.functions.measures import percent


def largest(df: DataFrame, by: str, *ties: str, limit: int | None, ascending_output: bool = True) -> DataFrame:
    """The ``limit`` rows with the largest ``by``; ties go to the smaller ``ties`` values.

    Output is smallest first, as charts want it, unless told otherwise.
    """
    if limit is not None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        df = df.orderBy(F.desc(by), *ties).limit(limit)
    if ascending_output:
        return df.orderBy(F.asc(by), *[F.desc(t) for t in ties])
    return df.orderBy(F.desc(by), *ties)


def with_percent(df: DataFrame, part: str, name: str = "percent") -> DataFrame:
    """Add each row's share of the total over the whole result.

    The total is a scalar subquery, so rows are not gathered in one task for it.
    """
    total = df.agg(F.sum(part).alias("total")).scalar()
    return df.withColumn(name, percent(F.col(part), total))
