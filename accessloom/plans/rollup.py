"""Answers from a rollup: a row per minute instead of a row per request.

A rollup keeps requests, bytes and failures of each minute, and a sketch of its visitors.  Sums
add up and sketches merge, so any span of minutes is answered without the rows: counts and bytes
exactly, visitors within the error of the sketch.  With ``by`` there is a row for each minute and
value of these columns, for rankings of any span.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accessloom.functions.measures import kilobytes
from accessloom.operators.ranking import largest
from accessloom.sources.derived import keep_up, read_part
from accessloom.sources.tables import PERIOD

#: Logarithm of a sketch's registers: about 1.6 % standard error in at most 4 KB.
PRECISION = 12


def roll_up(rows: DataFrame, by: tuple[str, ...] = (), precision: int = PRECISION) -> DataFrame:
    """``period, minute``, the columns of ``by``, ``pv_num, failed, bytes_sent, request_length, visitors``."""
    minute = F.expr("timestamp div 60 * 60").alias("minute")
    period = [F.col(PERIOD)] if PERIOD in rows.columns else []
    sums = [F.sum(c).alias(c) for c in ("bytes_sent", "request_length") if c in rows.columns]
    return rows.groupBy(*period, minute, *by).agg(
        F.count("*").alias("pv_num"), F.count_if(F.col("status_code") != 200).alias("failed"), *sums,
        F.hll_sketch_agg("ip", F.lit(precision)).alias("visitors"),
    )


def keep_rollup(
    spark: SparkSession, access: str, rollup: str, *, by: tuple[str, ...] = (), precision: int = PRECISION,
    schema: StructType | None = None,
) -> list[str]:
    """Bring a stored rollup up to date with the access table; the periods made again."""
    make = functools.partial(roll_up, by=by, precision=precision)
    return keep_up(spark, access, rollup, {"minutes": make}, schema=schema)


def read_rollup(spark: SparkSession, rollup: str, *, periods: list[str] | None = None) -> DataFrame:
    return read_part(spark, rollup, "minutes", periods=periods)


def in_span(rollup: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Minutes from the epoch second ``first`` on and before ``last``; both must be whole minutes."""
    if any(t is not None and t % 60 for t in (first, last)):
        raise ValueError("a rollup has whole minutes only")
    if first is not None:
        rollup = rollup.filter(F.col("minute") >= first)
    return rollup if last is None else rollup.filter(F.col("minute") < last)


def visitors_error(precision: int = PRECISION) -> float:
    """Three standard errors of a merged sketch, relative."""
    return 3 * 1.04 / math.sqrt(1 << precision)


def totals(rollup: DataFrame, seconds: int | None = None) -> DataFrame:
    """Requests, failures, bytes and estimated visitors of the whole span, or of steps of it."""
    if seconds is not None and seconds % 60:
        raise ValueError("a rollup has whole minutes only")
    sums = [F.sum(c).alias(c) for c in ("pv_num", "failed", "bytes_sent", "request_length") if c in rollup.columns]
    visitors = F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("ip_num")
    if seconds is None:
        return rollup.agg(*sums, F.coalesce(visitors, F.lit(0)).alias("ip_num"))
    step = F.expr(f"minute div {seconds} * {seconds}").alias("time_str")
    return rollup.groupBy(step).agg(*sums, visitors)


def network_traffic(rollup: DataFrame, seconds: int = 60) -> DataFrame:
    """Kilobytes out and in, for each step."""
    sums = totals(rollup.drop("visitors").withColumn("visitors", F.lit(None).cast("binary")), seconds)
    return sums.select(
        kilobytes(F.col("bytes_sent")).alias("out_network"), kilobytes(F.col("request_length")).alias("in_network"), "time_str")


def top(rollup: DataFrame, key: str, limit: int | None = 10) -> DataFrame:
    """The values of ``key``, one of the columns the rollup was made ``by``, with most requests."""
    counted = rollup.groupBy(key).agg(F.sum("pv_num").alias("total_num")).select("total_num", key)
    return largest(counted, "total_num", key, limit=limit)
