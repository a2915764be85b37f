"""Live versions of the traffic questions, on a stream of parsed rows.

Series are append or update streams whose state ends with the watermark.  Late rows
beyond it are missing from the live series only, not from the stored table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessloom.functions.measures import kilobytes
from accessloom.functions.network import UNRESOLVED
from accessloom.functions.text import has_word
from accessloom.operators.distinct import distinct_and_all
from accessloom.operators.ranking import largest

LATE = "10 minutes"


def _bucket(width: str) -> Column:
    return F.window("event_time", width)


def _start() -> Column:
    return F.col("window.start").cast("long")


def live_pv_by_second(rows: DataFrame, late: str = LATE) -> DataFrame:
    counts = rows.withWatermark("event_time", late).groupBy(_bucket("1 second")).agg(
        F.count("*").alias("total_request_num")
    )
    return counts.select((_start() * 1000).alias("timestamp"), "total_request_num")


def live_traffic_by_minute(rows: DataFrame, late: str = LATE) -> DataFrame:
    sums = rows.withWatermark("event_time", late).groupBy(_bucket("1 minute")).agg(
        kilobytes(F.sum("bytes_sent")).alias("out_network"),
        kilobytes(F.sum("request_length")).alias("in_network"),
    )
    return sums.select("out_network", "in_network", _start().alias("time_str"))


def live_ip_pv_by_minute(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Exact visitors and requests per minute; a minute appears once it is complete.

    Two aggregations in a row, so a busy minute or address never gathers in one place.
    """
    watched = rows.withWatermark("event_time", late)
    per_minute = distinct_and_all(watched, "ip", _bucket("1 minute"))
    return per_minute.select("ip_num", "pv_num", _start().alias("time_str"))


def live_ip_pv_by_minute_estimate(rows: DataFrame, late: str = LATE, rsd: float = 0.02) -> DataFrame:
    """Estimated visitors, available while the minute is still running."""
    estimates = rows.withWatermark("event_time", late).groupBy(_bucket("1 minute")).agg(
        F.approx_count_distinct("ip", rsd).alias("ip_num"), F.count("*").alias("pv_num")
    )
    return estimates.select("ip_num", "pv_num", _start().alias("time_str"))


def live_ip_pv_by_minute_running(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Exact visitors and requests of minutes still open, in update mode.

    An address is new in its minute once: the state holds each (minute, address) spread over
    all tasks, until the watermark passes the minute.  A row then counts as a visit if it was the
    first, and as a request always, so a busy minute or address never gathers in one place.
    """
    watched = rows.withWatermark("event_time", late).select(_bucket("1 minute").alias("window"), "ip")
    first = watched.filter(F.col("ip").isNotNull()).dropDuplicates(["window", "ip"])
    one, none = F.lit(1), F.lit(0)
    both = first.select("window", one.alias("visit"), none.alias("hit")).unionByName(
        watched.select("window", none.alias("visit"), one.alias("hit")))
    sums = both.groupBy("window").agg(F.sum("visit").alias("ip_num"), F.sum("hit").alias("pv_num"))
    return sums.select("ip_num", "pv_num", _start().alias("time_str"))


def live_total_ip(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Exact visitors per day, once the day is complete."""
    watched = rows.withWatermark("event_time", late)
    per_day = distinct_and_all(watched, "ip", _bucket("1 day"))
    return per_day.select(F.col("ip_num").alias("total_num"), _start().alias("time_str"))


def live_total_ip_estimate(rows: DataFrame, late: str = LATE, rsd: float = 0.02) -> DataFrame:
    """Estimated visitors of the day so far."""
    estimates = rows.withWatermark("event_time", late).groupBy(_bucket("1 day")).agg(
        F.approx_count_distinct("ip", rsd).alias("total_num")
    )
    return estimates.select("total_num", _start().alias("time_str"))


def live_total_pv(rows: DataFrame, late: str = LATE) -> DataFrame:
    counts = rows.withWatermark("event_time", late).groupBy(_bucket("1 day")).agg(
        F.count("*").alias("total_num")
    )
    return counts.select("total_num", _start().alias("time_str"))


def _counted(rows: DataFrame, key: str, name: str = "total_num") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name)).select(name, key)


def live_request_num_by_url(rows: DataFrame, limit: int | None = 10) -> DataFrame:
    """Complete-mode ranking of all rows of the stream."""
    return largest(_counted(rows, "request_url"), "total_num", "request_url", limit=limit)


def live_request_num_by_ip(rows: DataFrame, limit: int | None = 50) -> DataFrame:
    return largest(_counted(rows, "ip"), "total_num", "ip", limit=limit)


def live_request_num_by_status(rows: DataFrame, limit: int | None = 50) -> DataFrame:
    failed = rows.filter(F.col("status_code") != 200)
    return largest(_counted(failed, "status_code"), "total_num", "status_code", limit=limit)


def live_request_num_by_province(rows: DataFrame) -> DataFrame:
    placed = rows.filter(F.col("province") != UNRESOLVED)
    return largest(_counted(placed, "province", "value"), "value", "province", limit=None)


def live_top(
    rows: DataFrame, key: str, limit: int = 10, *, width: str = "1 day", tracked: int = 10_000,
    late: str = LATE, where: Column | None = None,
) -> DataFrame:
    """The most frequent values of ``key`` in each bucket of time, with bounded state.

    A bucket keeps a summary of at most ``tracked`` values, built in every task and merged,
    whatever the number of values in the stream.  ``total_num`` is at most ``error`` above the
    true count and never below it; it is exact (``error`` 0) while no more rows came than the
    summary has room for, and within 3.5 / (room for values) of all rows of the bucket otherwise.
    A value with more than ``error`` rows is never missed if fewer than ``limit`` have more.
    """
    if not 0 < limit <= tracked <= 1_000_000:
        raise ValueError("limit must be at most tracked, and tracked at most 1,000,000")
    room = 1 << max(math.ceil(tracked / 0.75) - 1, 1).bit_length()
    watched = rows.withWatermark("event_time", late).filter(F.col(key).isNotNull())
    if where is not None:
        watched = watched.filter(where)
    summed = watched.groupBy(_bucket(width)).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {limit}, {tracked})").alias("top"))
    error = F.when(F.col("n") <= int(room * 0.75), 0).otherwise(F.floor(F.col("n") * 3.5 / room)).cast("long")
    return summed.select(_start().alias("time_str"), error.alias("error"), F.explode("top").alias("top")).select(
        "time_str", F.col("top.count").alias("total_num"), F.col("top.item").alias(key), "error")


def live_spider_by_ua(rows: DataFrame) -> DataFrame:
    spiders = rows.filter(has_word(F.col("ua"), "spider"))
    return largest(_counted(spiders, "ua"), "total_num", "ua", limit=None, ascending_output=False)
