"""The traffic questions, as functions from the access table to a result.

``as_of`` is the day (or, where an hour is asked about, any time in it) that counts as
now.  Day questions cover ``[as_of, as_of + 1 day)``; ``open_ended=True`` drops the upper
bound and counts everything since midnight.  All bounds are written as ranges on the
stored epoch, which Parquet can skip by.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessloom.functions.measures import kilobytes, whole
from accessloom.functions.network import UNRESOLVED
from accessloom.functions.text import fulltext, has_substring, has_word
from accessloom.functions.times import as_day, as_hour, clock_label, epoch_of, millis, minute_of
from accessloom.operators.prefix_join import prefix_join
from accessloom.operators.ranking import largest, with_percent

Day = dt.date | str
Moment = dt.datetime | str


def in_day(as_of: Day, open_ended: bool = False) -> Column:
    day = as_day(as_of)
    since = F.col("timestamp") >= epoch_of(f"{day} 00:00:00")
    if open_ended:
        return since
    return since & (F.col("timestamp") < epoch_of(f"{day + dt.timedelta(days=1)} 00:00:00"))


def on_day_text(as_of: Day) -> Column:
    """The same day by the first characters of ``time_str``, for tables without ``timestamp``."""
    return F.startswith("time_str", F.lit(str(as_day(as_of))))


def in_hour(as_of: Moment) -> Column:
    hour = as_hour(as_of)
    start = epoch_of(f"{hour:%Y-%m-%d %H:%M:%S}")
    return (F.col("timestamp") >= start) & (F.col("timestamp") < start + 3600)


def _needed(name: str, value) -> str:
    if value is None or value == "":
        raise ValueError(f"missing argument: {name}")
    return str(value)


def _status(code: str | int) -> int:
    digits = "".join(c for c in _needed("code", code) if c in "0123456789")
    return int(_needed("code", digits))


def _counted(rows: DataFrame, key: str, name: str = "total_num") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name)).select(name, key)


# ---------------------------------------------------------------- totals

def total_ip(
    access: DataFrame, as_of: Day, *, rsd: float | None = None, open_ended: bool = False
) -> DataFrame:
    """Visitors; exact unless a relative error ``rsd`` is allowed."""
    visitors = F.count_distinct("ip") if rsd is None else F.approx_count_distinct("ip", rsd)
    return access.filter(in_day(as_of, open_ended)).agg(visitors.alias("total_num"))


def total_pv(access: DataFrame, as_of: Day, *, open_ended: bool = False) -> DataFrame:
    return access.filter(in_day(as_of, open_ended)).agg(F.count("*").alias("total_num"))


# ---------------------------------------------------------------- rankings

def request_num_by_url(
    access: DataFrame, as_of: Day, *, limit: int | None = 10, open_ended: bool = False
) -> DataFrame:
    counted = _counted(access.filter(in_day(as_of, open_ended)), "request_url")
    return largest(counted, "total_num", "request_url", limit=limit)


def request_num_by_ip(
    access: DataFrame, as_of: Day, *, limit: int | None = 50, open_ended: bool = False
) -> DataFrame:
    counted = _counted(access.filter(in_day(as_of, open_ended)), "ip")
    return largest(counted, "total_num", "ip", limit=limit)


def request_urls_by_ip(
    access: DataFrame, as_of: Day, *, ip: str | None = None, limit: int | None = 50,
    open_ended: bool = False,
) -> DataFrame:
    rows = access.filter(in_day(as_of, open_ended) & (F.col("ip") == _needed("ip", ip)))
    return largest(_counted(rows, "request_url"), "total_num", "request_url", limit=limit)


def request_num_by_status(
    access: DataFrame, as_of: Day, *, limit: int | None = 50, percent: bool = False,
    open_ended: bool = False,
) -> DataFrame:
    rows = access.filter(in_day(as_of, open_ended) & (F.col("status_code") != 200))
    top = largest(_counted(rows, "status_code"), "total_num", "status_code", limit=limit)
    return with_percent(top, "total_num") if percent else top


def request_num_by_status_code(
    access: DataFrame, as_of: Day, *, code: str | int | None = None, limit: int | None = 30,
    open_ended: bool = False,
) -> DataFrame:
    rows = access.filter(in_day(as_of, open_ended) & (F.col("status_code") == _status(code)))
    return largest(_counted(rows, "request_url"), "total_num", "request_url", limit=limit)


def request_num_by_province(
    access: DataFrame, as_of: Day, *, keep_unresolved: bool = False, open_ended: bool = False
) -> DataFrame:
    rows = access.filter(in_day(as_of, open_ended))
    if not keep_unresolved:
        rows = rows.filter(F.col("province") != UNRESOLVED)
    return largest(_counted(rows, "province", "value"), "value", "province", limit=None)


# ---------------------------------------------------------------- series

def _newest(df: DataFrame, limit: int | None, time: str = "time_str") -> DataFrame:
    """The newest buckets, oldest first; buckets without rows do not occur."""
    if limit is not None:
        df = df.orderBy(F.desc(time)).limit(limit)
    return df.orderBy(time)


def _when(as_of: Day | Moment, span: str, open_ended: bool) -> Column:
    if span == "hour":
        return in_hour(as_of)
    if span == "day":
        return in_day(as_of, open_ended)
    raise ValueError("span must be 'hour' or 'day'")


def network_traffic_by_minute(
    access: DataFrame, as_of: Moment, *, limit: int | None = 10, rounded: bool = True,
    span: str = "hour", open_ended: bool = False,
) -> DataFrame:
    """Kilobytes out and in per minute of the hour (or day) of ``as_of``."""
    sent, received = F.sum("bytes_sent"), F.sum("request_length")
    out, into = (kilobytes(c) if rounded else c / 1024 for c in (sent, received))
    rows = access.filter(_when(as_of, span, open_ended))
    series = rows.groupBy(minute_of(F.col("timestamp")).alias("time_str")).agg(
        out.alias("out_network"), into.alias("in_network")
    )
    return _newest(series.select("out_network", "in_network", "time_str"), limit)


def ip_pv_num_by_minute(
    access: DataFrame, as_of: Moment, *, limit: int | None = 10, span: str = "hour",
    open_ended: bool = False,
) -> DataFrame:
    """Visitors and requests per minute of the hour (or day) of ``as_of``."""
    rows = access.filter(_when(as_of, span, open_ended))
    series = rows.groupBy(minute_of(F.col("timestamp")).alias("time_str")).agg(
        F.count_distinct("ip").alias("ip_num"), F.count("*").alias("pv_num")
    )
    return _newest(series.select("ip_num", "pv_num", "time_str"), limit)


def ip_num_by_minute(access: DataFrame, as_of: Moment, **options) -> DataFrame:
    return ip_pv_num_by_minute(access, as_of, **options).select("ip_num", "time_str")


def pv_num_by_minute(
    access: DataFrame, as_of: Moment, *, limit: int | None = 10, span: str = "hour",
    open_ended: bool = False,
) -> DataFrame:
    rows = access.filter(_when(as_of, span, open_ended))
    series = rows.groupBy(minute_of(F.col("timestamp")).alias("time_str")).agg(
        F.count("*").alias("pv_num")
    )
    return _newest(series.select("pv_num", "time_str"), limit)


CHART = "chart"     # as many seconds as the chart shows


def request_num_by_seconds(
    access: DataFrame, as_of: Day, *, init: bool = False, limit: int | None | str = CHART,
    open_ended: bool = False,
) -> DataFrame:
    """Requests per second, the newest 600 to fill a chart or the newest 5 to update it.

    ``limit`` takes another number, or None for all.  ``timestamp`` is in milliseconds.
    """
    if limit == CHART:
        limit = 600 if init else 5
    rows = access.filter(in_day(as_of, open_ended))
    series = rows.groupBy("timestamp").agg(F.count("*").alias("total_request_num"))
    newest = series if limit is None else series.orderBy(F.desc("timestamp")).limit(limit)
    return newest.select(
        millis(F.col("timestamp")).alias("timestamp"), "total_request_num"
    ).orderBy("timestamp")


# ---------------------------------------------------------------- user agents

def spider_by_ua(
    access: DataFrame, as_of: Day | None = None, *, match: str = "word", percent: bool = False,
    ascending: bool = False, open_ended: bool = False,
) -> DataFrame:
    """Requests per crawler; all dates unless ``as_of`` is given."""
    ua = F.col("ua")
    if match == "word":
        found = has_word(ua, "spider")
    elif match == "substring":
        found = has_substring(ua, "spider")
    else:
        raise ValueError("match must be 'word' or 'substring'")
    if as_of is not None:
        found = in_day(as_of, open_ended) & found
    counted = _counted(access.filter(found), "ua")
    if percent:
        counted = with_percent(counted, "total_num")
    return largest(counted, "total_num", "ua", limit=None, ascending_output=ascending)


def device_type_by_ua(
    access: DataFrame, as_of: Day | None = None, *, open_ended: bool = False
) -> DataFrame:
    """Distinct desktop and mobile user agents; all dates unless ``as_of`` is given.

    Agents are made distinct first, so each is searched once however often it occurs.
    """
    rows = access if as_of is None else access.filter(in_day(as_of, open_ended))
    ua = F.col("ua")
    return rows.select("ua").distinct().agg(
        F.count_if(fulltext(ua, "+gecko -mobile", "boolean")).alias("pc_num"),
        F.count_if(fulltext(ua, "mobile xfb", "boolean")).alias("mobile_num"),
    )


# ---------------------------------------------------------------- dashboard figures

def map_flows(
    by_province: DataFrame, geometry: DataFrame, *, to_name: str, to_center: list[float]
) -> DataFrame:
    """Lines from each province to one place.

    ``by_province`` is the result of :func:`request_num_by_province`; ``geometry`` has
    ``ord, name, center``.  Provinces without geometry are left out.
    """
    matched = prefix_join(by_province, geometry, key="province", dim_key="name", dim_order="ord")
    target = F.array(*[F.lit(float(x)) for x in to_center])
    return matched.select(
        F.col("name").alias("fromName"), F.lit(to_name).alias("toName"),
        F.array("center", target).alias("coords"), "value",
    )


def map_points(by_province: DataFrame, geometry: DataFrame) -> DataFrame:
    """Name, and centre followed by the count, of each province on the map."""
    matched = prefix_join(by_province, geometry, key="province", dim_key="name", dim_order="ord")
    point = F.concat("center", F.array(F.col("value").cast("double")))
    return matched.select("name", point.alias("value"))


def traffic_chart(traffic: DataFrame) -> DataFrame:
    """Whole kilobytes and ``HH:mm`` labels for :func:`network_traffic_by_minute`."""
    return traffic.select(
        whole(F.col("in_network")).alias("in_network"),
        whole(F.col("out_network")).alias("out_network"),
        clock_label(F.col("time_str")).alias("label"),
        "time_str",
    ).orderBy("time_str").drop("time_str")


def status_chart(by_status: DataFrame) -> DataFrame:
    """Labels and shares for :func:`request_num_by_status`."""
    return with_percent(by_status, "total_num").select(
        F.concat(F.lit("状态码："), F.col("status_code").cast("string")).alias("label"),
        "total_num", "percent",
    )
