"""Column expressions over log times.

The offset in the log is ignored unless asked for: the wall clock is read in the
session time zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
PERIODS = ("day", "week", "month", "year")

_TIME_STR = "yyyy-MM-dd HH:mm:ss"
_OFFSET = r"\s*[+-]\d{2}:?\d{2}$"


def _wall_clock_local(clean: Column) -> Column:
    """``11/Sep/2020:15:20:43`` -> ``2020-09-11 15:20:43`` by position."""
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(clean, 4, 3)))
    month = F.lpad((F.floor((at - 1) / 4) + 1).cast("string"), 2, "0")
    shape = (
        (F.substring(clean, 3, 1) == "/") & (F.substring(clean, 7, 1) == "/")
        & (F.substring(clean, 12, 1) == ":") & (at % 4 == 1)
    )
    return F.when(
        shape,
        F.concat(
            F.substring(clean, 8, 4), F.lit("-"), month, F.lit("-"),
            F.substring(clean, 1, 2), F.lit(" "), F.substring(clean, 13, 8),
        ),
    )


def _wall_clock_iso(clean: Column) -> Column:
    """``2020-09-11T15:20:43`` -> ``2020-09-11 15:20:43`` by position."""
    return F.when(
        F.substring(clean, 11, 1) == "T",
        F.concat(F.substring(clean, 1, 10), F.lit(" "), F.substring(clean, 12, 8)),
    )


_LENGTH = {"time_local": 20, "time_iso8601": 19}
_PATTERN = {"time_local": "d/MMM/yyyy:H:m:s", "time_iso8601": "yyyy-M-d'T'H:m:s"}


def clean_time(raw: Column) -> Column:
    bracketed = F.contains(raw, F.lit("[")) | F.contains(raw, F.lit("]"))
    return F.trim(F.when(bracketed, F.translate(raw, "[]", "")).otherwise(raw))


def wall_clock(clean: Column, layout: str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` as logged, read by position; NULL for unusual widths."""
    rest = F.ltrim(F.substr(clean, F.lit(_LENGTH[layout] + 1)))
    wall = _wall_clock_local(clean) if layout == "time_local" else _wall_clock_iso(clean)
    offset = (rest == "") | rest.startswith("+") | F.rlike(rest, F.lit(r"^-\d{2}:?\d{2}$"))
    return F.when(offset, wall)


def event_time_of(clean: Column, wall: Column, layout: str, honor_offset: bool = False) -> Column:
    """The instant, from the wall clock where there is one, else by (slower) pattern."""
    bare = F.regexp_replace(F.split_part(clean, F.lit("+"), F.lit(1)), _OFFSET, "")
    time = F.coalesce(
        wall.try_cast("timestamp"), F.try_to_timestamp(F.trim(bare), F.lit(_PATTERN[layout]))
    )
    if not honor_offset:
        return time
    sign_hours = F.regexp_extract(clean, r"([+-]\d{2}):?(\d{2})$", 1)
    minutes = F.regexp_extract(clean, r"([+-]\d{2}):?(\d{2})$", 2)
    zoned = F.concat(F.date_format(time, _TIME_STR), sign_hours, F.lit(":"), minutes)
    return F.when(sign_hours != "", zoned.try_cast("timestamp")).otherwise(time)


def time_columns(event_time: Column, wall: Column, honor_offset: bool = False) -> dict[str, Column]:
    """``time_str``, ``timestamp`` (epoch seconds) and ``event_time``; NULL if unreadable."""
    text = F.date_format(event_time, _TIME_STR)
    if not honor_offset:
        text = F.when(event_time.isNotNull() & (F.length(wall) == 19), wall).otherwise(text)
    return {"time_str": text, "timestamp": event_time.cast("long"), "event_time": event_time}


def time_parts(raw: Column, layout: str, honor_offset: bool = False) -> dict[str, Column]:
    """The three time columns of a ``time_local`` or ``time_iso8601`` value."""
    if layout not in _LENGTH:
        raise ValueError(f"unknown time layout {layout!r}")
    clean = clean_time(raw)
    wall = wall_clock(clean, layout)
    return time_columns(event_time_of(clean, wall, layout, honor_offset), wall, honor_offset)


def minute_of(epoch: Column) -> Column:
    """Epoch second of the start of the minute."""
    return epoch - F.pmod(epoch, F.lit(60))


def millis(epoch: Column) -> Column:
    return epoch * 1000


def clock_label(epoch: Column) -> Column:
    """``HH:mm`` in the session time zone."""
    return F.date_format(F.timestamp_seconds(epoch), "HH:mm")


def date_text(epoch: Column) -> Column:
    return F.from_unixtime(epoch, "yyyy-MM-dd")


def period_of(time: Column, split_save: str) -> Column:
    """Suffix of the table a row belongs to."""
    if split_save == "day":
        return F.date_format(time, "yyyy_MM_dd")
    if split_save == "week":
        monday = F.date_trunc("week", time)
        return F.concat_ws(
            "_", F.date_format(monday, "yyyy_MM_dd"), F.date_format(F.date_add(monday, 6), "dd")
        )
    if split_save == "month":
        return F.date_format(time, "yyyy_MM")
    if split_save == "year":
        return F.date_format(time, "yyyy")
    raise ValueError(f"split_save must be one of {', '.join(PERIODS)}")


def period_name(day: dt.date, split_save: str) -> str:
    """The same suffix for a known day, for partition filters."""
    if split_save == "day":
        return f"{day:%Y_%m_%d}"
    if split_save == "week":
        monday = day - dt.timedelta(days=day.weekday())
        return f"{monday:%Y_%m_%d}_{monday + dt.timedelta(days=6):%d}"
    if split_save == "month":
        return f"{day:%Y_%m}"
    if split_save == "year":
        return f"{day:%Y}"
    raise ValueError(f"split_save must be one of {', '.join(PERIODS)}")


def epoch_of(text: str) -> Column:
    """A literal epoch second for ``yyyy-MM-dd[ HH:mm:ss]`` in the session time zone.

    Folded to a constant while planning, so comparisons with it reach the scan.
    """
    return F.lit(text).cast("timestamp").cast("long")


def as_day(day: dt.date | str) -> dt.date:
    if isinstance(day, dt.datetime):
        return day.date()
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def as_hour(at: dt.datetime | str) -> dt.datetime:
    at = dt.datetime.fromisoformat(at) if isinstance(at, str) else at
    return at.replace(minute=0, second=0, microsecond=0)
