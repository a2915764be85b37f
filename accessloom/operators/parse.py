"""Log lines to typed rows, in one pass over the lines whatever the number of formats."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessloom.functions import text, times
from accessloom.functions.network import UNRESOLVED
from accessloom.operators.binding import bind
from accessloom.operators.geo import GEO_COLUMNS, RangeTable, geo_join
from accessloom.sources import variables as v
from accessloom.sources.formats import FIELD_SEPARATOR, LogFormat

PARSE_OK = "parse_ok"
REASON = "reject_reason"
LINE = "rejected_line"

_LINE = "__line"
_FIELDS = "__fields"

_WIDE, _STEP = 20, 10     # columns from which on, and by which, they are computed in steps

_TIMES = (v.TIME_LOCAL, v.TIME_ISO8601)

Choice = tuple[Hashable, Column]


class _Layout:
    """Where the captures of several formats go.

    All formats share one row of slots, a slot per distinct variable, so that what
    follows the match is written once, not once per format.
    """

    def __init__(self, formats: Sequence[LogFormat], format_column: str | None) -> None:
        self.formats = formats
        self.format_column = format_column
        self.slots = list(dict.fromkeys(s for f in formats for s in f.slots))

    def field(self, slot: v.Variable) -> Column:
        return F.get(F.col(_FIELDS), F.lit(self.slots.index(slot) + 1))

    def fields_of(self, line: Column) -> Column:
        """All slots, after an empty one; anything else is no match."""
        return self.choose({
            f.name: (f.name, F.split(
                F.regexp_replace(line, F.lit(f.regex), F.lit(f.replacement(self.slots))),
                FIELD_SEPARATOR,
            ))
            for f in self.formats
        })

    def matched(self) -> Column:
        full = F.size(_FIELDS) == len(self.slots) + 1
        return F.coalesce(full & (F.get(F.col(_FIELDS), F.lit(0)) == ""), F.lit(False))

    def choose(self, per_format: dict[str, Choice | None]) -> Column:
        """The expression of the row's own format; NULL where it has none.

        Expressions come with a key; formats with equal keys share a branch.
        """
        if self.format_column is None:
            ((_, only),) = per_format.values()
            return only
        branches: dict[Hashable, tuple[Column, list[str]]] = {}
        for name, choice in per_format.items():
            if choice is not None:
                key, expr = choice
                branches.setdefault(key, (expr, []))[1].append(name)
        out = None
        for expr, names in branches.values():
            out = (F if out is None else out).when(F.col(self.format_column).isin(names), expr)
        return out

    def slot_of(self, fmt: LogFormat, *expansions: str) -> v.Variable | None:
        """The format's last variable that is expanded that way."""
        found = [var for var in fmt.variables if var.expand in expansions]
        return found[-1] if found else None


def _bind_request(rows: DataFrame, layout: _Layout) -> DataFrame:
    slots = {f.name: layout.slot_of(f, v.REQUEST) for f in layout.formats}
    if not any(slots.values()):
        return rows
    request = layout.choose({f: (s, layout.field(s)) if s else None for f, s in slots.items()})
    rows = bind(rows, __words=text.request_words(request))
    parts = text.request_parts(request, F.col("__words"))
    return bind(rows, **{f"__{name}": part for name, part in parts.items()})


def _bind_time(rows: DataFrame, layout: _Layout, honor_offset: bool) -> DataFrame:
    slots = {f.name: layout.slot_of(f, *_TIMES) for f in layout.formats}
    if not any(slots.values()):
        return rows

    def by_kind(expr):
        return layout.choose(
            {f: (s.expand, expr(s.expand)) if s else None for f, s in slots.items()}
        )

    raw = layout.choose({f: (s, layout.field(s)) if s else None for f, s in slots.items()})
    rows = bind(rows, __clean=times.clean_time(raw))
    clean, wall = F.col("__clean"), F.col("__wall")
    rows = bind(rows, __wall=by_kind(lambda kind: times.wall_clock(clean, kind)))
    return bind(
        rows, __event_time=by_kind(lambda kind: times.event_time_of(clean, wall, kind, honor_offset))
    )


def _columns_of(
    fmt: LogFormat, layout: _Layout, normalise: bool, honor_offset: bool
) -> dict[str, Choice]:
    """Output columns of a format; of two variables for one column the later wins."""
    out: dict[str, Choice] = {}
    for var in fmt.variables:
        if var.expand == v.REQUEST:
            for name in ("request_method", "request_url", "args", "server_protocol"):
                out[name] = v.REQUEST, text.stored_text(F.col(f"__{name}"), normalise)
        elif var.expand in _TIMES:
            columns = times.time_columns(F.col("__event_time"), F.col("__wall"), honor_offset)
            out.update({name: ("time", column) for name, column in columns.items()})
        elif var.kind == "string":
            out[var.column] = var, text.stored_text(layout.field(var), normalise)
        else:
            out[var.column] = var, text.stored_number(layout.field(var), var.kind, normalise)
    return out


def _bind_columns(rows: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Compute many columns in several steps.

    Each step becomes a method of its own in the generated code, and methods beyond
    8,000 bytes are not compiled to machine code.
    """
    names = list(columns)
    for start in range(0, len(names), _STEP):
        step = names[start:start + _STEP]
        rows = bind(rows, **{f"__column_{name}": columns[name] for name in step})
    return rows, {name: F.col(f"__column_{name}") for name in names}


def parse_lines(
    lines: DataFrame,
    formats: LogFormat | Sequence[LogFormat],
    *,
    line: str = "value",
    format_column: str | None = None,
    ranges: RangeTable | None = None,
    normalise: bool = True,
    honor_offset: bool = False,
) -> DataFrame:
    """Parse a column of lines.

    Several formats need ``format_column``, which names each row's format.  The other
    columns of ``lines`` pass through.  Every input row gives one output row:
    ``parse_ok`` tells the parsed from the rejected, which carry ``reject_reason`` and
    the whole line in ``rejected_line``.

    Without ``ranges`` every address counts as unresolved.
    """
    formats = [formats] if isinstance(formats, LogFormat) else list(formats)
    if len(formats) > 1 and format_column is None:
        raise ValueError("several formats need a format_column")
    if len({f.name for f in formats}) < len(formats):
        raise ValueError("two formats share a name")

    layout = _Layout(formats, format_column)
    passed = [c for c in lines.columns if c != line]
    split = bind(
        lines.select(*passed, text.strip(F.col(line)).alias(_LINE)),
        **{_FIELDS: layout.fields_of(F.col(_LINE))},
    )
    split = _bind_request(split, layout)
    split = _bind_time(split, layout, honor_offset)

    per_format = {f.name: _columns_of(f, layout, normalise, honor_offset) for f in formats}
    names = list(dict.fromkeys(n for columns in per_format.values() for n in columns))
    chosen = {
        name: layout.choose({f: columns.get(name) for f, columns in per_format.items()})
        for name in names
    }

    unknown = F.col(_FIELDS).isNull() & F.col(_LINE).isNotNull()
    reason = F.when(unknown, "unknown format").when(~layout.matched(), "format mismatch")
    timed = [f.name for f in formats if "time_str" in per_format[f.name]]
    if timed:
        unread = F.col("__event_time").isNull()
        if len(timed) < len(formats):
            unread = F.col(format_column).isin(timed) & unread
        reason = reason.when(unread, "unreadable time")

    split = bind(split, __reason=reason)
    chosen = {name: column for name, column in chosen.items() if name not in passed}
    if len(chosen) > _WIDE:
        split, chosen = _bind_columns(split, chosen)

    rejected = F.col("__reason").isNotNull()
    parsed = split.select(
        *passed,
        *[column.alias(name) for name, column in chosen.items()],
        (~rejected).alias(PARSE_OK),
        F.col("__reason").alias(REASON),
        F.when(rejected, F.col(_LINE)).alias(LINE),
    )
    if not any(var.expand == v.GEO for f in formats for var in f.variables):
        return parsed
    if ranges is not None:
        return geo_join(parsed, ranges, ip="ip")
    unresolved = {c: F.lit(0 if c == "city_id" else UNRESOLVED) for c in GEO_COLUMNS}
    return parsed.withColumns(unresolved)


def with_time(
    rows: DataFrame, raw: str, layout: str, *, honor_offset: bool = False, prefix: str = ""
) -> DataFrame:
    """Add ``time_str``, ``timestamp`` and ``event_time`` of a column of log times."""
    kept = rows.columns
    rows = bind(rows, __clean=times.clean_time(F.col(raw)))
    rows = bind(rows, __wall=times.wall_clock(F.col("__clean"), layout))
    rows = bind(
        rows,
        __event_time=times.event_time_of(F.col("__clean"), F.col("__wall"), layout, honor_offset),
    )
    columns = times.time_columns(F.col("__event_time"), F.col("__wall"), honor_offset)
    return rows.select(*kept, *[c.alias(prefix + name) for name, c in columns.items()])


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(PARSE_OK).drop(PARSE_OK, REASON, LINE)


def rejected_rows(parsed: DataFrame) -> DataFrame:
    tags = [c for c in ("node_id", "app_name", "log_format_name", "log_format_str") if c in parsed.columns]
    return parsed.filter(~F.col(PARSE_OK)).select(
        *tags, F.col(LINE).alias("line"), F.col(REASON).alias("reason")
    )


def column_widths(rows: DataFrame) -> DataFrame:
    """Longest text per string column, one row."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string"]
    return rows.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).cast("long").alias(c) for c in names])
