"""Lines of many formats that don't say which is theirs.

Formats are arranged in a trie of their literals in order.  A line can be of a format only if
these stand in it one after the other, so a walk down the trie, which tries a common beginning of
many formats once, leaves few candidates; of these the most specific one that matches wins: that
with most literal text, then by name.  That match also gives the captures.  All formats fill one
row of slots, empty where a format has no such variable, so the plan depends on the variables
and not on the number of formats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from accessloom.functions import text, times
from accessloom.functions.network import UNRESOLVED
from accessloom.operators.binding import bind
from accessloom.operators.geo import GEO_COLUMNS, RangeTable, geo_join
from accessloom.operators.parse import LINE, PARSE_OK, REASON
from accessloom.sources import variables as v
from accessloom.sources.formats import LogFormat
from accessloom.sources.variables import server_type

NAME = "log_format_name"
_FIELDS = "__fields"


def literals_of(fmt: LogFormat) -> tuple[bool, list[str]]:
    """Whether a format begins with a literal, and its literals in order."""
    tokens = server_type(fmt.server_type).tokens(fmt.format_str)
    return tokens[0][0] == "literal", [t for kind, t in tokens if kind == "literal"]


class FormatTrie:
    """Formats by their literals; a line's candidates, and the one it is of."""

    def __init__(self, formats: Sequence[LogFormat], slots: Sequence[v.Variable]):
        self.root: dict = {}
        self.known = []
        order = sorted(formats, key=lambda f: (-sum(map(len, literals_of(f)[1])), f.name))
        for rank, fmt in enumerate(order):
            first, literals = literals_of(fmt)
            node = self.root
            for i, literal in enumerate(literals):
                # a literal that a format begins with must begin the line
                node = node.setdefault((first and i == 0, literal.lower()), {})
            node.setdefault(None, []).append(rank)
            group = {var: i for i, var in enumerate(fmt.variables, start=1)}
            taken: dict[str, v.Variable] = {}
            for var in fmt.variables:  # of two variables for one column the later wins
                taken[var.column] = var
            groups = [group[s] if s in group and taken[s.column] == s else 0 for s in slots]
            # digits are those of ASCII, as in the JVM's expressions
            self.known.append((fmt.name, re.compile(fmt.regex.replace(r"\d", "[0-9]")), groups))

    def candidates(self, line: str) -> list[int]:
        """Formats whose literals stand in the line in order, the most specific first."""
        line, found, todo = line.lower(), [], [(self.root, 0)]
        while todo:
            node, at = todo.pop()
            for key, below in node.items():
                if key is None:
                    found += below
                    continue
                anchored, literal = key
                place = (0 if line.startswith(literal) else -1) if anchored else line.find(literal, at)
                if place >= 0:
                    todo.append((below, place + len(literal)))
        return sorted(found)

    def read(self, line: str) -> tuple[str | None, list[str | None] | None]:
        for i in self.candidates(line):
            name, pattern, groups = self.known[i]
            match = pattern.match(line)
            if match:
                return name, [match.group(g) if g else None for g in groups]
        return None, None


def _first(columns: list[Column]) -> Column:
    return F.coalesce(*columns) if len(columns) > 1 else columns[0]


def parse_untagged(
    lines: DataFrame, formats: Sequence[LogFormat], *, line: str = "value", ranges: RangeTable | None = None,
    normalise: bool = True, honor_offset: bool = False,
) -> DataFrame:
    """Parse a column of lines, each by the most specific of the formats that matches.

    The result is that of ``parse_lines`` with a ``log_format_name``; lines that no format
    matches are rejected as ``format mismatch``, null lines too.
    """
    formats = list(formats)
    if len({f.name for f in formats}) < len(formats):
        raise ValueError("two formats share a name")
    slots = list(dict.fromkeys(s for f in formats for s in f.slots))
    passed = [c for c in lines.columns if c not in (line, NAME)]
    rows = lines.select(*passed, text.strip(F.col(line)).alias("__line"))
    schema = StructType(list(rows.schema.fields)).add(NAME, "string").add(_FIELDS, ArrayType(StringType()))

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FormatTrie(formats, slots)
        for batch in source:
            found = [trie.read(x) if x is not None else (None, None) for x in batch.column(len(passed)).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([n for n, _ in found], pa.string()),
                pa.array([f for _, f in found], pa.list_(pa.string())),
            ], names=[*batch.schema.names, NAME, _FIELDS])

    rows = rows.mapInArrow(read, schema)
    field = {s: F.get(F.col(_FIELDS), F.lit(i)) for i, s in enumerate(slots)}
    columns: dict[str, list[Column]] = {}
    for slot in slots:
        if slot.expand is None or slot.expand == v.GEO:
            stored = (text.stored_text(field[slot], normalise) if slot.kind == "string"
                      else text.stored_number(field[slot], slot.kind, normalise))
            columns.setdefault(slot.column, []).append(stored)
    requests = [field[s] for s in slots if s.expand == v.REQUEST]
    if requests:
        rows = bind(rows, __request=_first(requests))
        rows = bind(rows, __words=text.request_words(F.col("__request")))
        parts = text.request_parts(F.col("__request"), F.col("__words"))
        for name, part in parts.items():
            shown = F.when(F.col("__request").isNotNull(), text.stored_text(part, normalise))
            columns.setdefault(name, []).append(shown)
    timed: list[Column] = []
    for kind in dict.fromkeys(s.expand for s in slots if s.expand in (v.TIME_LOCAL, v.TIME_ISO8601)):
        raw = _first([field[s] for s in slots if s.expand == kind])
        clean, wall, event = (f"__{n}_{kind}" for n in ("clean", "wall", "event"))
        rows = bind(rows, **{clean: times.clean_time(raw)})
        rows = bind(rows, **{wall: times.wall_clock(F.col(clean), kind)})
        rows = bind(rows, **{event: times.event_time_of(F.col(clean), F.col(wall), kind, honor_offset)})
        timed.append(raw.isNotNull() & F.col(event).isNull())
        for name, column in times.time_columns(F.col(event), F.col(wall), honor_offset).items():
            columns.setdefault(name, []).append(column)
    reason = F.when(F.col(_FIELDS).isNull(), "format mismatch")
    if timed:
        unread = timed[0] if len(timed) == 1 else timed[0] | timed[1]
        reason = reason.when(unread, "unreadable time")
    rows = bind(rows, __reason=reason)
    rejected = F.col("__reason").isNotNull()
    parsed = rows.select(
        *passed, NAME, *[_first(c).alias(n) for n, c in columns.items() if n not in passed],
        (~rejected).alias(PARSE_OK), F.col("__reason").alias(REASON), F.when(rejected, F.col("__line")).alias(LINE),
    )
    if not any(s.expand == v.GEO for s in slots):
        return parsed
    if ranges is not None:
        return geo_join(parsed, ranges, ip="ip")
    return parsed.withColumns({c: F.lit(0 if c == "city_id" else UNRESOLVED) for c in GEO_COLUMNS})
