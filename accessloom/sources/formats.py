"""Log formats: from a format string to one linear-time regular expression, and from
server configuration files to a table of formats.

Captures of free text run up to the *first* place where everything that must follow
them (literals and numbers, up to the next free text) matches.  Taking the earliest
such place leaves the longest rest for the later captures, so a line matches exactly
when the backtracking `.*?` form would, with the same captures, but no position is ever
tried twice and hostile lines cost no more than honest ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessloom.sources.variables import ANY, SOME_DIGITS, ServerType, Variable, server_type

# Separates variable names in a queued envelope (fixed value).
VARS_SEPARATOR = "<@>"

# No log line contains a line feed, so it can delimit the captured fields.
FIELD_SEPARATOR = "\n"


@dataclass(frozen=True)
class LogFormat:
    """A format ready to be applied: ``regex`` captures one group per variable."""

    name: str
    server_type: str
    format_str: str
    tokens: tuple[str, ...]
    variables: tuple[Variable, ...]
    regex: str

    def replacement(self, slots: Sequence[Variable] | None = None) -> str:
        """Replacement text that puts the captures into ``slots``, each after a separator."""
        group = {var: i for i, var in enumerate(self.variables, start=1)}
        slots = self.slots if slots is None else slots
        return "".join(FIELD_SEPARATOR + (f"${group[s]}" if s in group else "") for s in slots)

    @property
    def slots(self) -> tuple[Variable, ...]:
        return tuple(dict.fromkeys(self.variables))

    @property
    def vars_joined(self) -> str:
        return VARS_SEPARATOR.join(self.tokens)


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def _number(var: Variable, following: tuple | None) -> str:
    """Digits; they give back only where the next thing may itself start with a digit."""
    quantifier = "+" if var.capture == SOME_DIGITS else "*"
    ambiguous = following is not None and (
        isinstance(following[1], Variable) or following[1][0].isdigit()
    )
    return rf"\d{quantifier}{'?' if ambiguous else '+'}"


def _sequence(items: list[tuple], capture: bool, then: tuple | None = None) -> str:
    """Literals and numbers in order, with or without capturing the numbers."""
    out = []
    for i, (_, what) in enumerate(items):
        if isinstance(what, Variable):
            body = _number(what, items[i + 1] if i + 1 < len(items) else then)
            out.append(f"({body})" if capture else body)
        else:
            out.append(_quote(what))
    return "".join(out)


def _free_text(following: list[tuple], then: tuple | None) -> str:
    """Capture up to the first match of ``following``."""
    if not following:
        return "()" if then else r"([\s\S]*+)"
    kind, first = following[0]
    if kind == "variable":
        return rf"((?:(?!{_sequence(following, False, then)})[\s\S])*+)"
    head, rest = first[0], [("literal", first[1:])] if first[1:] else []
    rest = _sequence(rest + following[1:], False, then)
    stop = _quote(head)
    if not rest:
        return f"([^{stop}]*+)"
    return f"([^{stop}]*+(?:{stop}(?!{rest})[^{stop}]*+)*+)"


def compile_format(
    server: str | ServerType, name: str, format_str: str, *, empty_tail: bool = False
) -> LogFormat:
    """Build the regular expression of a format.

    A variable at the very end of the format takes the rest of the line.
    ``empty_tail=True`` makes it take as little as it can instead, which is what an
    unanchored lazy match does.
    """
    server = server if isinstance(server, ServerType) else server_type(server)
    tokens = server.tokens(format_str.strip())
    items = [(k, server.variable(t) if k == "variable" else t) for k, t in tokens]
    names = tuple(t for k, t in tokens if k == "variable")
    variables = tuple(v for k, v in items if k == "variable")
    if not variables:
        raise ValueError(f"log format {name!r} names no variable")

    def is_free(item):
        return item[0] == "variable" and item[1].capture == ANY

    starts = [i for i, item in enumerate(items) if is_free(item)]
    first = starts[0] if starts else len(items)
    body = _sequence(items[:first], True, items[first] if starts else None)
    for n, i in enumerate(starts):
        end = starts[n + 1] if n + 1 < len(starts) else len(items)
        following, then = items[i + 1:end], items[end] if end < len(items) else None
        body += _free_text(following, then) + _sequence(following, True, then)

    if empty_tail and items[-1][0] == "variable":
        tail = "([\\s\\S]*+)" if is_free(items[-1]) else f"({_number(items[-1][1], None)})"
        least = r"(\d)" if items[-1][1].capture == SOME_DIGITS else "()"
        body = body[: -len(tail)] + least

    letters = any(c.isalpha() for k, t in tokens if k == "literal" for c in t)
    regex = ("(?iu)" if letters else "") + "^" + body + r"[\s\S]*+"
    return LogFormat(name, server.name, format_str.strip(), names, variables, regex)


def builtin_formats(server: str) -> list[LogFormat]:
    st = server_type(server)
    return [compile_format(st, n, f) for n, f in st.builtin_formats.items()]


# ---------------------------------------------------------------- discovery

_CONF_SCHEMA = "server_type string, name string, format_str string, vars array<string>, path string"


def read_server_confs(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files, one row per file: ``path, content``."""
    return (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def discover_nginx_formats(confs: DataFrame, *, builtin: bool = True) -> DataFrame:
    """``log_format name '...' '...';`` directives.  Quoted pieces are joined."""
    directive = r"log_format\s+(\w+)\s+'([\s\S]*?)'\s*;"
    return _discovered(
        confs, "nginx", directive, name_group=1, format_group=2,
        clean=lambda c: F.regexp_replace(c, r"'\s+'", ""),
        variable=r"(\$\w+)", builtin=builtin,
    )


def discover_apache_formats(confs: DataFrame) -> DataFrame:
    """``LogFormat "..." name`` directives, with escaped quotes restored."""
    directive = r'LogFormat[ \t]*"((?:[^"\\]|\\.)*+)"[ \t]*(\w+)[ \t]*(?:\r?\n|$)'
    return _discovered(
        confs, "apache", directive, name_group=2, format_group=1,
        clean=lambda c: F.regexp_replace(c, r'\\"', '"'),
        variable=r"(%(?:\{[\w-]+\}|[<>])?[A-Za-z])", builtin=False,
    )


def _discovered(confs, server, directive, *, name_group, format_group, clean, variable, builtin):
    extracted = [
        F.regexp_extract_all("content", F.lit(directive), F.lit(g))
        for g in (name_group, format_group)
    ]
    file = "path" if "path" in confs.columns else "content"
    found = (
        confs.select(F.col(file).alias("path"), F.arrays_zip(*extracted).alias("pairs"))
        .select("path", F.posexplode("pairs").alias("at", "p"))
        .groupBy("path", F.col("p.0").alias("name"))
        # a name defined again in a file takes the later definition; other files keep theirs
        .agg(F.max_by(F.col("p.1"), "at").alias("text"))
        .select(
            F.lit(server).alias("server_type"), "name",
            F.trim(clean(F.col("text"))).alias("format_str"), "path",
        )
        .withColumn("vars", F.regexp_extract_all("format_str", F.lit(variable), F.lit(1)))
        .filter(F.size("vars") > 0)
        .select("server_type", "name", "format_str", "vars", "path")
    )
    if not builtin:
        return found
    # no path: it holds in every file that defines no format of that name
    rows = [(f.server_type, f.name, f.format_str, list(f.tokens), None) for f in builtin_formats(server)]
    return confs.sparkSession.createDataFrame(rows, _CONF_SCHEMA).unionByName(found)


def load_formats(log_formats: DataFrame, path: str | None = None) -> list[LogFormat]:
    """Compile a table of formats, which is configuration, on the driver.

    With ``path`` the formats of one configuration file and the built-in ones it doesn't
    define itself.  Without, files that give one name to different formats are refused.
    """
    kept = log_formats.select(
        "server_type", "name", "format_str", *(["path"] if "path" in log_formats.columns else []))
    if path is not None:
        kept = kept.filter((F.col("path") == path) | F.col("path").isNull())
    rows = kept.distinct().collect()
    by_name: dict[tuple, dict[str, bool]] = {}
    for r in rows:
        own = "path" not in r or r.path is not None
        texts = by_name.setdefault((r.server_type, r.name), {})
        texts[r.format_str] = texts.get(r.format_str, False) or own
    out = []
    for (server, name), texts in by_name.items():
        texts = [t for t, own in texts.items() if own] or list(texts)
        if len(texts) > 1:
            raise ValueError(f"log format {name!r} has several definitions; choose a path")
        out.append(compile_format(server, name, texts[0]))
    return out
