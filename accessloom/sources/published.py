"""Rewriting parts of the access table while others read and write it.

A rewrite (compaction, clustering, replay of rejects) leaves the table's files alone.  It writes
new ones beside them and then publishes a version: which files count no longer, and which new
ones count instead.  A version is one small file that appears at once, so a reader sees all of a
rewrite or nothing; a job that dies before has changed nothing, and its files are never read.
Rows that are appended meanwhile are not in any version's list and count as they are.

One rewrite runs at a time; readers and appending streams need not know about it.  Files that no
longer count are kept, as readers of older versions may still be at them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accessloom.functions.network import ip_to_long
from accessloom.functions.times import as_day, period_name
from accessloom.operators.geo import RangeTable
from accessloom.operators.parse import LINE, PARSE_OK, REASON, parse_lines, rejected_rows
from accessloom.sources.derived import table_files
from accessloom.sources.formats import LogFormat
from accessloom.sources.tables import OUTCOME, PARSED, PERIOD, REJECTED, with_folders

REWRITTEN, VERSIONS = "_rewritten", "_versions"
TARGET = 128 << 20
#: A file gets about so many rows at most, as a task sorts a file's rows: files may hold rows of any size in few bytes.
MOST_ROWS = 1 << 20
_FILE = "file string, outcome string, period string, length long, modified timestamp"


def _state(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The newest version, and its files with ``live`` (new ones) or not (replaced ones)."""
    try:
        done = spark.read.schema("attempt string, version long").parquet(f"{path}/{VERSIONS}/done")
        newest = done.orderBy(F.desc("version")).first()
    except AnalysisException:
        newest = None
    if newest is None:
        return 0, spark.createDataFrame([], f"{_FILE}, live boolean")
    files = spark.read.schema(f"{_FILE}, live boolean").parquet(f"{path}/{VERSIONS}/files/{newest.attempt}")
    return newest.version, files


def live_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, outcome, period, length, modified, rewritten`` of the files that count now."""
    _, state = _state(spark, path)
    raw = table_files(spark, path).join(state.filter(~F.col("live")).select("file"), "file", "left_anti")
    new = state.filter("live").drop("live")
    return raw.withColumn("rewritten", F.lit(False)).unionByName(new.withColumn("rewritten", F.lit(True)))


def _rows_of(
    spark: SparkSession, path: str, files: DataFrame, schema: StructType | None, named: bool = False
) -> DataFrame | None:
    """The rows of some files, whose names go through the driver as in any scan; ``named`` adds each row's ``__file``."""
    found = None
    for r in (False, True):
        names = [x.file for x in files.filter(F.col("rewritten") == r).select("file").collect()]
        if not names:
            continue
        reader = spark.read.option("basePath", f"{path}/{REWRITTEN}" if r else path)
        if schema is not None:
            full = StructType(list(schema.fields)).add("job", "string") if r else schema
            rows = reader.schema(full).parquet(*names)
        else:
            rows = reader.option("mergeSchema", "true").parquet(*names)
        if named:
            rows = rows.withColumn("__file", F.col("_metadata.file_name"))
        rows = rows.drop("job").withColumns({c: F.col(c).cast("string") for c in (OUTCOME, PERIOD)})
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def _with_counts(spark: SparkSession, path: str, files: DataFrame, schema: StructType | None) -> DataFrame:
    """Some files with their numbers of ``rows``, which their footers tell."""
    found = _rows_of(spark, path, files, schema, named=True)
    if found is None:
        return files.withColumn("rows", F.lit(0).cast("long"))
    counts = found.groupBy(F.col(OUTCOME).alias("outcome"), F.col(PERIOD).alias("period"), "__file").agg(F.count("*").alias("rows"))
    named = files.withColumn("__file", F.substring_index("file", "/", -1))
    return named.join(counts, ["outcome", "period", "__file"], "left").select(*files.columns, F.coalesce("rows", F.lit(0)).alias("rows"))


def rewrite(
    spark: SparkSession, path: str, chosen: DataFrame, make: Callable[[DataFrame], DataFrame], *,
    schema: StructType | None = None, options: dict[str, str] | None = None,
) -> int:
    """Replace the chosen live files by what ``make`` makes of their rows; the new version's number.

    ``make`` gives rows with outcome and period, already dealt and sorted for writing.
    """
    version, state = _state(spark, path)
    names = chosen.select("file").distinct()
    rows = _rows_of(spark, path, chosen, schema)
    if rows is None:
        return version
    job = uuid.uuid4().hex
    out = f"{path}/{REWRITTEN}/job={job}"
    make(rows).write.options(**(options or {})).partitionBy(OUTCOME, PERIOD).parquet(out)
    new = table_files(spark, out).withColumn("live", F.lit(True))
    gone = chosen.filter(~F.col("rewritten")).drop("rewritten").withColumn("live", F.lit(False))
    kept = state.join(names, "file", "left_anti")
    files = kept.select(new.columns).unionByName(new).unionByName(gone.select(new.columns))
    files.write.parquet(f"{path}/{VERSIONS}/files/{job}")
    _publish(spark, path, job, version + 1)
    return version + 1


def _publish(spark: SparkSession, path: str, job: str, version: int) -> None:
    done = spark.createDataFrame([(job,)], "attempt string").coalesce(1)
    done.write.mode("errorifexists").parquet(f"{path}/{VERSIONS}/done/version={version}")


def read_published(
    spark: SparkSession, path: str, *, schema: StructType | None = None, split_save: str | None = None,
    first: dt.date | str | None = None, last: dt.date | str | None = None, outcome: str = PARSED,
) -> DataFrame:
    """Rows of the table as the newest version says; the same arguments as ``read_access``."""
    files = live_files(spark, path).filter(F.col("outcome") == outcome)
    if first is not None:
        if split_save is None:
            raise ValueError("a period needs split_save")
        start, end = as_day(first), as_day(last or first)
        days = (start + dt.timedelta(days=i) for i in range((end - start).days + 1))
        files = files.filter(F.col("period").isin(sorted({period_name(d, split_save) for d in days})))
    rows = _rows_of(spark, path, files, schema)
    if rows is None:
        if schema is None:
            raise ValueError("no file counts; give the schema to read an empty table")
        rows = spark.createDataFrame([], schema)
    if outcome == PARSED:
        return rows.drop(OUTCOME, REASON, LINE)
    return rejected_rows(rows.withColumn(PARSE_OK, F.lit(False)))


# ---------------------------------------------------------------- what is rewritten

def compact(
    spark: SparkSession, path: str, *, target_bytes: int = TARGET, schema: StructType | None = None
) -> int:
    """Gather small files: those under half the target, in periods that have at least two more than will hold them.

    A file holds ``target_bytes`` or about ``MOST_ROWS`` rows, whichever is less.  Files that a rewrite has filled to
    half of either are left alone.  Rows are dealt by period and ranges of time and sorted, so a period's files follow each other
    and questions about an hour skip most of them; a period gets one file more than it needs
    where a range begins inside it.
    """
    files = live_files(spark, path)
    small = _with_counts(spark, path, files.filter(F.col("length") < target_bytes / 2), schema)
    small = small.filter(~F.col("rewritten") | (F.col("rows") < MOST_ROWS / 2)).persist()
    keys = ["outcome", "period"]
    needed = F.greatest(F.ceil(F.sum("length") / target_bytes), F.ceil(F.sum("rows") / MOST_ROWS))
    crowded = small.groupBy(*keys).agg(F.count("*").alias("n"), needed.alias("needed")).filter("n > needed + 1")
    chosen = small.join(crowded.select(*keys), keys, "left_semi").select(files.columns)
    parts = crowded.agg(F.sum("needed")).first()[0]
    if not parts:
        small.unpersist()
        return _state(spark, path)[0]

    def gathered(rows: DataFrame) -> DataFrame:
        order = [OUTCOME, PERIOD] + (["timestamp"] if "timestamp" in rows.columns else [])
        spread = [F.xxhash64("ip")] if "ip" in rows.columns else []  # a second may be busy
        return rows.repartitionByRange(int(parts), *order, *spread).sortWithinPartitions(*order)

    try:
        return rewrite(spark, path, chosen, gathered, schema=schema)
    finally:
        small.unpersist()


def replay_rejects(
    spark: SparkSession, path: str, formats: Sequence[LogFormat], *, format_column: str | None = None,
    split_save: str | None = "day", ranges: RangeTable | None = None, schema: StructType | None = None, **options,
) -> int:
    """Parse rejected lines again, with other formats; what parses moves to the parsed rows at once.

    With several formats ``format_column`` tells a line's own (``log_format_name``, or
    ``log_format_str`` for envelopes, which keep the text of their format).  What still doesn't
    parse stays rejected, with its new reason.  Bad envelopes are left alone.
    """
    if format_column == "log_format_str":
        formats = [LogFormat(f.format_str, f.server_type, f.format_str, f.tokens, f.variables, f.regex) for f in formats]
    chosen = live_files(spark, path).filter(F.col("outcome") == REJECTED)

    def again(rows: DataFrame) -> DataFrame:
        tags = [c for c in ("node_id", "app_name", "log_format_name", "log_format_str") if c in rows.columns]
        bad = F.col(REASON) == "bad envelope"
        lines = rows.filter(~bad).select(*tags, F.col(LINE).alias("value"))
        parsed = parse_lines(lines, list(formats), format_column=format_column, ranges=ranges, **options)
        out = with_folders(parsed, split_save)
        left = rows.filter(bad).select(*tags, REASON, LINE, OUTCOME, PERIOD)
        order = [OUTCOME, PERIOD] + (["timestamp"] if "timestamp" in out.columns else [])
        return out.unionByName(left, allowMissingColumns=True).sortWithinPartitions(*order)

    return rewrite(spark, path, chosen, again, schema=schema)


# ---------------------------------------------------------------- look-ups

def _place(value: Column, bounds: list) -> Column:
    """How many of the bounds a value has reached; null as 0."""
    steps = [F.when(value >= b, 1).otherwise(0) for b in bounds]
    return sum(steps[1:], steps[0]) if steps else F.lit(0)


def interleaved(places: Sequence[Column], bits: int) -> Column:
    """One number from the bits of several, the highest of each first."""
    out = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for place in places:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(place.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")))
    return out


def clustered(rows: DataFrame, by: dict[str, Column], parts: int, bits: int = 5) -> DataFrame:
    """Rows dealt and sorted so that near values of all of ``by`` (numbers) lie together.

    Each column's values are cut into 2**bits ranges of about equal numbers of rows; the bits
    of the range numbers are interleaved.  Inside a file rows follow the columns themselves.
    """
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = rows.agg(*[F.percentile_approx(c, cuts, 1000).alias(n) for n, c in by.items()]).first()
    places = [_place(c, sorted(set(found[n] or []))) for n, c in by.items()]
    z = interleaved(places, bits)
    rows = rows.withColumns({f"__by_{n}": c for n, c in by.items()}).withColumn("__z", z)
    order = [OUTCOME, PERIOD, "__z", *[f"__by_{n}" for n in by]]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.drop("__z", *[f"__by_{n}" for n in by])


def cluster(
    spark: SparkSession, path: str, *, periods: Sequence[str], target_bytes: int = TARGET, addresses: int = 1_000_000,
    schema: StructType | None = None, options: dict[str, str] | None = None,
) -> int:
    """Rewrite periods for look-ups by address and status as well as by time.

    Address, status and time are clustered together, and files get Bloom filters on the address
    (sized for ``addresses`` different ones a row group), so a look-up reads the few row groups
    that can hold it.
    """
    chosen = live_files(spark, path).filter((F.col("outcome") == PARSED) & F.col("period").isin(list(periods)))
    held, rows = _with_counts(spark, path, chosen, schema).agg(F.sum("length"), F.sum("rows")).first()
    if not held:
        return _state(spark, path)[0]
    parts = max(-(-held // target_bytes), -(-rows // MOST_ROWS))
    by = {"ip": ip_to_long(F.col("ip")), "status_code": F.col("status_code"), "timestamp": F.col("timestamp")}
    bloom = {"parquet.bloom.filter.enabled#ip": "true", "parquet.bloom.filter.expected.ndv#ip": str(addresses)}
    return rewrite(
        spark, path, chosen, lambda rows: clustered(rows, by, parts), schema=schema,
        options=bloom | (options or {}))
