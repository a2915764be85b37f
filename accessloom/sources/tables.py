"""The access table: Parquet, partitioned by the outcome of parsing and by period.

Parsed and rejected rows are written by one job, so lines are read and matched once;
readers of either prune the other's folders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accessloom.functions.times import PERIODS, as_day, period_name, period_of
from accessloom.operators.parse import LINE, PARSE_OK, REASON, parse_lines, rejected_rows
from accessloom.sources.formats import LogFormat

OUTCOME = "outcome"
PARSED, REJECTED = "parsed", "rejected"
PERIOD = "period"
ALL = "all"     # the one period of an unsplit table


def with_period(rows: DataFrame, split_save: str | None, *, by: str = "event") -> DataFrame:
    """Add the period column, from event time or from the clock at ingest."""
    if split_save is None:
        return rows.withColumn(PERIOD, F.lit(ALL))
    if split_save not in PERIODS:
        raise ValueError(f"split_save must be one of {', '.join(PERIODS)}")
    if by not in ("event", "ingest"):
        raise ValueError("by must be 'event' or 'ingest'")
    if by == "event" and "event_time" not in rows.columns:  # formats without a time
        return rows.withColumn(PERIOD, F.lit(ALL))
    time = F.col("event_time") if by == "event" else F.current_timestamp()
    return rows.withColumn(PERIOD, F.coalesce(period_of(time, split_save), F.lit(ALL)))


def with_folders(parsed: DataFrame, split_save: str | None, *, by: str = "event") -> DataFrame:
    """Add the two columns the table is partitioned by; the folder tells the outcome."""
    outcome = F.when(F.col(PARSE_OK), PARSED).otherwise(REJECTED)
    rows = with_period(parsed, split_save, by=by).withColumn(OUTCOME, outcome)
    return rows.drop(PARSE_OK)


def write_access(
    parsed: DataFrame,
    path: str,
    *,
    split_save: str | None = "day",
    by: str = "event",
    rebalance: bool = False,
    mode: str = "append",
) -> None:
    """Append parsed and rejected rows.

    Rows are sorted by time inside each file, so row groups can be skipped by
    ``timestamp``.  Log files follow time already and need no shuffle; for input in
    no order ``rebalance=True`` gathers each period into evenly sized files, splitting
    busy periods over several tasks.
    """
    rows = with_folders(parsed, split_save, by=by)
    if rebalance:
        rows = rows.hint("rebalance", OUTCOME, PERIOD)
    order = [OUTCOME, PERIOD] + (["timestamp"] if "timestamp" in rows.columns else [])
    rows = rows.sortWithinPartitions(*order)
    rows.write.mode(mode).partitionBy(OUTCOME, PERIOD).parquet(path)


def access_schema(spark: SparkSession, formats: LogFormat | Sequence[LogFormat]) -> StructType:
    """Columns of the table for lines of these formats; no file is looked at."""
    formats = [formats] if isinstance(formats, LogFormat) else list(formats)
    lines = spark.createDataFrame([], "log_format_name string, value string")
    schema = parse_lines(lines, formats, format_column="log_format_name").schema
    tags = StructType().add("node_id", "string").add("app_name", "string")
    fields = [f for f in tags.fields + schema.fields if f.name not in (PARSE_OK, "log_format_name")]
    return (
        StructType(fields).add("log_format_name", "string")
        .add(OUTCOME, "string").add(PERIOD, "string")
    )


def _read(spark: SparkSession, path: str, schema: StructType | None, folders: list[str]) -> DataFrame:
    reader = spark.read.option("basePath", path)
    paths = folders or [path]
    if schema is not None:
        return reader.schema(schema).parquet(*paths)
    # Formats with other columns may have been added later.
    df = reader.option("mergeSchema", "true").parquet(*paths)
    # Partition values are inferred, and a table of years would give numbers.
    return df.withColumn(PERIOD, F.col(PERIOD).cast("string"))


def read_access(
    spark: SparkSession,
    path: str,
    *,
    schema: StructType | None = None,
    split_save: str | None = None,
    first: dt.date | str | None = None,
    last: dt.date | str | None = None,
    folders_only: bool = False,
) -> DataFrame:
    """Parsed rows; with ``first`` (and ``last``) only the periods of those days.

    Give the ``schema`` (see :func:`access_schema`) for large tables; without it the
    footer of every file is read to find the columns.  ``folders_only`` looks at the
    folders of the periods alone instead of listing the table.  They must exist, and it
    is for tables written by batch jobs: a stream's commit log is kept for the whole table.
    """
    periods = None
    if first is not None:
        if split_save is None:
            raise ValueError("a period needs split_save")
        start, end = as_day(first), as_day(last or first)
        days = (start + dt.timedelta(days=i) for i in range((end - start).days + 1))
        periods = sorted({period_name(d, split_save) for d in days})
    folders = []
    if folders_only:
        if periods is None:
            raise ValueError("folders_only needs first")
        folders = [f"{path}/{OUTCOME}={PARSED}/{PERIOD}={p}" for p in periods]
    rows = _read(spark, path, schema, folders).filter(F.col(OUTCOME) == PARSED)
    if periods is not None:
        rows = rows.filter(F.col(PERIOD).isin(periods))
    return rows.drop(OUTCOME, REASON, LINE)


def read_rejected(spark: SparkSession, path: str, *, schema: StructType | None = None) -> DataFrame:
    rows = _read(spark, path, schema, []).filter(F.col(OUTCOME) == REJECTED)
    return rejected_rows(rows.withColumn(PARSE_OK, F.lit(False)))
