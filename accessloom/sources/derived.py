"""Tables derived from the access table, period by period, rewritten only where it changed.

A derived table keeps, beside its parts, a mark of each period it was made from: the names,
sizes and times of the period's files.  Upkeep compares marks, not rows; only periods whose mark
is another are read.  Marks are written after the parts, so a job that dies in between makes the
same periods again, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accessloom.sources.tables import OUTCOME, PARSED, PERIOD, read_access

MARKS = "_marks"
_MARK_SCHEMA = f"files long, mark string, {PERIOD} string"


def table_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, outcome, period, length, modified`` of a table's files; none is opened.

    Of a table written by a stream, the files of finished batches.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(
        F.col("path").alias("file"), F.col(OUTCOME).cast("string").alias(OUTCOME),
        F.col(PERIOD).cast("string").alias(PERIOD), "length", F.col("modificationTime").alias("modified"),
    )


def period_marks(files: DataFrame) -> DataFrame:
    mark = F.xxhash64("file", "length", "modified").cast("decimal(38,0)")
    return files.groupBy(PERIOD).agg(F.count("*").alias("files"), F.sum(mark).cast("string").alias("mark"))


def known_marks(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(_MARK_SCHEMA).parquet(f"{out}/{MARKS}")
    except AnalysisException:  # not made yet
        return spark.createDataFrame([], _MARK_SCHEMA)


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)


def keep_up(
    spark: SparkSession, access: str, out: str, parts: dict[str, Callable[[DataFrame], DataFrame]], *,
    schema: StructType | None = None,
) -> list[str]:
    """Bring the parts of a derived table up to date; the periods that were made again.

    A part makes rows with a period from the access rows of some periods.  Periods that are
    gone from the access table are marked as having no files.
    """
    now = period_marks(table_files(spark, access).filter(F.col(OUTCOME) == PARSED))
    before = known_marks(spark, out).withColumnsRenamed({"mark": "old", "files": "old_files"})
    both = now.join(before, PERIOD, "full").select(
        PERIOD, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("mark", F.lit("gone")).alias("mark"), "old")
    both = both.filter(~F.col("mark").eqNullSafe(F.col("old"))).select("files", "mark", PERIOD)
    changed = both.collect()  # a row for each changed period
    if not changed:
        return []
    periods = sorted(r[PERIOD] for r in changed if r.files)
    if periods:
        rows = read_access(spark, access, schema=schema).filter(F.col(PERIOD).isin(periods))
        for name, make in parts.items():
            _replace(make(rows), f"{out}/{name}")
    _replace(spark.createDataFrame(changed, _MARK_SCHEMA), f"{out}/{MARKS}")
    return sorted(r[PERIOD] for r in changed)


def read_part(
    spark: SparkSession, out: str, name: str, *, periods: list[str] | None = None, schema: StructType | None = None
) -> DataFrame:
    """A part of a derived table, without periods that are gone from the access table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{out}/{name}")
    rows = rows.withColumn(PERIOD, F.col(PERIOD).cast("string"))
    gone = [r[PERIOD] for r in known_marks(spark, out).filter(F.col("files") == 0).collect()]
    if gone:
        rows = rows.filter(~F.col(PERIOD).isin(gone))
    return rows if periods is None else rows.filter(F.col(PERIOD).isin(periods))
