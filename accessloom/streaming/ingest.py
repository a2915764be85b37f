"""Continuous ingest: a stream of tagged lines or envelopes to the access table.

The file sink commits each micro-batch once, whatever is replayed after a failure.
Lines that do not parse are stored beside the others, with their reason.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from accessloom.functions.text import strip
from accessloom.operators.geo import RangeTable
from accessloom.operators.parse import LINE, PARSE_OK, REASON, parse_lines
from accessloom.sources.formats import LogFormat
from accessloom.sources.lines import from_envelopes
from accessloom.sources.tables import OUTCOME, PERIOD, with_folders

BatchStep = Callable[[DataFrame, int], None]


def parse_stream(
    tagged: DataFrame, formats: Sequence[LogFormat], *, ranges: RangeTable | None = None, **options
) -> DataFrame:
    """Parse ``node_id, app_name, log_format_name, value``."""
    return parse_lines(
        tagged, list(formats), format_column="log_format_name", ranges=ranges, **options
    )


def parse_envelopes(
    queue: DataFrame, formats: Sequence[LogFormat], *, ranges: RangeTable | None = None, **options
) -> DataFrame:
    """Parse queued envelopes of any source with a ``value`` column.

    An envelope brings the text of its format, and that text decides, not the name:
    applications may use one name for different formats.  What is no envelope, or has no
    line, is rejected as ``bad envelope`` with its whole text.  Rejected rows keep the text
    of their format, so that lines of an unknown one can be parsed later.
    """
    by_text = {f.format_str: dataclasses.replace(f, name=f.format_str) for f in formats}
    tagged = from_envelopes(queue).select(
        "node_id", "app_name", "log_format_name", "log_format_str",
        F.coalesce("line", "envelope").alias("value"), "bad_envelope",
        strip(F.col("log_format_str")).alias("__format"),
    )
    parsed = parse_lines(
        tagged, list(by_text.values()), format_column="__format", ranges=ranges, **options
    )
    bad = F.col("bad_envelope")
    return parsed.withColumns({
        PARSE_OK: F.col(PARSE_OK) & ~bad,
        REASON: F.when(bad, "bad envelope").otherwise(F.col(REASON)),
        LINE: F.when(bad, F.coalesce(F.col(LINE), F.lit(""))).otherwise(F.col(LINE)),
    }).drop("__format", "bad_envelope")


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def start_ingest(
    parsed: DataFrame,
    path: str,
    checkpoint: str,
    *,
    split_save: str | None = "day",
    by: str = "event",
    position: str = "head",
    every: str | None = "1 second",
) -> StreamingQuery:
    """Append a parsed stream to the access table at ``path``.

    ``position`` ``head`` takes everything not yet handled, ``tail`` only what arrives
    from now on.  ``every=None`` handles what is there and stops.
    """
    if position not in ("head", "tail"):
        raise ValueError("position must be 'head' or 'tail'")
    if position == "tail":
        skip_existing(parsed, path, checkpoint, split_save=split_save, by=by)
    rows = with_folders(parsed, split_save, by=by)
    writer = (
        rows.writeStream.format("parquet").outputMode("append")
        .partitionBy(OUTCOME, PERIOD)
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, every).start()


def skip_existing(parsed: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Mark everything there is now as handled, storing none of it."""
    start_ingest(parsed.filter(F.lit(False)), path, checkpoint, every=None, **options).awaitTermination()


def start_batches(
    stream: DataFrame,
    checkpoint: str,
    write: BatchStep,
    *,
    before: BatchStep | None = None,
    after: BatchStep | None = None,
    every: str | None = "1 second",
) -> StreamingQuery:
    """Hand every micro-batch to ``before``, ``write`` and ``after``.

    A batch may be handed over again after a failure, so ``write`` should go by the
    batch number; :func:`write_numbered` does.
    """
    steps = [step for step in (before, write, after) if step is not None]

    def handle(batch: DataFrame, number: int) -> None:
        for step in steps:
            step(batch, number)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def write_numbered(path: str, *, split_save: str | None = "day") -> BatchStep:
    """A ``write`` step that stores each batch in a folder of its own.

    A replayed batch replaces its folder instead of adding to it.  The folder carries the
    id that a query keeps in its checkpoint, so a query that starts with another checkpoint
    adds to what is there.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = with_folders(batch, split_save)
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows.write.mode("overwrite").partitionBy(OUTCOME, PERIOD).parquet(
            f"{path}/query={query}/batch={number}"
        )

    return write
