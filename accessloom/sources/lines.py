"""Log-line sources: files of several applications, and queued envelopes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from accessloom.functions.text import strip
from accessloom.sources.formats import LogFormat, compile_format
from accessloom.sources.growing import follow_lines

ENVELOPE_SCHEMA = (
    "node_id string, app_name string, log_format_name string, "
    "line string, log_format_str string, log_format_vars string, sent_key string"
)
SENT_KEY = "sent_key"
TAGS = ("node_id", "app_name", "log_format_name")


@dataclass(frozen=True)
class App:
    """Log files of one application.  ``section`` may be dotted; its last part counts."""

    section: str
    paths: Sequence[str]
    format_name: str
    node_id: str

    @property
    def app_name(self) -> str:
        return self.section.rsplit(".", 1)[-1]

    def tag(self, lines: DataFrame) -> DataFrame:
        key = [SENT_KEY] if SENT_KEY in lines.columns else []
        return lines.select(
            F.lit(self.node_id).alias("node_id"),
            F.lit(self.app_name).alias("app_name"),
            F.lit(self.format_name).alias("log_format_name"),
            "value", *key,
        )


def _union(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("no application given")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_apps(spark: SparkSession, apps: Sequence[App]) -> DataFrame:
    """Tagged lines of all applications: ``node_id, app_name, log_format_name, value``."""
    return _union([app.tag(spark.read.text(list(app.paths))) for app in apps])


def stream_apps(
    spark: SparkSession, apps: Sequence[App], *, max_files_per_trigger: int = 1000, **options
) -> DataFrame:
    """The same as a stream over directories of closed (rotated) files."""
    def lines(path: str) -> DataFrame:
        reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.options(**options).load(path)

    return _union([app.tag(lines(path)) for app in apps for path in app.paths])


def follow_apps(
    spark: SparkSession, apps: Sequence[App], *, position: str = "head", max_bytes: int = 0, **options
) -> DataFrame:
    """Tagged lines of files that are still being written, see :mod:`accessloom.sources.growing`.

    ``sent_key`` names a line's file and place, so that a line that is sent twice is known as one.
    """
    def lines(app: App) -> DataFrame:
        found = follow_lines(spark, list(app.paths), position=position, max_bytes=max_bytes, **options)
        key = F.concat_ws(" ", F.lit(app.node_id), "file", "at")
        return found.select("value", key.alias(SENT_KEY))

    return _union([app.tag(lines(app)) for app in apps])


# ---------------------------------------------------------------- envelopes

def to_envelopes(tagged: DataFrame, formats: Sequence[LogFormat]) -> DataFrame:
    """Tagged lines as JSON, one ``value`` per line, with the text of their format.

    A ``sent_key`` goes along where the lines have one.
    """
    key = [SENT_KEY] if SENT_KEY in tagged.columns else []
    def by_name(attribute):
        out = F.lit(None).cast("string")
        for f in formats:
            out = F.when(F.col("log_format_name") == f.name, getattr(f, attribute)).otherwise(out)
        return out

    return tagged.select(
        F.to_json(
            F.struct(
                *TAGS,
                strip(F.col("value")).alias("line"),
                by_name("format_str").alias("log_format_str"),
                by_name("vars_joined").alias("log_format_vars"),
                *key,
            )
        ).alias("value")
    )


def from_envelopes(queue: DataFrame) -> DataFrame:
    """Decode the ``value`` column (text or UTF-8 bytes) of any source.

    ``bad_envelope`` tells what could not be decoded or has no line; only there
    ``envelope`` holds the whole text.
    """
    value = F.col("value").cast("string")
    decoded = queue.select(value.alias("__value"), F.from_json(value, ENVELOPE_SCHEMA).alias("e"))
    bad = F.col("e.line").isNull()
    return decoded.select(
        "e.*", bad.alias("bad_envelope"), F.when(bad, F.col("__value")).alias("envelope")
    )


def read_queue(spark: SparkSession, source: str, *, stream: bool = True, **options) -> DataFrame:
    """The ``value`` column of a queue: ``text``, ``kafka`` or any source that has one.

    Start positions and batch bounds are the source's own options, such as
    ``startingOffsets``, ``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``, ``cleanSource``.
    """
    reader = spark.readStream if stream else spark.read
    return reader.format(source).options(**options).load().select("value")


def start_queueing(
    envelopes: DataFrame, sink: str, checkpoint: str, *, every: str | None = "1 second", **options
) -> StreamingQuery:
    """Append a stream of envelopes to a queue; ``every=None`` handles what is there."""
    writer = envelopes.writeStream.format(sink).options(checkpointLocation=checkpoint, **options)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def drop_resent(queue: DataFrame, within: str = "120 seconds") -> DataFrame:
    """The ``value`` column without envelopes whose key came before.

    On a stream a key is remembered for ``within`` after it first came, by the clock of the
    receiver, and forgotten at the latest when twice that time has passed; however old an
    envelope is, its first arrival counts.  Envelopes without a key are all kept.
    """
    value = F.col("value").cast("string")
    key = F.coalesce(F.get_json_object(value, f"$.{SENT_KEY}"), F.uuid())
    keyed = queue.withColumn(SENT_KEY, key)
    if not queue.isStreaming:
        return keyed.dropDuplicates([SENT_KEY]).select("value")
    watched = keyed.withColumn("received_at", F.current_timestamp()).withWatermark("received_at", within)
    return watched.dropDuplicatesWithinWatermark([SENT_KEY]).select("value")


def formats_in(
    envelopes: DataFrame, server: str | Callable[[str], str], *, most: int = 1000
) -> list[LogFormat]:
    """The formats that occur in decoded envelopes, compiled.

    ``server`` is their server type, or tells it from a format's name.  One aggregation
    over two columns.  Envelopes come from outside: texts that can't be compiled are left out,
    and of more than ``most`` texts those of the fewest lines.  Lines of a format that was left
    out are rejected as of an unknown one, with their format's text, and can be parsed later.
    """
    pairs = envelopes.select("log_format_name", "log_format_str").dropna()
    counts = pairs.groupBy("log_format_name", "log_format_str").agg(F.count("*").alias("n"))
    often = counts.orderBy(F.desc("n"), "log_format_name", "log_format_str").limit(most).collect()
    type_of = server if callable(server) else lambda name: server
    found = []
    for name, text, _ in often:
        try:
            found.append(compile_format(type_of(name), name, text))
        except ValueError:
            continue
    return found
