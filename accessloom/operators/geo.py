"""IP ranges: the interval left join from addresses to regions.

Each range is cut at the borders of the /16 blocks it covers, and each block into equal
cells, at least as many as the block has ranges.  An address then meets, by plain
equality on its cell, the ranges that touch that cell and no others: with n ranges in a
block the cell holds at most 65,536 / n addresses, so an address is never compared with
more than min(n, 65,536 / n) <= 256 ranges, and in practice with one or two.  The cut
table has at most three rows per range and 65,536 more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accessloom.functions.network import UNRESOLVED, ip_to_long, region_parts
from accessloom.operators.binding import bind

GEO_COLUMNS = ("isp", "city", "city_id", "province", "country")

MAX_BROADCAST_BYTES = 128 << 20

_BLOCK_BITS = 16
_LAST = (1 << 32) - 1
_ROW_BYTES = 160    # numbers, headers and hash table entry of a row of the cut table, besides its text


@dataclass(frozen=True)
class RangeTable:
    """Ranges cut into cells, with the measured size that decides the join."""

    cells: DataFrame      # block, cell, lo, hi and the region columns
    shifts: DataFrame     # block, shift: at most 65,536 rows, whatever the ranges
    cell_bytes: int

    def persist(self) -> RangeTable:
        """Keep the cut table on the executors, for many queries or micro-batches."""
        return RangeTable(self.cells.persist(), self.shifts.persist(), self.cell_bytes)


def prepare_ranges(ranges: DataFrame) -> RangeTable:
    """Cut ``lo, hi, city_id, region`` into cells and measure the result.

    Overlapping ranges would multiply rows and are refused, as are ranges that end before
    they begin.  Numbers that are no IPv4
    addresses cannot be met and are cut off, so there are never more than 65,536 blocks.
    """
    parts = region_parts(F.col("region"), F.col("city_id"))
    per_block = (
        ranges.select(
            F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", F.lit(_LAST)).alias("hi"),
            *[c.alias(n) for n, c in parts.items()],
        )
        .filter(F.col("lo") <= F.col("hi"))
        .withColumn(
            "block",
            F.explode(F.sequence(F.shiftright("lo", _BLOCK_BITS), F.shiftright("hi", _BLOCK_BITS))),
        )
    )
    counts = per_block.groupBy("block").agg(F.count("*").alias("n"))
    cell_bits = F.least(F.ceil(F.log2("n")), F.lit(_BLOCK_BITS)).cast("int")
    shifts = counts.select("block", (F.lit(_BLOCK_BITS) - cell_bits).alias("shift"))

    first = F.greatest(F.col("lo"), F.shiftleft("block", _BLOCK_BITS))
    last = F.least(F.col("hi"), F.shiftleft("block", _BLOCK_BITS) + ((1 << _BLOCK_BITS) - 1))
    cells = per_block.join(F.broadcast(shifts), "block").select(
        "block",
        F.explode(F.sequence(_shift(first, F.col("shift")), _shift(last, F.col("shift")))).alias("cell"),
        "lo", "hi", *GEO_COLUMNS,
    )

    previous = F.lag("hi").over(Window.partitionBy("block").orderBy("lo", "hi"))
    overlaps = per_block.select((F.col("lo") <= previous).alias("overlap")).agg(
        F.count_if("overlap").alias("overlaps")
    )
    text = sum((F.octet_length(c) for c in GEO_COLUMNS if c != "city_id"), F.lit(_ROW_BYTES))
    size = cells.agg(F.sum(text).alias("bytes"))
    backward = ranges.agg(F.count_if(F.col("lo") > F.col("hi")).alias("n")).first().n
    if backward:
        raise ValueError(f"{backward} IP ranges end before they begin")
    overlap_count = overlaps.first().overlaps
    if overlap_count:
        raise ValueError(f"{overlap_count} IP ranges overlap an earlier one")
    return RangeTable(cells, shifts, size.first().bytes or 0)


def _shift(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits)


def read_ranges(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> RangeTable:
    """Load a user's range table (``lo, hi, city_id, region``)."""
    schema = "lo bigint, hi bigint, city_id int, region string"
    return prepare_ranges(spark.read.format(fmt).schema(schema).options(**options).load(path))


def geo_join(
    df: DataFrame,
    ranges: RangeTable | DataFrame,
    *,
    ip: str = "ip",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    salts: int = 32,
) -> DataFrame:
    """Add the five region columns; unmatched and unreadable addresses get ``0``.

    Ranges of at most ``max_broadcast_bytes`` (measured, not estimated) are broadcast
    and the rows stay where they are.  Larger ones are shuffled on the cell; the rows of
    a cell are then spread over ``salts`` tasks, each with its copy of the cell's ranges,
    so that a busy address does not end up in one task, and adaptive execution splits
    what is still too large.  Rows whose address has no block with ranges, or is no IPv4
    address, are spread over all tasks by their hash.
    """
    ranges = ranges if isinstance(ranges, RangeTable) else prepare_ranges(ranges)
    kept = [c for c in df.columns if c not in GEO_COLUMNS]
    rows = bind(df.select(*kept), __ip=ip_to_long(F.col(ip))).withColumn(
        "__block", F.shiftright("__ip", _BLOCK_BITS)
    )
    shifts = ranges.shifts.select(F.col("block").alias("__b"), F.col("shift").alias("__shift"))
    # At most 2**16 blocks exist, so this side is small by construction.
    rows = rows.join(F.broadcast(shifts), F.col("__block") == F.col("__b"), "left").drop("__b")

    cells = ranges.cells.withColumnsRenamed({c: f"__{c}" for c in ranges.cells.columns})
    cells = cells.withColumnRenamed("__block", "__b")
    on = (
        (F.col("__block") == F.col("__b"))
        & (_shift(F.col("__ip"), F.col("__shift")) == F.col("__cell"))
        & F.col("__ip").between(F.col("__lo"), F.col("__hi"))
    )
    if ranges.cell_bytes <= max_broadcast_bytes:
        joined = rows.join(F.broadcast(cells), on, "left")
    else:
        number = F.xxhash64(*kept)
        rows = rows.withColumn("__salt", F.pmod(number, F.lit(salts)))
        nowhere = -1 - F.pmod(number, F.lit(1 << 30))   # no block: matches nothing, but is no hot key
        rows = rows.withColumn("__block", F.when(F.col("__shift").isNull(), nowhere).otherwise(F.col("__block")))
        cells = cells.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.join(cells.hint("merge"), on & (F.col("__salt") == F.col("__copy")), "left")
    return joined.select(
        *kept,
        *[F.coalesce(F.col(f"__{c}"), F.lit(0 if c == "city_id" else UNRESOLVED)).alias(c) for c in GEO_COLUMNS],
    )
