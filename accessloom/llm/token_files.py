"""Token ids of a corpus in blocks with Elias-Fano coded document boundaries.

A table of blocks is written through Spark, so any file system it knows will do and a lost
executor's blocks are written again.  A block holds the ids of consecutive documents, two
bytes an id where the vocabulary allows it.  Where each document ends, and the document
numbers themselves, are monotone sequences: each is kept in Elias-Fano form (``l`` low bits
packed, high bits in unary) with the place of every 64th one as a 32-bit sample, so that
``select`` finds the i-th boundary without a table of 64-bit offsets.

Documents stand in ascending order of their number, nulls first, equal numbers by text.
Null texts are empty documents of the end id alone.  Other columns aren't stored.  An empty
table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessloom.llm.tokens import encoder

SAMPLE = 64

_SEQUENCE = "low_bits int, low binary, high binary, samples binary"
BLOCK_SCHEMA = f"""
    part int, block int, start long, n_ids long, n_docs int, null_docs int, id_base long,
    numbers struct<{_SEQUENCE}>, ends struct<{_SEQUENCE}>, id_bytes int, ids binary"""


class EliasFano:
    """A sequence of non-negative integers that never fall."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(values[-1]) // n).bit_length()
        low_bits = max(0, low_bits - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel())
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low.tobytes(), np.packbits(high).tobytes(),
                   ones[::SAMPLE].astype("<u4").tobytes())

    def row(self) -> dict:
        return {"low_bits": self.low_bits, "low": self.low, "high": self.high,
                "samples": self.samples.tobytes()}

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, ones are counted byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        bits = self.high[byte] & (0xFF >> (at & 7))
        while left >= bits.bit_count():
            left -= bits.bit_count()
            byte += 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= ~(1 << bits.bit_length() - 1)
        one = byte * 8 + 8 - bits.bit_length()
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (self.low[bit >> 3] >> (7 - (bit & 7)) & 1) << k
        return (one - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        """All values, for a scan."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8)))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8))[: self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) << np.arange(self.low_bits)
        return (ones - np.arange(self.n) << self.low_bits) + low.sum(axis=1)


def _sequence(n: int, row: dict) -> EliasFano:
    return EliasFano(n, row["low_bits"], row["low"], row["high"], row["samples"])


def write_token_files(
    docs: DataFrame, path: str, number: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = 2, block_bytes: int = 1 << 20,
    partitions: int | None = None,
) -> None:
    """Encode every whole text, append ``end_id`` and write the blocks.

    Rows are dealt by ranges of (number, hash of the text), so that a number that many rows
    share is no single task.  A block ends with the document that takes it to ``block_bytes``.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(number).cast("long").alias("number"), F.col(text).alias("text"))
    rows = rows.withColumn("spread", F.xxhash64("text"))
    order = [F.col("number").asc_nulls_first(), F.col("spread"), F.col("text")]
    rows = rows.repartitionByRange(partitions, *order[:2]).sortWithinPartitions(*order)

    def blocks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = coder.dtype.itemsize
        ids, numbers, start, count = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal start, count
            sizes = np.array([len(x) // width for x in ids])
            given = np.array([x for x in numbers if x is not None], np.int64)
            base = int(given[0]) if len(given) else 0
            row = {
                "part": part, "block": count, "start": start, "n_ids": int(sizes.sum()),
                "n_docs": len(ids), "null_docs": len(ids) - len(given), "id_base": base,
                "numbers": EliasFano.of(given.view(np.uint64) - np.uint64(base % 2**64)).row(),
                "ends": EliasFano.of(np.cumsum(sizes)).row(),
                "id_bytes": width, "ids": b"".join(ids),
            }
            start, count = start + row["n_ids"], count + 1
            ids.clear()
            numbers.clear()
            return pa.RecordBatch.from_pylist([row], _arrow_block())

        held = 0
        for batch in source:
            for n, found in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1), end_id)):
                ids.append(found)
                numbers.append(n)
                held += len(ids[-1])
                if held >= block_bytes:
                    held = 0
                    yield block()
        if ids:
            yield block()

    rows.select("number", "text").mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def _arrow_block() -> pa.Schema:
    sequence = pa.struct([("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
                          ("samples", pa.binary())])
    return pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
        ("n_docs", pa.int32()), ("null_docs", pa.int32()), ("id_base", pa.int64()),
        ("numbers", sequence), ("ends", sequence), ("id_bytes", pa.int32()), ("ids", pa.binary()),
    ])


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start (ids before it), n_tokens and its
    ``ids`` (little endian, ``id_bytes`` each), or with ``digest`` their ``ids_crc32``.

    What goes through the driver is one count per written part.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, ids_before = {}, 0
    for row in totals:
        before[row["part"]] = ids_before
        ids_before += row["n"]
    kind = "ids_crc32 long" if digest else "ids binary, id_bytes int"

    def documents(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                yield _documents(row, before[row["part"]], digest)

    return blocks.mapInArrow(documents, f"doc_id long, start long, n_tokens long, {kind}")


def _documents(row: dict, before: int, digest: bool) -> pa.RecordBatch:
    n, nulls = row["n_docs"], row["null_docs"]
    ends = _sequence(n, row["ends"]).all()
    starts = np.concatenate([[0], ends[:-1]])
    numbers = _sequence(n - nulls, row["numbers"]).all().view(np.uint64)
    numbers = (numbers + np.uint64(row["id_base"] % 2**64)).view(np.int64)
    columns = {
        "doc_id": pa.array([None] * nulls + numbers.tolist(), pa.int64()),
        "start": pa.array(starts + before + row["start"], pa.int64()),
        "n_tokens": pa.array(ends - starts, pa.int64()),
    }
    ids, width = row["ids"], row["id_bytes"]
    cut = [ids[a * width : b * width] for a, b in zip(starts.tolist(), ends.tolist())]
    if digest:
        columns["ids_crc32"] = pa.array([ids_crc32(x, width) for x in cut], pa.int64())
    else:
        columns["ids"] = pa.array(cut, pa.binary())
        columns["id_bytes"] = pa.array([width] * n, pa.int32())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def ids_crc32(ids: bytes, width: int) -> int:
    """The CRC of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def document(block: dict, i: int) -> bytes:
    """The ids of the i-th document of a block by two selects, without decoding the rest."""
    ends, width = _sequence(block["n_docs"], block["ends"]), block["id_bytes"]
    start = ends.select(i - 1) if i else 0
    return block["ids"][start * width : ends.select(i) * width]
