"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from accessloom.sources.workspace import fresh_path

#: ASCII white space, the only white space that separates words in this package.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read from there: later steps neither
    compute it again nor depend on the executors that made it."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_columns(df: DataFrame, made: Iterable[str]) -> list[str]:
    """The columns of ``df`` an operator passes on; one that it makes itself replaces a
    column of the same name."""
    made = {name.lower() for name in made}
    return [name for name in df.columns if name.lower() not in made]


def utf8(column: pa.Array) -> list[bytes]:
    """The bytes of each text, null as empty."""
    values = column.cast(pa.large_binary()) if not pa.types.is_binary(column.type) else column
    return [value or b"" for value in values.to_pylist()]
