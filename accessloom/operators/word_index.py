"""An inverted index of a text column with few distinct values, such as user agents.

For each period the index has the distinct texts with the number of rows of each (``texts``), and
the words of these texts (``postings``: word, text), sorted by word, so a word's list is a run of
rows that Parquet finds by its statistics.  Word questions are answered by intersecting lists
and adding up counts; the rows of the access table aren't read.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from accessloom.functions.text import fulltext_words, has_word
from accessloom.sources.derived import keep_up, read_part
from accessloom.sources.tables import PERIOD

_WORDS = r"([\p{L}\p{N}_]+)"


def _id(column: str):
    return F.unhex(F.md5(F.col(column).cast("binary")))


def texts_of(rows: DataFrame, column: str) -> DataFrame:
    """``period, id, text, n``: the distinct texts of each period and how many rows have them."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(PERIOD, F.col(column).alias("text")).agg(
        F.count("*").alias("n"))
    return counted.select(PERIOD, _id("text").alias("id"), "text", "n").sortWithinPartitions(PERIOD, "id")


def postings_of(rows: DataFrame, column: str) -> DataFrame:
    """``period, word, id``: which texts have a word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(1)))
    texts = rows.filter(F.col(column).isNotNull()).select(PERIOD, F.col(column).alias("text")).distinct()
    found = texts.select(PERIOD, F.explode(words).alias("word"), _id("text").alias("id"))
    return found.sortWithinPartitions(PERIOD, "word", "id")


def keep_index(
    spark: SparkSession, access: str, index: str, column: str = "ua", *, schema: StructType | None = None
) -> list[str]:
    """Bring a stored index up to date with the access table; the periods made again."""
    parts = {"texts": functools.partial(texts_of, column=column),
             "postings": functools.partial(postings_of, column=column)}
    return keep_up(spark, access, index, parts, schema=schema)


class WordIndex:
    """A stored index, of all or some periods."""

    def __init__(self, spark: SparkSession, index: str, periods: list[str] | None = None):
        self.texts = read_part(spark, index, "texts", periods=periods)
        self.postings = read_part(spark, index, "postings", periods=periods)

    def with_word(self, word: str) -> DataFrame:
        """``period, id`` of the texts that hold a word."""
        parts = re.findall(r"\w+", word.lower())
        if not parts:
            raise ValueError(f"{word!r} has no word")
        lists = [self.postings.filter(F.col("word") == p).select(PERIOD, "id") for p in parts]
        found = functools.reduce(lambda a, b: a.join(b, [PERIOD, "id"], "left_semi"), lists)
        if parts != [word.lower()]:  # signs between its words: look at the texts that have all of these
            shown = self.texts.join(found, [PERIOD, "id"], "left_semi")
            found = shown.filter(has_word(F.col("text"), word)).select(PERIOD, "id")
        return found

    def matching(self, query: str, mode: str = "natural") -> DataFrame:
        """``period, id`` of the texts a word list finds; the same modes as a scan's."""
        required, excluded, optional = fulltext_words(query, mode)
        keys = [PERIOD, "id"]
        if required:
            found = functools.reduce(lambda a, b: a.join(b, keys, "left_semi"), map(self.with_word, required))
        elif optional:
            found = functools.reduce(lambda a, b: a.unionByName(b), map(self.with_word, optional)).distinct()
        else:
            return self.texts.select(*keys).limit(0)
        for word in excluded:
            found = found.join(self.with_word(word), keys, "left_anti")
        return found

    def counts(self, query: str, mode: str = "natural") -> DataFrame:
        """``total_num, text``: the texts found and how many rows have them."""
        found = self.texts.join(self.matching(query, mode), [PERIOD, "id"], "left_semi")
        return found.groupBy("text").agg(F.sum("n").alias("total_num")).select("total_num", "text")

    def distinct_texts(self, query: str, mode: str = "natural") -> DataFrame:
        """``num``: how many different texts are found."""
        return self.matching(query, mode).select("id").distinct().agg(F.count("*").alias("num"))
