"""Quality rules as a short-circuit cascade of column expressions.

Every rule is an expression that says whether it rejects a text.  On a bounded sample each
rule is timed and its rejections counted; rules that reject much for their cost come first in
one CASE expression, and a text that one rule rejects isn't shown to the next.  The order
changes the cost and which rule gets the blame, never the verdict.

Null texts count as empty: no words, so ``few_words`` rejects them.  Repeated rows are judged
each; null ids and further columns pass through, and a column named like a result is replaced.
An empty table gives an empty result and leaves the rules in the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessloom.llm.common import BLANKS, kept_columns, stored

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
WINDOW = 5
#: Rows on which rules are timed and counted.
SAMPLE_ROWS = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------- what rules look at

def words_of(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def n_of(text: Column, characters: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words that stand in a 5-word window found twice or more in the text.

    Windows are compared by 64-bit hashes of 64-bit word hashes.  Most texts have no window
    twice and are done after one hash set; others sort (hash, place) and join what overlaps.
    """
    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))),
        )

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(ranked: Column) -> Column:
        twice = F.filter(ranked, lambda x, k: (
            F.get(ranked, k - 1)["h"].eqNullSafe(x["h"]) | F.get(ranked, k + 1)["h"].eqNullSafe(x["h"])
        ))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def count(grams: Column) -> Column:
        ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(
            let(ranked, repeated)
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, 0).otherwise(
        let(hashes, lambda h: let(windows(h), count))
    ).cast("long")


# ---------------------------------------------------------------- rules

@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the text and its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


RULES = (
    Rule("few_words", lambda text, words: F.size(words) < 10),
    Rule("repeated_windows", lambda text, words: 100 * n_repeat_words(words) > 20 * F.size(words)),
    Rule("repeated_lines", lambda text, words: let(
        lines_of(text), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 30 * F.size(x))),
    Rule("symbols", lambda text, words: 10 * n_of(text, SYMBOLS) > F.size(words)),
    Rule("shouting", lambda text, words: 2 * n_of(text, CAPITALS) > word_chars(text)),
    Rule("exclamations", lambda text, words: 4 * n_of(text, "!") > F.size(words)),
    Rule("digits", lambda text, words: 4 * n_of(text, DIGITS) > word_chars(text)),
    Rule("word_length", lambda text, words: (word_chars(text) > 15 * F.size(words)) | (
        2 * word_chars(text) < 3 * F.size(words))),
)
#: The rules that the fixed base verdict is made of.
BASE = ("few_words", "repeated_windows")


def measured_order(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """The rules by falling rejections per second on a sample of at most ``sample_rows`` rows."""
    sample = stored(docs.select(F.col(text).alias("text")).limit(sample_rows), "sample")
    worded = sample.select("text", words_of(F.col("text")).alias("words"))
    ranked = []
    for place, rule in enumerate(rules):
        hits = worded.agg(F.sum(F.when(rule.rejects(F.col("text"), F.col("words")), 1)).alias("n"))
        hits.collect()  # compiles the expression
        began = time.perf_counter()
        rejected = hits.collect()[0]["n"] or 0
        ranked.append((-rejected / max(time.perf_counter() - began, 1e-6), place))
    return [rules[place] for _, place in sorted(ranked)]


def cascade(
    docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by``, the first rule of the measured order that
    rejects the row."""
    rules = measured_order(docs, rules or RULES, text, sample_rows)
    keep = kept_columns(docs, ("kept", "rejected_by", "__words"))
    words = F.col("__words")
    blame = F.lit(None).cast("string")
    for rule in reversed(rules):
        blame = F.when(rule.rejects(F.col(text), words), F.lit(rule.name)).otherwise(blame)
    return (
        docs.select(*keep, words_of(F.col(text)).alias("__words"))
        .select(*keep, blame.alias("rejected_by"))
        .withColumn("kept", F.col("rejected_by").isNull())
    )


def quality_report(
    docs: DataFrame, number: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """A row per document: the base figures, ``base_failed`` and ``kept``.

    The figures are wanted for every row, so the two base rules read them; the cascade of
    the others runs only where the base has not failed.
    """
    others = measured_order(docs, [r for r in RULES if r.name not in BASE], text, sample_rows)
    t, words = F.col("text"), F.col("words")
    blame = F.lit(False)
    for rule in reversed(others):
        blame = F.when(rule.rejects(t, words), F.lit(True)).otherwise(blame)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        docs.select(F.col(number).alias("doc_id"), F.col(text).alias("text"), words_of(F.col(text)).alias("words"))
        .select(
            "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
            word_chars(t).alias("word_chars"), n_of(t, SYMBOLS).alias("n_symbols"),
            n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(words).alias("n_repeat_words"),
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~blame))
        .drop("text", "words")
    )


_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

REPORT_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: trim(x, {_BLANKS_SQL}) <> '') AS lines FROM d),
g AS (
  SELECT r, i, list_slice(words, i, i + 4) AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
spans AS (
  SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM twice),
counted AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM spans GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(translate(t, {_BLANKS_SQL}, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(counted.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(t) - length(translate(t, '{CAPITALS}', '')) AS capitals,
         length(t) - length(translate(t, '{DIGITS}', '')) AS digits,
         length(t) - length(translate(t, '!', '')) AS marks
  FROM w LEFT JOIN counted USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_dup_lines > 30 * n_lines OR 10 * n_symbols > n_words
            OR 2 * capitals > word_chars OR 4 * marks > n_words OR 4 * digits > word_chars
            OR word_chars > 15 * n_words OR 2 * word_chars < 3 * n_words) AS kept
FROM b"""
