"""Spelling variants: words one edit apart, by permuterm rotations.

A word is marked by a terminator and turned in every way.  Turning puts any place of the word
last, so what is left of a rotation without its last letter says "the word without that letter":
two words that differ by one replaced letter share it at one place, and a word that has one
letter less is the whole rotation itself.  Sorted by that text, the rotations with one prefix
stand together; a scan over each such group counts every member's neighbours and finds its best
one.  A group holds one word for each letter that may stand in the skipped place, so it is
bounded by the alphabet; pairs are never made.

Words are ranked by falling count, then by code points, so the best neighbour of a word is the
one of least rank.  Forms lead to larger counts, at least doubled, and roots are found by pointer
jumping in as many rounds as the logarithm of the longest chain.

Rotations of words of ``LONG`` code points or more are not written out, which would be quadratic
in the word: their keys are 124-bit polynomial hashes, computed for all places of a word at once
from the hashes of its beginnings.

Null and empty texts have no words.  A null id counts as the text '' where words are damaged.
Repeated rows count each.  Other columns are ignored, whatever their names.  An empty table, or
one in which no word is frequent enough, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accessloom.llm.common import stored

RUN = r"([A-Za-zÀ-ÿ]+)"
LARGE, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = "$"  # no letter, so it stands for the end of a word only
#: Code points beside the mark from which on a key is a hash.
LONG = 64
#: Rows made of a long word at once.
ROWS = 1 << 16
_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
_BASES = np.array([1315423911, 1103515245, 1664525013, 1566083941], np.uint64)
_KEYS = "key string, rank long, cut boolean, lead boolean"


def word_counts(
    docs: DataFrame, text: str = "text", number: str = "doc_id", shortest: int = 5, least: int = 3,
    damage: int | None = 97,
) -> DataFrame:
    """(word, n) of the words of ``shortest`` letters or more that occur ``least`` times or more.

    Every run of letters whose crc32 together with the id is divisible by ``damage`` loses one
    letter first (None: no run does).
    """
    runs = docs.select(
        F.coalesce(F.col(number).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(1))).alias("run"),
    ).select("id", F.translate("run", LARGE, SMALL).alias("run"))
    runs = runs.withColumn("size", F.length("run")).where(F.col("size") >= shortest)
    word = F.col("run")
    if damage is not None:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.col("size")).cast("int")
        short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
        word = F.when(F.col("h") % damage == 0, short).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least) & (F.length("word") >= shortest))


def ranked(counts: DataFrame) -> DataFrame:
    """(rank, word, n); ranks ascend with falling count, then by code points, with gaps."""
    order = [F.desc("n"), F.asc("word")]
    rows = counts.select("word", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "ranked_words")


def hashed_keys(word: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all whole rotations of a word, and of all without their last letter.

    Row i of the first is the rotation that starts at place i; row i of the second skips the
    letter at place i.
    """
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = len(codes)
    whole, cut = np.empty((size + 1, 4), np.uint64), np.empty((size, 4), np.uint64)
    for k, (p, base) in enumerate(zip(_PRIMES, _BASES)):
        up, down = _powers(base, p, size + 2), _powers(np.uint64(pow(int(base), -1, int(p))), p, size + 2)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[:size] % p)]) % p

        def hashed(a_end, b_start, length):
            """Of the letters from b_start on, the mark, and those before a_end."""
            b = (sums[size] + p - sums[b_start]) % p * down[b_start] % p
            return (b + np.uint64(ord(MARK)) * up[length] % p + sums[a_end] * up[length + 1] % p) % p

        at = np.arange(size + 1)
        whole[:, k] = hashed(at, at, size - at)
        at = np.arange(size)
        cut[:, k] = hashed(at, at + 1, size - 1 - at)
    return whole, cut


def _powers(base: np.uint64, p: np.uint64, count: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * (out[-1] * base % p) % p])
    return out[:count]


def _long_rotations(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for rank, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole, cut = hashed_keys(word)
            codes = np.frombuffer(word.encode("utf-32-le"), "<u4")
            lead = np.concatenate([[True], codes[1:] != codes[:-1]])
            parts = [(whole, False, np.zeros(len(whole), bool))]
            if len(word) > LONG:
                parts.append((cut, True, lead))
            for hashes, is_cut, leads in parts:
                for at in range(0, len(hashes), ROWS):
                    some = hashes[at : at + ROWS]
                    keys = ["#%x.%x.%x.%x" % tuple(h) for h in some.tolist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, pa.string()), pa.array(np.full(len(some), rank, np.int64)),
                        pa.array(np.full(len(some), is_cut)), pa.array(leads[at : at + ROWS]),
                    ], names=["key", "rank", "cut", "lead"])


def rotations(words: DataFrame) -> DataFrame:
    """(key, rank, cut, lead) of all rotations of (rank, word).

    A rotation gives its whole text (cut false) and, if a letter is last, the text without it
    (cut true).  Skipping any letter of a run of equal ones leaves the same word; ``lead`` marks
    the first, so that a shorter word is met once.
    """
    size = F.length("word")
    turned = words.where(size <= LONG).select(
        "rank", "word", size.alias("size"), F.explode(F.sequence(F.lit(0), size)).alias("i"))
    rest = F.concat(F.substring("word", F.col("i") + 1, F.col("size")), F.lit(MARK))
    last, before = (F.substring("word", F.col("i") - k, F.lit(1)) for k in (0, 1))
    none = F.lit(False)
    whole = F.struct(
        F.concat(rest, F.substring("word", F.lit(1), F.col("i"))).alias("key"), none.alias("cut"), none.alias("lead"))
    cut = F.struct(
        F.concat(rest, F.substring("word", F.lit(1), F.col("i") - 1)).alias("key"), F.lit(True).alias("cut"),
        ((F.col("i") == 1) | (last != before)).alias("lead"))
    written = F.when((F.col("i") > 0) & (F.col("size") < LONG), F.array(whole, cut)).when(
        F.col("i") == 0, F.when(F.col("size") < LONG, F.array(whole)).otherwise(F.array().cast(
            "array<struct<key:string,cut:boolean,lead:boolean>>"))).otherwise(F.array(cut))
    short = turned.select("rank", F.explode(written).alias("r")).select("r.key", "rank", "r.cut", "r.lead")
    long = words.where(size >= LONG).select("rank", "word").mapInArrow(_long_rotations, _KEYS)
    return short.unionByName(long)


def near_words(words: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are one edit from a word, and the first of them.

    Words without a neighbour are left out.  Two words that differ by a replaced letter share
    one key, two that differ by a skipped letter share one key with ``lead``, so each
    neighbour is counted once.
    """
    group = W.partitionBy("key")
    ordered = group.orderBy("whole", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rotations(words).withColumn("whole", ~F.col("cut")).select(
        "key", "rank", "whole", "lead",
        F.count_if("cut").over(group).alias("n_cut"), F.count_if("lead").over(group).alias("n_lead"),
        F.min(F.when(F.col("whole"), F.col("rank"))).over(group).alias("short"),
        F.min(F.when(F.col("lead"), F.col("rank"))).over(group).alias("first_lead"),
        F.first("rank").over(ordered).alias("first"), F.nth_value("rank", 2).over(ordered).alias("second"),
    )
    other = F.when(F.col("n_cut") > 1, F.when(F.col("first") == F.col("rank"), F.col("second")).otherwise(F.col("first")))
    short = F.when(F.col("lead"), F.col("short"))
    rows = rows.select(
        "rank",
        F.when(F.col("whole"), F.col("n_lead")).otherwise(
            F.col("n_cut") - 1 + F.when(short.isNotNull(), 1).otherwise(0)).alias("n"),
        F.when(F.col("whole"), F.col("first_lead")).otherwise(F.least(other, short)).alias("best"),
    )
    return rows.where("n > 0").groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(up: DataFrame) -> DataFrame:
    """(rank, root) from (rank, to) without cycles: where following ``to`` ends."""
    up = stored(up.select("rank", "to"), "forms")
    while True:
        over = up.select(F.col("rank").alias("r"), F.col("to").alias("beyond"))
        up = stored(
            up.join(over, F.col("to") == F.col("r"), "left").select(
                "rank", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "forms")
        if up.where("moved").isEmpty():
            return up.select("rank", F.col("to").alias("root"))
        up = up.select("rank", "to")


def spelling_groups(
    docs: DataFrame, text: str = "text", number: str = "doc_id", shortest: int = 5, least: int = 3,
    damage: int | None = None, factor: int = 2,
) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    The form of a word is its neighbour of largest count (ties: the first by code points), if
    that count is at least ``factor`` times its own; the root is where forms end.
    """
    if factor < 2:
        raise ValueError("forms must lead to larger counts")
    words = ranked(word_counts(docs, text, number, shortest, least, damage))
    near = stored(near_words(words), "near_words")
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    rows = words.join(near, "rank", "left").join(best, "best", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    rows = stored(rows.select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("to"), F.when(is_form, F.col("best_word")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "word_forms")
    ends = roots(rows.where(F.col("to").isNotNull()))
    names = words.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    return rows.join(ends.join(names, "root"), "rank", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


# The table of crc32 is made by its rule; a text's bytes are read from its hexadecimal form.
SPELLING_SQL = """
WITH RECURSIVE steps AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS v, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      range(0, strlen(id || ':' || run)),
      lambda k: CAST(('0x' || substr(hex(encode(id || ':' || run)), CAST(2 * k + 1 AS INT), 2)) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM runs, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0
          THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
          ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, substr(word, CAST(i + 2 AS INT)) || '$' || left(word, CAST(i AS INT)) AS key
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
wholes AS (
  SELECT word, n, substr(word, CAST(i + 1 AS INT)) || '$' || left(word, CAST(i AS INT)) AS key
  FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.key = b.key AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN wholes b ON a.key = b.key
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN wholes b ON a.key = b.key),
near AS (
  SELECT word, count(*) AS n_near, min(struct_pack(m := -m, w := other)) AS best FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * w.n THEN best.w END AS form,
         CASE WHEN -best.m >= 2 * w.n THEN -best.m END AS form_n
  FROM words w LEFT JOIN near USING (word)),
chain AS (
  SELECT word, word AS up, 0 AS k FROM forms
  UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON forms.word = chain.up AND form IS NOT NULL),
ends AS (SELECT word, arg_max(up, k) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
