"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source form one stream in a seeded order of its documents, cut into blocks of
equal size (the last one takes the rest).  Seats for blocks are apportioned to sources by
highest quotients, ``u / (2k - 1)`` for the k-th seat of a source that is due ``u`` blocks.
The method is house monotone, so the seats of the first ``h`` shards are those of a smaller
house, and the difference is a shard's integer quota of each source.  A source's seats take
its blocks in a seeded permutation, again from the start when all have been taken, and a block
belongs to the shard whose quota its seat is in.

The least quotient that wins a seat is narrowed down by sums over all sources, a few at a time for
all shards; only seats about that quotient are then ranked, a few of each source.  A document's
place in its stream is found in two steps, over 4,096 hash slices of each source and then within
a slice, so a source or an id with a third of all rows isn't one task; copies of one text with one
id share a slice.  What comes together in one task is a row per source, or per source and slice.

Null texts have no words.  A null source is a source like others, last in order.  Null and
repeated ids are documents of their own, and equal rows are interchangeable.  Where nothing
has words all targets are 0.  Further columns are ignored by ``mix`` and kept by
``mixed_documents``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessloom.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARDS = 8
SEED = "mix"
#: Primes, the first of which that doesn't divide the number of blocks steps through them.
STEPS = (1000003, 999983, 999979)
#: Quotients tried at a time, and times; each leaves one of the gaps between those tried.
TRIED, NARROWED = 64, 5


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _seeded(seed: str, *values: Column) -> Column:
    return F.md5(F.concat_ws(" ", F.lit(seed), *(F.coalesce(v.cast("string"), F.lit("")) for v in values)))


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(source, place, source_size, target) for (source, source_size): ``share`` of all words
    dealt by weight, at most ``most`` times a source's own, and the excess dealt again.

    Sources are sorted by the level at which they are full; the water level after the k
    first are full is compared with the next one's.  One row per source, in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name))
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("place") - 1) % len(weights)).cast("long"))
    ranked = ranked.withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    rest = Window.orderBy("full_at", "place").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    due = share * F.sum("source_size").over(everything)
    others_full = most * (F.sum("source_size").over(everything) - F.sum("source_size").over(rest))
    level = (due - others_full) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level)
    is_full = F.col("level") > F.col("full_at")
    water = F.max(F.when(~is_full, F.col("level"))).over(everything)
    return levelled.select(
        "source", "place", "source_size",
        F.when(is_full, most * F.col("source_size")).otherwise(F.col("weight") * water).alias("target"),
    )


def _won(quotient: Column) -> Column:
    """How many seats of a source have at least this quotient, but for rounding at the border."""
    return F.least(F.col("most"), F.floor((F.col("due") / quotient + 1) / 2)).cast("long")


def _least_quotients(dues: DataFrame, houses: Sequence[int]) -> list[tuple[float, float]]:
    """For each house two quotients: at least the first have at most its seats, and at least the
    second as many or more.  The driver gets a number for each house and quotient tried."""
    ends = dues.agg(F.max("due"), F.min(F.col("due") / (2 * F.col("most")))).first()
    gaps = [(2.0 * ends[0], ends[1] / 2)] * len(houses)
    for _ in range(NARROWED):
        tried = [[high * (low / high) ** (i / TRIED) for i in range(TRIED + 1)] for high, low in gaps]
        every = sorted({q for some in tried for q in some})
        sums = dues.select(F.posexplode(F.array(*map(F.lit, every))).alias("i", "quotient"), "due", "most")
        rows = sums.groupBy("i").agg(F.sum(_won(F.col("quotient"))).alias("n")).collect()
        n = {every[r["i"]]: r["n"] for r in rows}
        gaps = [
            (min(q for q in some if n[q] <= house or q == some[0]), max(q for q in some if n[q] >= house or q == some[-1]))
            for some, house in zip(tried, houses)
        ]
    return gaps


def quotas(
    wanted: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, most: int = 2
) -> DataFrame:
    """(source, place, source_size, target, shard, blocks, seats, quota): the seats of a source
    up to each shard, and the shard's own."""
    n = F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / block_words))
    due = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size"))
    table = wanted.withColumn("blocks", n).withColumn("due", F.coalesce(due, F.lit(0.0)))
    table = stored(table.withColumn("most", most * F.col("blocks")), "dues")
    dues = table.where(F.col("due") > 0)
    total = dues.agg(F.sum("due")).first()[0] or 0.0
    houses = [int(total * h / shards + 0.5) for h in range(1, shards + 1)]
    gaps = _least_quotients(dues, houses) if total else [(1.0, 1.0)] * shards
    of_shard = F.array(*(
        F.struct(F.lit(h + 1).alias("shard"), F.lit(houses[h]).cast("long").alias("house"),
                 F.lit(high).alias("high"), F.lit(low).alias("low")) for h, (high, low) in enumerate(gaps)))
    table = table.withColumn("of", F.explode(of_shard)).select("*", "of.*").drop("of")
    # A seat more on either side, as the border itself is rounded.
    sure = F.greatest(F.lit(0).cast("long"), _won(F.col("high")) - 1)
    last = F.least(F.col("most"), _won(F.col("low")) + 1)
    table = table.withColumn("sure", sure).withColumn("last", F.when(F.col("due") > 0, last).otherwise(0))
    left = table.groupBy("shard").agg((F.first("house") - F.sum("sure")).alias("left"))
    seats = (
        table.where(F.col("last") > F.col("sure"))
        .select("place", "shard", "due", F.explode(F.sequence(F.col("sure") + 1, F.col("last"))).alias("seat"))
        .withColumn("quotient", F.col("due") / (2 * F.col("seat") - 1))
    )
    ranked = seats.withColumn("rank", F.row_number().over(
        Window.partitionBy("shard").orderBy(F.col("quotient").desc(), "place", "seat")))
    won = ranked.join(left, "shard").where(F.col("rank") <= F.col("left")).groupBy("place", "shard").agg(
        F.count("*").alias("won"))
    by_shard = Window.partitionBy("place").orderBy("shard")
    seats_so_far = F.col("sure") + F.coalesce("won", F.lit(0))
    return (
        table.join(won, ["place", "shard"], "left")
        .withColumn("seats", seats_so_far.cast("long"))
        .withColumn("quota", F.col("seats") - F.coalesce(F.lag("seats").over(by_shard), F.lit(0)))
        .select("source", "place", "source_size", "target", "shard", "blocks", "seats", "quota")
    )


def _streams(sized: DataFrame) -> DataFrame:
    """Adds ``begins``, the words before a row in its source's stream."""
    in_slice = Window.partitionBy("source", "slice").orderBy("spread", "doc_id", "size")
    running = F.sum("size").over(in_slice.rowsBetween(Window.unboundedPreceding, -1))
    rows = sized.withColumn("in_slice", F.coalesce(running, F.lit(0)))
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        F.col("source").alias("source_"), F.col("slice").alias("slice_"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("slice") == F.col("slice_"))
    return rows.join(slices, same).withColumn("begins", F.col("before") + F.col("in_slice")).drop(
        "source_", "slice_", "before", "in_slice")


def _turn(block: Column, epoch: int = 0) -> Column:
    """The seat number that takes a block in an epoch."""
    step = F.lit(STEPS[-1])
    for prime in reversed(STEPS[:-1]):
        step = F.when(F.col("blocks") % prime != 0, prime).otherwise(step)
    return F.pmod(block * step.cast("long") + F.col("first"), F.col("blocks")) + epoch * F.col("blocks")


def _placed(docs: DataFrame, source: str, text: str, number: str, options: dict) -> DataFrame:
    """The rows of ``docs`` with size, begins, source_size, target, blocks, first and ``seats``,
    those of all shards up to each."""
    seed, shards = options.get("seed", SEED), options.get("shards", SHARDS)
    sized = docs.select(
        F.col(number).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        _seeded(seed, F.col(number), F.col(text)).alias("spread"),
        *([F.col("__row")] if "__row" in docs.columns else []),
    ).withColumn("slice", F.substring("spread", 1, 3))
    sized = stored(sized, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = targets(sizes, options.get("weights", WEIGHTS))
    table = quotas(wanted, options.get("block_words", BLOCK_WORDS), shards)
    # the first 8 hexadecimal digits of a hash of the source, as a number
    first = F.conv(F.substring(_seeded(seed, F.coalesce("source", F.lit("?"))), 1, 8), 16, 10)
    in_order = F.array_sort(F.collect_list(F.struct("shard", "seats")))
    plan = table.groupBy("source", "source_size", "target", "blocks").agg(in_order["seats"].alias("seats"))
    plan = stored(plan.select(
        F.col("source").alias("source_"), "source_size", "target", "blocks", "seats",
        F.pmod(first.cast("long"), F.col("blocks")).alias("first"),
    ), "quotas")
    rows = _streams(sized)
    same = F.col("source").eqNullSafe(F.col("source_"))
    return rows.join(plan, same).drop("source_", "slice", "spread")


def _with_blocks(rows: DataFrame, block_words: int) -> DataFrame:
    last = F.col("blocks") - 1
    return rows.withColumn("block_a", F.least(F.floor(F.col("begins") / block_words), last)).withColumn(
        "block_b",
        F.greatest(F.col("block_a"), F.least(F.floor((F.col("begins") + F.col("size") - 1) / block_words), last)),
    )


def mix(
    docs: DataFrame, number: str = "doc_id", source: str = "source", text: str = "text",
    by_shard: bool = False, **options
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target and ``taken``, the words
    the mix takes of it, repeats counted; ``by_shard`` adds ``shard_words``, an array of those of
    each shard.  Options: weights, block_words, shards, seed."""
    block_words, shards = options.get("block_words", BLOCK_WORDS), options.get("shards", SHARDS)
    rows = _placed(docs, source, text, number, options)
    rows = _with_blocks(rows, block_words)
    last = F.col("blocks") - 1

    def overlap(i: Column) -> Column:
        ends = F.when(i < last, (i + 1) * block_words).otherwise(F.col("source_size"))
        return F.least(ends, F.col("begins") + F.col("size")) - F.greatest(i * block_words, F.col("begins"))

    used = F.transform(F.sequence("block_a", "block_b"), lambda i: F.struct(
        overlap(i).alias("n"), _turn(i).alias("a"), _turn(i, 1).alias("b")))
    rows = rows.withColumn("used", F.when(F.col("size") > 0, used).otherwise(F.array().cast(_USED)))

    def up_to(seats: Column) -> Column:
        times = lambda u: (u["a"] < seats).cast("long") + (u["b"] < seats).cast("long")
        return F.aggregate("used", F.lit(0).cast("long"), lambda n, u: n + u["n"] * times(u))

    names = ["doc_id", "source", "size", "source_size", "target"]
    if not by_shard:
        return rows.select(*names, up_to(F.element_at("seats", -1)).alias("taken"))
    rows = rows.withColumn("so_far", F.array(*(up_to(F.col("seats")[h]) for h in range(shards))))
    own = F.transform("so_far", lambda n, i: n - F.when(i > 0, F.col("so_far")[i - 1]).otherwise(0))
    return rows.select(*names, F.element_at("so_far", -1).alias("taken"), own.alias("shard_words"))


_USED = "array<struct<n: bigint, a: bigint, b: bigint>>"


def mixed_documents(
    docs: DataFrame, number: str = "doc_id", source: str = "source", text: str = "text",
    shard: str | None = None, **options
) -> DataFrame:
    """The mix itself: for each time a document is used, a row of ``docs`` with the words the
    mix takes that time; the text is unchanged if it takes all, else the chosen words with
    the white space after each.  With ``shard``, a row for each use in each shard, whose
    number, from 1, is in the column of that name."""
    block_words, shards = options.get("block_words", BLOCK_WORDS), options.get("shards", SHARDS)
    names = [c for c in docs.columns if shard is None or c.lower() != shard.lower()]
    whole = docs.select(*names).withColumn("__row", F.monotonically_increasing_id())
    whole = stored(whole, "numbered")
    rows = _with_blocks(_placed(whole, source, text, number, options), block_words)
    #: (shard, seats before it, seats up to it)
    spans = [(0, F.lit(0), F.element_at("seats", -1))] if shard is None else [
        (h, F.col("seats")[h - 2] if h > 1 else F.lit(0), F.col("seats")[h - 1]) for h in range(1, shards + 1)]

    def taken_in(epoch: int, h: int, before: Column, up_to: Column) -> Column:
        chosen = F.filter(F.sequence("block_a", "block_b"), lambda i: (
            _turn(i, epoch) >= before) & (_turn(i, epoch) < up_to))
        return F.struct(F.lit(h).alias("shard"), chosen.alias("chosen"))

    rows = rows.where(F.col("size") > 0).select(
        "__row", "size", "begins", "blocks", "block_a", "block_b",
        F.inline(F.array(*(taken_in(epoch, *span) for epoch in (0, 1) for span in spans))),
    ).where(F.size("chosen") > 0)
    rows = rows.select(*(F.col(c).alias(f"__{c.strip("_")}_") for c in rows.columns))
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    block = lambda k: F.least(F.floor((F.col("__begins_") + k) / block_words), F.col("__blocks_") - 1)
    part = F.array_join(F.filter(pieces, lambda p, k: F.array_contains(F.col("__chosen_"), block(k))), "")
    all_of_it = F.size("__chosen_") == F.col("__block_b_") - F.col("__block_a_") + 1
    joined = whole.join(rows, F.col("__row") == F.col("__row_"))
    out = joined.withColumn(text, F.when(all_of_it, F.col(text)).otherwise(part))
    return out.select(*names, *([F.col("__shard_").alias(shard)] if shard is not None else []))


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{SEED} ' || coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS spread FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes),
weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
filled AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM weighed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2.0::DOUBLE * (sum(source_size) OVER () - sum(source_size) OVER rest)) / sum(weight) OVER rest AS level
  FROM filled WINDOW rest AS (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
wanted AS (
  SELECT source, place, source_size, greatest(1, source_size // {BLOCK_WORDS}) AS blocks,
         CASE WHEN level > full_at THEN 2.0::DOUBLE * source_size
              ELSE weight * max(CASE WHEN level <= full_at THEN level END) OVER () END AS target FROM levels),
dues AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * blocks / source_size ELSE 0 END AS due FROM wanted),
candidates AS (
  SELECT place, k, due / (2 * k - 1) AS quotient
  FROM (SELECT place, due, unnest(range(1, CAST(2 * blocks + 1 AS BIGINT))) AS k FROM dues WHERE due > 0)),
houses AS (
  SELECT h, CAST(floor(total * h / {SHARDS} + 0.5) AS BIGINT) AS house
  FROM (SELECT sum(due) AS total, unnest(range(1, {SHARDS} + 1)) AS h FROM dues)),
won AS (
  SELECT place, k - 1 AS turn, (SELECT count(*) FROM houses WHERE house < r) + 1 AS shard
  FROM (SELECT place, k, row_number() OVER (ORDER BY quotient DESC, place, k) AS r FROM candidates)
  WHERE r <= (SELECT max(house) FROM houses)),
plan AS (
  SELECT d.*, ('0x' || substr(md5('{SEED} ' || coalesce(source, '?')), 1, 8))::BIGINT % blocks AS first,
         CASE WHEN blocks % {STEPS[0]} <> 0 THEN {STEPS[0]} WHEN blocks % {STEPS[1]} <> 0 THEN {STEPS[1]}
              ELSE {STEPS[2]} END AS step
  FROM dues d),
streams AS (
  SELECT doc_id, s.source AS source, place, size, source_size, target, blocks, first, step,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY spread, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins,
         row_number() OVER () AS r
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
used AS (
  SELECT *, unnest(range(least(begins // {BLOCK_WORDS}, blocks - 1)::BIGINT,
                         (least((begins + size - 1) // {BLOCK_WORDS}, blocks - 1) + 1)::BIGINT)) AS i
  FROM streams WHERE size > 0),
turns AS (
  SELECT r, place, (i * step + first) % blocks + epoch * blocks AS turn,
         least(CASE WHEN i < blocks - 1 THEN (i + 1) * {BLOCK_WORDS} ELSE source_size END, begins + size)
         - greatest(i * {BLOCK_WORDS}, begins) AS n
  FROM used, (VALUES (0), (1)) AS e(epoch)),
counted AS (
  SELECT r, shard, sum(n) AS n FROM turns JOIN won USING (place, turn) GROUP BY ALL),
shares AS (
  SELECT r, list(coalesce(n, 0)::BIGINT ORDER BY h) AS shard_words
  FROM (SELECT streams.r AS r, h AS shard, h FROM streams, houses) LEFT JOIN counted USING (r, shard) GROUP BY r)
SELECT doc_id, source, size, source_size, target, CAST(list_sum(shard_words) AS BIGINT) AS taken, shard_words
FROM streams JOIN shares USING (r)"""
