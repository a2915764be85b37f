"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature is 64 symbols of 16 bits.  It is split into 15 chunks; two signatures that differ
in at most 29 symbols agree, by the pigeonhole principle, in some chunk up to one symbol, so
each chunk gives a key for each symbol it may differ in (that symbol left out).  All pairs
within distance 29 therefore share a key.  At a similarity of 0.75 the distance has mean 16 and
standard deviation 3.5, so about one pair in 10,000 lies beyond, and fewer of more similar ones.

Texts with equal shingle sets are one class, and classes are linked only after their full
shingle sets have been compared.  Within a key, classes are first compared with the least one.
Where a key still joins classes of different components, its signatures are compared in blocks:
first each class meets its nearest one of another component, then every pair within the distance
that no link joins yet is compared in full, in the task of the first key that both share.  So no
link between components is lost, and no pairs are handed on but confirmed ones.

Words are split at ASCII white space after lower-casing A-Z.  Texts without words (null, empty,
blank) link with nothing.  Texts of fewer than five words are one shingle.  Rows with equal or
null ids are documents of their own; a null id is never the least of several and never kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessloom.llm.common import stored, utf8
from accessloom.llm.components import components

SYMBOLS, DISTANCE, CHUNKS, WINDOW = 64, 29, 15, 5
#: Signatures that meet in one block of a key's second pass.
BLOCK = 1024
_EDGES = np.linspace(0, SYMBOLS, CHUNKS + 1).round().astype(int)
_RANDOM = np.random.default_rng(20240115)
_FACTORS = _RANDOM.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, WINDOW)
    total = sum(hashes[k : n - size + 1 + k] * _PLACES[k] for k in range(size))
    return np.unique(mixed(total, size))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of symbols for each set that isn't empty."""
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    done = 0
    while done < len(sets):
        until, n = done, 0
        while until < len(sets) and (until == done or n + len(sets[until]) <= 1 << 15):
            n += len(sets[until])
            until += 1
        values = np.concatenate(sets[done:until])
        starts = np.cumsum([0] + [len(s) for s in sets[done : until - 1]])
        for k in range(SYMBOLS):
            out[done:until, k] = np.minimum.reduceat(values * _FACTORS[k], starts).astype(np.uint16)
        done = until
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """The 64 keys of each signature: its chunks, each with one symbol left out."""
    wide = signature.astype(np.uint64)
    out = []
    for chunk in range(CHUNKS):
        places = range(_EDGES[chunk], _EDGES[chunk + 1])
        for left_out in places:
            key = np.full(len(wide), left_out, np.uint64)
            for p in places:
                if p != left_out:
                    key = mixed(key ^ wide[:, p], p)
            out.append(key & ~np.uint64(63) | np.uint64(left_out))  # the symbol can be read from the key
    return np.stack(out, axis=1).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


# ---------------------------------------------------------------- steps

_SIGNED = [
    T.StructField(name, T.BinaryType() if name in ("signature", "packed") else T.LongType())
    for name in ("n_shingles", "s1", "s2", "signature", "packed", "uid", "doc_id")
]


def _signed(docs: DataFrame, number: str, text: str, rest: Column | None = None) -> DataFrame:
    """Each document's set size, two hashes of its set, signature and compressed text; null
    texts stay null.  ``rest`` goes along."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, press = TaskContext.get().partitionId() << 40, zstandard.ZstdCompressor(level=1)
        for whole in source:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts, given = utf8(batch.column(0)), batch.column(0).is_valid().to_pylist()
                sets = [shingles(t) for t in texts]
                some = [s for s in sets if len(s)]
                signed = iter(signatures(some)) if some else iter(())
                sums = [[int(mixed(s, salt).sum(dtype=np.uint64).view(np.int64)) for s in sets] for salt in (7, 8)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()),
                    pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([press.compress(t) if g else None for t, g in zip(texts, given)], pa.binary()),
                    pa.array(range(uid, uid + len(texts)), pa.int64()),
                    *batch.columns[1:],
                ], names=schema.names)
                uid += len(texts)

    rows = docs.select(
        F.col(text).alias("text"), F.col(number).cast("long").alias("doc_id"),
        *([] if rest is None else [rest.alias("rest")]),
    )
    schema = T.StructType(_SIGNED + rows.schema.fields[2:])
    return rows.mapInArrow(batches, schema)


def _keyed(classes: DataFrame) -> DataFrame:
    """(key, rep), 64 rows a class."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                found = keys(_matrix(batch.column(1).to_pylist()))
                reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ravel()), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "signature").mapInArrow(batches, "key long, rep long")


def _matrix(signature: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signature), np.uint16).reshape(-1, SYMBOLS)


def _within(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most ``DISTANCE`` symbols."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x, y = (_matrix(batch.column(i).to_pylist()) for i in (2, 3))
            near = pa.array((x != y).sum(axis=1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in (0, 1)], names=["a", "b"])

    signed = classes.select("rep", "signature")
    x = signed.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    y = signed.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(batches, "a long, b long")


def _confirmed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, last, held = zstandard.ZstdDecompressor(), None, None
        for batch in source:
            good = []
            for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:  # rows come sorted by a from the join
                    last, held = a, shingles(open_.decompress(x))
                good.append(similar(held, shingles(open_.decompress(y)), percent))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], names=["a", "b"])

    packed = classes.select("rep", "packed")
    x = packed.select(F.col("rep").alias("a"), F.col("packed").alias("x"))
    y = packed.select(F.col("rep").alias("b"), F.col("packed").alias("y"))
    # texts are joined only where a pair wants them
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return both.mapInArrow(batches, "a long, b long")


def first_key(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The symbol left out of the first key that a signature shares with each of others."""
    differ = others != one
    errors = np.add.reduceat(differ, _EDGES[:-1], axis=1, dtype=np.int8)
    chunk = (errors <= 1).argmax(axis=1)
    place = np.minimum(_EDGES[chunk][:, None] + np.arange(5), _EDGES[chunk + 1][:, None] - 1)
    return _EDGES[chunk] + np.take_along_axis(differ, place, axis=1).argmax(axis=1)


def _candidates(frame: pd.DataFrame, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distances) within ``DISTANCE`` for the members of each key (or of two of its
    blocks) of different components; with ``once``, only where it's the first key of both.
    Rows are ordered by key; each is compared with the next one, the one after that and so on."""
    key, comps, block = (frame[c].to_numpy() for c in ("key", "component", "block"))
    signed, n = _matrix(frame["signature"].tolist()), len(frame)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    two = np.minimum.reduceat(block, starts) != np.maximum.reduceat(block, starts)
    two = np.repeat(two, np.diff(np.append(starts, n)))
    left, step = np.arange(n), 0
    while True:
        step += 1
        left = left[left < n - step]
        left = left[key[left + step] == key[left]]
        if not len(left):
            return
        i = left[comps[left] != comps[left + step]]
        i = i[~two[i] | (block[i] != block[i + step])]
        for at in range(0, len(i), 1 << 15):
            x, y = i[at : at + (1 << 15)], i[at : at + (1 << 15)] + step
            distance = (signed[x] != signed[y]).sum(axis=1)
            near = distance <= DISTANCE
            x, y, distance = x[near], y[near], distance[near]
            if once and len(x):
                here = first_key(signed[x], signed[y]) == key[x] & 63
                x, y, distance = x[here], y[here], distance[here]
            if len(x):
                yield x, y, distance


def _dealt(members: DataFrame) -> DataFrame:
    """Members (key, rep, component) of keys with several components, in groups for one task
    each; a key with many members is split into blocks, every two of which meet."""
    several = members.groupBy("key").agg(
        F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n"))
    several = stored(several.where("c <> d").select("key", "n", F.ceil(F.col("n") / BLOCK).alias("blocks")), "several")
    small = several.where("blocks = 1").agg(F.sum("n").alias("n")).first().n or 0
    dealt = members.join(several.select("key", "blocks"), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # Small keys share a group, of about a block's size; two blocks of a large one are a group of their own.
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(small // BLOCK + 1))).otherwise(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return dealt.select(group.alias("group"), "key", "block", "rep", "component")


def _nearest(frame: pd.DataFrame) -> pd.DataFrame:
    """For each member with a candidate its nearest one."""
    frame = frame.sort_values("key")
    reps, place = np.unique(frame["rep"].to_numpy(), return_inverse=True)
    none = (DISTANCE + 1) * len(reps)
    best = np.full(len(reps), none)
    for i, j, distance in _candidates(frame, once=False):
        np.minimum.at(best, place[i], distance * len(reps) + place[j])
        np.minimum.at(best, place[j], distance * len(reps) + place[i])
    some = np.flatnonzero(best < none)
    distance, near = np.divmod(best[some], len(reps))
    return pd.DataFrame({"rep": reps[some], "near": reps[near], "distance": distance})


def _wanted(frame: pd.DataFrame) -> pd.DataFrame:
    """The members that have a candidate for which this is the first key."""
    frame = frame.sort_values("key")
    some = np.zeros(len(frame), bool)
    for i, j, _ in _candidates(frame, once=True):
        some[i] = some[j] = True
    return frame.loc[some, ["group", "key", "block", "rep", "component"]]


def _tested(percent: int):
    def test(frame: pd.DataFrame) -> pd.DataFrame:
        """Links between components, nearest candidates first; what a link has joined in this
        group isn't compared again."""
        open_, links, sets, top = zstandard.ZstdDecompressor(), [], {}, {}

        def root(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c]
            return c

        def full(i: int) -> np.ndarray:
            if reps[i] not in sets:
                sets[reps[i]] = shingles(open_.decompress(packed[i]))
            return sets[reps[i]]

        frame = frame.sort_values("key")
        reps, comps, packed = (frame[c].tolist() for c in ("rep", "component", "packed"))
        found = list(_candidates(frame, once=True))
        if found:
            first, second, distance = map(np.concatenate, zip(*found))
            order = np.lexsort((second, first, distance))
            for i, j in zip(first[order].tolist(), second[order].tolist()):
                x, y = root(comps[i]), root(comps[j])
                if x != y and similar(full(i), full(j), percent):
                    top[max(x, y)] = min(x, y)
                    links.append((reps[i], reps[j]))
        return pd.DataFrame(links, columns=["a", "b"])

    return test


def _with_component(reps: DataFrame, joined: DataFrame) -> DataFrame:
    out = reps.join(joined, F.col("rep") == F.col("node"), "left")
    return out.withColumn("component", F.coalesce("component", "rep")).drop("node")


def _edges(joined: DataFrame) -> DataFrame:
    """Components as links again, fewer than those they were made of."""
    return joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_documents(
    docs: DataFrame, number: str = "doc_id", text: str = "text", percent: int = 75
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id and kept.

    ``percent`` is the least similarity (intersection over union) of a link.  The signature's
    distance is set for 75; lower ones would lose pairs and are refused.
    """
    rows = stored(_signed(docs, number, text), "signed", compression="snappy")
    return _members(rows, percent).drop("uid", "first")


def without_near_copies(
    docs: DataFrame, number: str = "doc_id", text: str = "text", percent: int = 75
) -> DataFrame:
    """One row of ``docs`` for each component: that with the least number."""
    others = [c for c in docs.columns if c != text]
    rest = F.struct(*(F.col(c) for c in others)) if others else None
    rows = stored(_signed(docs, number, text, rest), "signed", compression="snappy")
    first = _members(rows, percent).where("first").select("uid")

    def opened(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in source:
            texts = [None if x is None else open_.decompress(x).decode() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=names)

    left = rows.join(first, "uid", "left_semi").select(
        "packed", *(F.col("rest").getField(c).alias(c) for c in others))
    names = [text, *others]
    schema = T.StructType([T.StructField(text, T.StringType())] + [docs.schema[c] for c in others])
    return left.mapInArrow(opened, schema).select(*docs.columns)


def _members(rows: DataFrame, percent: int) -> DataFrame:
    if not 75 <= percent <= 100:
        raise ValueError("the signature distance is for similarities of 75 % and more")
    same = ["s1", "s2", "n_shingles"]
    classes = rows.where("n_shingles > 0").groupBy(*same).agg(F.min("uid").alias("rep"))
    classes = stored(classes, "classes")
    signed = rows.join(classes.select("rep"), F.col("uid") == F.col("rep"), "left_semi").select(
        F.col("uid").alias("rep"), "signature", "packed")
    keyed = _keyed(signed)
    shared = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(shared.drop("n"), "key"), "shared")

    pairs = shared.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(_confirmed(stored(_within(pairs, signed), "pairs"), signed, percent), "confirmed")
    joined = stored(components(links), "components")

    # Keys that still hold several components: each class with its nearest of another first,
    signature = signed.select("rep", "signature")
    dealt = _dealt(_with_component(shared.select("key", "rep"), joined)).join(signature, "rep")
    nearest = dealt.groupBy("group").applyInPandas(_nearest, "rep long, near long, distance int")
    nearest = nearest.groupBy("rep").agg(F.min(F.struct("distance", "near")).alias("x"))
    nearest = nearest.select(F.least("rep", "x.near").alias("a"), F.greatest("rep", "x.near").alias("b")).distinct()
    links = stored(_confirmed(stored(nearest, "nearest"), signed, percent), "confirmed")
    joined = stored(components(_edges(joined).unionByName(links)), "components")
    # then every candidate that no link joins yet.
    dealt = _dealt(_with_component(shared.select("key", "rep"), joined)).join(signature, "rep")
    dealt_schema = "group long, key long, block long, rep long, component long"
    wanted = stored(dealt.groupBy("group").applyInPandas(_wanted, dealt_schema), "wanted")
    full = wanted.join(signed, "rep").groupBy("group").applyInPandas(_tested(percent), "a long, b long")
    links = stored(full, "confirmed")
    joined = components(_edges(joined).unionByName(links))

    member = rows.select("uid", "doc_id", *same).join(classes, same, "left")
    member = stored(
        _with_component(member, joined).select(
            "uid", "doc_id", "n_shingles", F.coalesce("component", "uid").alias("c")),
        "members",
    )
    smallest = member.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(
        F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"))
    return member.join(smallest, "c").select(
        "uid", "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        (F.col("uid") == F.col("first.uid")).alias("first"),
    )
