"""Removing long strings that stand anywhere else, by bucket-pointer refinement.

Every 200-byte window of a text has an anchor, the least hash among its 48-byte strings.  Equal
windows have equal anchors at equal places, so windows need comparing only within an anchor,
and windows in a row that share an anchor are one region of text.

Regions with an anchor found nowhere else are done.  Regions equal to another one in full are
repeated in full.  The others, at the edges of what is repeated, are dealt to tasks by their
anchor; in a task all their suffixes are sorted to a depth of 200 bytes: initial 8-byte buckets
are refined by sorting on the bucket pointers of later offsets, and the pointers so updated are
what the next refinement reads, which doubles the depth.  Windows left in one bucket are equal.
An anchor with very many different regions is split over tasks, which then also compare the
hashes of windows they found no partner for.

Texts are UTF-8 bytes, null as empty; matches never cross documents.  Texts shorter than a window
keep everything.  Equal texts, repeated rows included, are removed wholly, each of them, as all
their windows stand elsewhere.  Ids play no part.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accessloom.llm.common import kept_columns, stored, utf8

WINDOW, GRAM = 200, 48
#: Bytes worked on at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 18
#: Regions sorted in one task.
REGIONS = 4096
_RANDOM = np.random.default_rng(7)
_LETTERS = _RANDOM.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PLACE_BITS = np.uint64(24)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 2**64))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the second base and of its inverse."""
    inverse = pow(_BASE[1], -1, 2**64)
    out = []
    for base in (_BASE[1], inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each string of ``gram`` bytes, from those of half its length."""
    parts = {1: _LETTERS[0][data]}
    size = 1
    while size * 2 <= gram:
        h = parts[size]
        parts[size * 2] = h[:-size] * _power(_BASE[0], size) + h[size:]
        size *= 2
    total, at = parts[size], size
    while at < gram:
        size = max(s for s in parts if s <= gram - at)
        n = len(data) - at - size + 1
        total = total[:n] * _power(_BASE[0], size) + parts[size][at : at + n]
        at += size
    return _mixed(total)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def regions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW):
    """Of texts end to end in ``data``: (text, anchor, whole, first, last) per region, where
    ``whole`` is a hash of all its bytes, and first and last are its window starts."""
    n = len(data) - window + 1
    hashes = gram_hashes(data)
    places = np.arange(len(hashes), dtype=np.uint64)
    ranked = (hashes & ~np.uint64((1 << 24) - 1)) | places
    at = (sliding_least(ranked, window - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    some = ends - starts >= window
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, ends[some] - window + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    new[starts[some]] = True
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, empty
    text = np.searchsorted(starts, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], n), ends[text] - window + 1)
    last = stop - 1
    power, inverse = _powers(_room())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[1][data] * power[: len(data)], out=sums[1:])
    whole = (sums[last + window] - sums[first]) * inverse[first]
    shape = ((at[first] - first) << 32 | (last - first)).astype(np.uint64)
    whole = _mixed(whole ^ _mixed(shape + np.uint64(_BASE[0])))
    return (text, hashes[at[first]].view(np.int64), whole.view(np.int64),
            first - starts[text], last - starts[text])


def _room() -> int:
    return 2 * PIECE + 2 * WINDOW


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, or overlapping pieces of long ones, some at a time: data, starts, ends, and
    which text and offset each piece is."""
    held, size = [], 0

    def out():
        lengths = np.array([len(x) for x, _, _ in held])
        ends = np.cumsum(lengths)
        return (np.frombuffer(b"".join(x for x, _, _ in held), np.uint8), ends - lengths, ends,
                np.array([i for _, i, _ in held]), np.array([o for _, _, o in held]))

    for i, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, PIECE):
            piece = text[at : at + PIECE + WINDOW - 1]
            held.append((piece, i, at))
            size += len(piece)
            if size >= PIECE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


_REGION_NAMES = ["anchor", "whole", "h", "first", "last"]


def _regions(docs: DataFrame, only_anchors: bool) -> DataFrame:
    """The regions of (h, text): anchor, and unless ``only_anchors`` whole, h, first and last."""
    names = _REGION_NAMES[:1] if only_anchors else _REGION_NAMES

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            for data, starts, ends, which, offset in _pieces(texts):
                text, anchor, whole, first, last = regions(data, starts, ends)
                columns = [anchor]
                if not only_anchors:
                    columns += [whole, keys[which[text]], first + offset[text], last + offset[text]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(batches, ", ".join(f"{n} long" for n in names))


def _packed(docs: DataFrame) -> DataFrame:
    """(h, packed, ...) from (h, text, ...): texts travel compressed."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in source:
            texts = pa.array([press.compress(t) for t in utf8(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), texts, *batch.columns[2:]], names=schema.names)

    fields = docs.schema.fields
    schema = T.StructType([fields[0], T.StructField("packed", T.BinaryType()), *fields[2:]])
    return docs.mapInArrow(batches, schema)


# ---------------------------------------------------------------- one task's regions

def equal_windows(texts: list[bytes], window: int = WINDOW, gram: int = 8) -> list[np.ndarray]:
    """For each text a number for each of its windows; windows are equal where numbers are.

    Bucket-pointer refinement: ``pointer[i]`` names the bucket of the suffix at i, the place
    where the bucket ends in the sorted order.  Buckets of one suffix need no more sorting.
    """
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts) + bytes(gram), np.uint8)
    n = len(data) - gram
    stop = np.repeat(ends, lengths)  # where each suffix's text ends
    first = np.zeros(n, np.uint64)
    for k in range(gram):
        first = first << np.uint64(8) | data[k : k + n]
    everywhere = np.arange(n)
    pointer = np.full(n, -1, np.int64)
    active = everywhere[everywhere + gram <= stop]
    pointer[active], active = _buckets(first[active], active, 0)
    depth = gram
    while depth < window:
        step = min(depth, window - depth)
        active = active[active + depth + step <= stop[active]]
        key = pointer[active].astype(np.uint64) * np.uint64(n + 1) + pointer[active + step].astype(np.uint64)
        refined, left = _buckets(key, active, pointer[active])
        pointer[active] = refined
        active, depth = left, depth + step
    return [pointer[e - size : e - window + 1] for e, size in zip(ends, lengths)]


def _buckets(key: np.ndarray, suffixes: np.ndarray, old) -> tuple[np.ndarray, np.ndarray]:
    """The pointers after sorting by ``key``, and the suffixes not alone in their bucket."""
    if not len(key):
        return np.empty(0, np.int64), suffixes
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(ranked)))
    bucket = np.cumsum(new) - 1
    if np.ndim(old):
        # within an old bucket that ends at p, a new one ends as far before p as what follows it
        before = old[order]
        last_of_old = np.append(before[1:] != before[:-1], True)
        ends_old = np.flatnonzero(last_of_old)
        end_rank = ends_old[np.searchsorted(ends_old, np.arange(len(ranked)))]
        pointers = before - (end_rank - (start + size - 1)[bucket])
    else:
        pointers = (start + size - 1)[bucket]
    out = np.empty(len(key), np.int64)
    out[order] = pointers
    return out, suffixes[order[(size > 1)[bucket]]]


_RESOLVED = "kind int, h long, s long, e long, w1 long, w2 long"


def _resolve(frame: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: repeated bytes s..e of text h.  For split anchors, kind 1: the hash of a window
    without partner here, and kind 2: the hash of one that has."""
    frame = frame.drop_duplicates(["h", "first", "last"]).sort_values(["h", "first"])
    texts = frame["bytes"].tolist()
    numbers = equal_windows(texts)
    every = np.concatenate(numbers)
    # a region that stands for several equal ones counts as found elsewhere
    many = np.repeat(frame["n"].to_numpy() > 1, [len(x) for x in numbers])
    values, place, count = np.unique(every, return_inverse=True, return_counts=True)
    held = np.zeros(len(values), bool)
    held[place[many]] = True
    repeated = (count > 1) | held
    out, at = [], 0
    for i, (h, first, n, split) in enumerate(zip(frame["h"], frame["first"], frame["n"], frame["split"])):
        size = len(numbers[i])
        own = repeated[place[at : at + size]]
        if n == 1:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            out += [(0, h, first + a, first + b - 1 + WINDOW, 0, 0) for a, b in zip(edge[::2], edge[1::2])]
        if split:
            for k in range(size):
                w1, w2 = np.frombuffer(xxhash.xxh3_128_digest(texts[i][k : k + WINDOW]), "<i8")
                if n > 1 or own[k]:
                    out.append((2, 0, 0, 0, w1, w2))
                else:
                    out.append((1, h, first + k, first + k + WINDOW, w1, w2))
        at += size
    return pd.DataFrame(out, columns=["kind", "h", "s", "e", "w1", "w2"])


# ---------------------------------------------------------------- all texts

def repeated_spans(texts: DataFrame) -> DataFrame:
    """(h, s, e): bytes s..e of the texts with hash h are covered by windows that also start
    elsewhere; texts has (h, text), a row for each document."""
    anchors = _regions(texts, only_anchors=True).groupBy("anchor").count()
    anchors = stored(anchors.where("count > 1").select("anchor"), "anchors")
    found = stored(_regions(texts, only_anchors=False).join(anchors, "anchor"), "regions")
    classes = found.groupBy("anchor", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("h", "first", "last")).alias("one"))
    classes = stored(classes, "classes")
    same = found.join(classes.where("n > 1").select("anchor", "whole"), ["anchor", "whole"])
    spans = same.select("h", F.col("first").alias("s"), (F.col("last") + WINDOW).alias("e"))

    kinds = classes.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.max((F.col("n") == 1).cast("int")).alias("single"))
    open_ = classes.join(kinds.where("kinds > 1 AND single = 1"), "anchor")
    open_ = stored(open_.select("anchor", "n", "one.*", "kinds"), "open")
    tasks = max(1, -(-open_.count() // REGIONS))
    split = F.col("kinds") > REGIONS
    task = F.when(split, F.xxhash64("anchor", F.pmod(
        F.xxhash64("h", "first"), F.ceil(F.col("kinds") / REGIONS)))).otherwise(
        F.pmod(F.xxhash64("anchor"), F.lit(tasks)))
    wanted = open_.select("h", F.struct(task.alias("task"), split.alias("split"), "n", "first", "last").alias("r"))
    # a text has no more regions than bytes
    wanted = wanted.groupBy("h").agg(F.collect_list("r").alias("wanted"))
    one_each = _packed(texts).dropDuplicates(["h"])

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor()
        for batch in source:
            rows = []
            for h, packed, regions_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = open_text.decompress(packed)
                rows += [{**r, "h": h, "bytes": text[r["first"] : r["last"] + WINDOW]} for r in regions_]
            yield pa.RecordBatch.from_pylist(rows, arrow_cut)

    arrow_cut = pa.schema([
        ("task", pa.int64()), ("split", pa.bool_()), ("n", pa.int64()), ("first", pa.int64()),
        ("last", pa.int64()), ("h", pa.int64()), ("bytes", pa.binary())])
    cut_schema = "task long, split boolean, n long, first long, last long, h long, bytes binary"
    pieces = one_each.join(wanted, "h").select("h", "packed", "wanted").mapInArrow(cut, cut_schema)
    resolved = stored(pieces.groupBy("task").applyInPandas(_resolve, _RESOLVED), "resolved")
    spans = spans.unionByName(resolved.where("kind = 0").select("h", "s", "e"))
    hashed = resolved.where("kind > 0")
    twice = hashed.groupBy("w1", "w2").count().where("count > 1").drop("count")
    partners = hashed.where("kind = 1").join(twice, ["w1", "w2"]).select("h", "s", "e")
    return spans.unionByName(partners)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans that don't touch, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


MADE = ("n_bytes", "n_removed", "n_spans")


def without_repeats(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed and n_spans, and with ``digest`` kept_sha256 instead of
    the text, else the text that is left.  A character that has lost some of its bytes goes
    wholly from that text, as it is no longer UTF-8; the digest is of all bytes left.
    """
    made = (*MADE, "kept_sha256") if digest else MADE
    others = [c for c in kept_columns(docs, made) if c != text]
    keyed = docs.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    spans = repeated_spans(keyed).groupBy("h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    full = docs.select(
        F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"), F.col(text).isNotNull().alias("given"),
        F.struct(*(F.col(c) for c in others)).alias("rest") if others else F.lit(None).alias("rest"),
    )
    joined = _packed(full).join(spans, "h", "left").select(
        "packed", "given", "spans", *(F.col("rest").getField(c).alias(c) for c in others))

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor()
        for batch in source:
            sizes, removed, runs, left = [], [], [], []
            for packed, given, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                whole, out = open_text.decompress(packed), merged(found)
                at, kept = 0, []
                for s, e in out:
                    kept.append(whole[at:s])
                    at = e
                rest = b"".join([*kept, whole[at:]])
                sizes.append(len(whole))
                removed.append(len(whole) - len(rest))
                runs.append(len(out))
                if digest:
                    left.append(hashlib.sha256(rest).hexdigest())
                else:
                    left.append(rest.decode(errors="ignore") if given else None)
            figures = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[3:], *figures, pa.array(left, pa.string())], names=schema.names)

    schema = T.StructType(
        [docs.schema[c] for c in others] + [T.StructField(n, T.LongType()) for n in MADE]
        + [T.StructField("kept_sha256" if digest else text, T.StringType())])
    return joined.mapInArrow(cut, schema)
