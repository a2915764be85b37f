"""Packing token sequences into as few fixed-size sequences as possible.

Pieces are dealt to shards by a hash of their key.  In a shard, best fit in order of falling
length makes the first bins; then local search works between underfull bins: a piece of the
emptiest bin moves, or pieces are exchanged one for one or two for one (either way), so that
the fuller bin gains.  Each step raises the sum of squared fills, and bins run empty.  It ends
when the number of bins equals the lower bound or ``DONORS`` bins in turn couldn't be emptied.  Bins that are still
underfull go on to another round with the bins left over in other shards, until one shard
is left or a round shrinks them by less than 10 %; that round's underfull bins stay.

Null texts are documents of the end id alone; each document has at least that id, so none
vanishes.  Repeated rows and null or repeated ids are documents of their own.  An empty table
gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessloom.llm.common import stored
from accessloom.llm.token_files import ids_crc32
from accessloom.llm.tokens import REMEMBERED, encoder

#: Pieces in a shard; bounds the memory and time of a task.
SHARD_PIECES = 4096
#: A bin this full is final before the last round.
FULL_ENOUGH = 0.995
#: The emptiest bins that local search tries to empty before it gives up.
DONORS = 12


# ---------------------------------------------------------------- one shard

def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room - length:
            insort(rooms, (room - length, b))
    return bins


def _best_exchange(giver: np.ndarray, taker: np.ndarray, room: int):
    """(gain, pieces that the giver gives, pieces it gets back) with the largest gain that
    is over 0 and fits the taker's room; lengths stand for pieces."""
    best = (0, (), ())
    give, back = np.unique(giver), np.unique(taker)

    def better(gains: np.ndarray):
        allowed = np.where(gains <= room, gains, 0)
        at = int(allowed.argmax()) if allowed.size else 0
        return (int(allowed.flat[at]), np.unravel_index(at, gains.shape)) if allowed.size else (0, None)

    gain, at = better(give)
    if gain > best[0]:
        best = gain, (give[at[0]],), ()
    gain, at = better(give[:, None] - back[None, :])
    if gain > best[0]:
        best = gain, (give[at[0]],), (back[at[1]],)
    if best[0] < room and len(giver) > 1:
        i, j = np.triu_indices(len(giver), 1)
        two = np.unique(np.stack([giver[i], giver[j]]), axis=1)
        gain, at = better(two.sum(axis=0)[:, None] - back[None, :])
        if gain > best[0]:
            best = gain, tuple(two[:, at[0]]), (back[at[1]],)
    if best[0] < room and len(taker) > 1:
        i, j = np.triu_indices(len(taker), 1)
        two = np.unique(np.stack([taker[i], taker[j]]), axis=1)
        gain, at = better(give[:, None] - two.sum(axis=0)[None, :])
        if gain > best[0]:
            best = gain, (give[at[0]],), tuple(two[:, at[1]])
    return best


def _move(source: list[int], target: list[int], lengths: np.ndarray, wanted: tuple) -> None:
    for length in wanted:
        i = next(i for i in source if lengths[i] == length)
        source.remove(i)
        target.append(i)


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange pieces between underfull bins until as many as possible are empty."""
    lower = -(-int(lengths.sum()) // capacity)
    fills = {b: int(lengths[x].sum()) for b, x in enumerate(bins)}
    tried: set[int] = set()
    while len(fills) > max(lower, 1) and len(tried) < DONORS:
        giver = min((b for b in fills if b not in tried), key=fills.get, default=None)
        if giver is None:
            break
        moved = True
        while moved and bins[giver]:
            moved = False
            for taker in sorted(fills, key=fills.get, reverse=True):
                if taker == giver or fills[taker] == capacity or fills[taker] < fills[giver]:
                    continue
                gain, given, got = _best_exchange(
                    lengths[bins[giver]], lengths[bins[taker]], capacity - fills[taker]
                )
                if not gain:
                    continue
                back: list[int] = []
                _move(bins[taker], back, lengths, got)
                _move(bins[giver], bins[taker], lengths, given)
                bins[giver] += back
                fills[taker] += gain
                fills[giver] -= gain
                moved = True
                if not bins[giver]:
                    break
        if bins[giver]:
            tried.add(giver)
        else:
            del fills[giver]
            tried.clear()
    return [bins[b] for b in fills]


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the lengths, by bin."""
    if not len(lengths):
        return []
    if int(lengths.max()) > capacity:
        raise ValueError("a piece is longer than a sequence")
    return local_search(best_fit(lengths, capacity), lengths, capacity)


# ---------------------------------------------------------------- all shards

_PLACED = "uid long, sequence_id long, offset long, last boolean"


def _shard(capacity: int, final: bool):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid")
        uids, lengths = frame["uid"].to_numpy(), frame["length"].to_numpy()
        rows = []
        for chosen in pack_lengths(lengths, capacity):
            size = lengths[chosen]
            ends = np.cumsum(size)
            rows.append(pd.DataFrame({
                "uid": uids[chosen], "sequence_id": uids[chosen].min() * 2 + 1,
                "offset": ends - size, "last": final or ends[-1] >= FULL_ENOUGH * capacity,
            }))
        return pd.concat(rows)

    return pack


def place(pieces: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, length); the uids differ.

    Each round's result is a written table.  Only numbers travel, no token ids.
    """
    spark = pieces.sparkSession
    whole = pieces.where(F.col("length") == capacity)
    # Sequence numbers: 2 * uid for a piece that fills a sequence, odd for the others.
    out = whole.select("uid", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_, number = pieces.where(F.col("length") < capacity).select("uid", "length"), 0
    before = None
    while True:
        n = open_.count()
        if not n:
            return out
        shards = -(-n // shard_pieces)
        final = shards == 1 or (before is not None and n > 0.9 * before)

        shard = F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards))
        placed = stored(
            open_.withColumn("shard", shard).groupBy("shard").applyInPandas(
                _shard(capacity, final), _PLACED),
            "placed",
        )
        out = out.unionByName(placed.where("last").drop("last"))
        if final:
            return out
        open_ = open_.join(placed.where("NOT last").select("uid"), "uid")
        number, before = number + 1, n


def token_pieces(
    docs: DataFrame, capacity: int = 4096, number: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = 1, digest: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Each document's ids and ``end_id``, cut after every ``capacity`` ids: uid, doc_id,
    piece, start, length and ``ids`` (little endian, ``id_bytes`` each), or with ``digest``
    ``ids_crc32`` of them instead.  A worker remembers so many words at most."""
    names = [f.split(" ")[0] for f in (_DIGESTS if digest else _PIECES).split(", ")]
    kinds = _PIECE_TYPES[:5] + ([pa.int64()] if digest else _PIECE_TYPES[5:])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, remembered)
        width = coder.dtype.itemsize
        uid = TaskContext.get().partitionId() << 40
        for batch in source:
            parts, counts = [], []
            for ids in coder.encode(batch.column(1), end_id):
                cut = range(0, len(ids), capacity * width)
                counts.append(len(cut))
                parts += [ids] if len(cut) == 1 else [ids[at : at + capacity * width] for at in cut]
            counts = np.array(counts, np.int64)
            piece = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // width
            columns = [
                pa.array(uid + np.arange(len(parts))),
                batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), counts))),
                pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(lengths),
            ]
            uid += len(parts)
            if digest:
                columns.append(pa.array([ids_crc32(x, width) for x in parts], pa.int64()))
            else:
                columns += [pa.array(np.full(len(parts), width, np.int32)), pa.array(parts, pa.binary())]
            if parts:
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], names=names)

    rows = docs.select(F.col(number).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, _DIGESTS if digest else _PIECES)


_PIECES = "uid long, doc_id long, piece int, start long, length long, id_bytes int, ids binary"
_DIGESTS = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def pack_documents(
    docs: DataFrame, capacity: int = 4096, number: str = "doc_id", text: str = "text",
    tokenizer: str | None = None, end_id: int = 1, shard_pieces: int = SHARD_PIECES, digest: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """The pieces of all documents with their ids, ``sequence_id`` and ``offset``.

    Texts are encoded once; the pieces are a written table, and only their numbers and
    lengths go through the packing rounds.  With ``digest`` the ids stay where they are made
    and only their checksum is handed on.
    """
    pieces = stored(token_pieces(docs, capacity, number, text, tokenizer, end_id, digest, remembered), "pieces")
    placed = place(pieces.select("uid", "length"), capacity, shard_pieces)
    return pieces.join(placed, "uid").drop("uid")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """A row per sequence: its ids end to end, and for each piece doc_id, piece and offset."""
    piece = F.struct("offset", "doc_id", "piece", "length", "ids")
    parts = F.array_sort(F.collect_list(piece))
    return (
        packed.groupBy("sequence_id", "id_bytes").agg(parts.alias("parts"))
        .select(
            "sequence_id", "id_bytes",
            F.transform("parts", lambda p: p.dropFields("ids")).alias("pieces"),
            F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        )
    )
