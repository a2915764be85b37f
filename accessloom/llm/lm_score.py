"""Scoring texts by online logistic mixing of bit predictors.

The model predicts the bits of each word's bytes and of the blank after it, or of the end mark.
The first ``CROSSING`` bytes of a word are predicted by the last 1, 2, 3 and 5 bytes of the text,
words before and the blanks between them included, so a text's score depends on the order of its
words.  One of these is the word so far.  From there on five bytes no longer reach over the blank,
and predictors look at the last 1, 2, 3 and 5 bytes of the word and at the word so far.  Each says
how often a 0 or 1 bit followed.  Both kinds of bytes have weights of their own.
Every context holds the class of the document too: a mixture of ``CLASSES`` word distributions over
the commonest words of all texts is fitted on all training texts, each round in Spark tasks, and a
text's score is that of its likeliest class, with the probability of the class itself counted in.
Their logits are mixed by weights that a gate selects (how much the two longest contexts have
seen), learned online over all training words, and the mix is refined by a table of what came
true at that gate and mixed probability.  When a training word is learned from, its own
occurrence is taken out of the counts, as a new text would not be in them.  Learning is per part:
weights go on through all edges of a part, and each round starts from their average.  Parts are
dealt by hash and their number depends on the words alone, so scores are the same however rows lie
and however many cores there are, but for the last digits of sums.

Texts are cut into words once, and the cuts are a Spark table that all later passes read.
All training texts are counted, and all counts are exact: words are added up by their hash in tasks and
compared with each other, and travel in bundles, a row for each part they are dealt to.  What is predicted is an edge: a word so
far in a class, and the byte that follows.  The distinct edges of all words are a Spark table.
They meet by their last three bytes, so a part has all that counts for its longer contexts; common
endings are split, and their parts given the sums.  Only the contexts of up to two bytes, which the
alphabet bounds, are sent to every task.  Edges' scores
go back to the words' batches and are added up.  Edges that reach over a blank are counted from the
texts themselves and are a table of their own, dealt and learned from in the same way.  Texts get the
scores of their words and of the edges between them from lists of the commonest ones, and by a join for
all others.  Edges within words meet by a 64-bit hash of the word so far, those between words by the
context itself, and the join goes by a hash of class and word, or by context and byte.

Null texts are empty: one end token.  A null id counts as the text '' for the held-out rule.
Repeated rows are learned from and scored each.  Without training texts every bit has
probability one half and base scores are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessloom.llm.common import stored

END = b"\n"  # no word holds it
ORDERS = (1, 2, 3, 5)
#: A context is a class and the last five bytes, as digits of which 0 is none.
DIGIT, SPAN = 257, 257**5
#: The commonest words of classes, whose scores workers keep; all others are joined.  Longer words don't tell
#: classes apart.
COMMON, COMMON_BYTES = 600_000, 256
#: Bytes of a word whose last five bytes reach over the blank before it; their edges: the commonest ones
#: that workers keep, those in a part, those counted before they are handed on.
CROSSING, COMMON_CROSSINGS, CROSSING_PART, CROSSINGS_HELD = 4, 500_000, 200_000, 1 << 21
BLANK = 33  # the digit of a blank
#: Edges held in a task before they are bundled by their endings; words and their bytes counted before they are
#: handed on; bytes hashed and texts of a step of expectation at a time.
EDGES_HELD, WORDS_HELD, LETTERS_HELD, HASHED, TEXTS = 1 << 20, 1 << 20, 1 << 26, 1 << 18, 1 << 10
#: Bytes of text cut into words at a time; a longer text is cut by itself.
CUT = 1 << 23
#: Words and bytes in a batch; edges counted at once; bytes of words whose edges are a part; edges
#: of one ending or context that are dealt to more parts; edges learned from at once.
BATCH_WORDS, BATCH_BYTES, CHUNK, PART, HOT, STEP = 4000, 1 << 18, 50_000, 600_000, 100_000, 2048
PRIOR = 0.05
#: Classes, and words in a block of sums.  The commonest words of all texts tell classes apart: at
#: least and at most so many, in between one for so many texts.
CLASSES, WORD_BLOCK, CLASS_WORDS, MOST_CLASS_WORDS, TEXTS_A_WORD = 6, 1 << 10, 2000, 1 << 16, 16
#: Rounds of all starts, most rounds of the likeliest one, and the least gain of a round.
STARTS, TRIALS, ROUNDS, GAIN = 2, 3, 15, 1e-3
RATE, LESSONS, SUMS = 0.1, 2, 32
GATES, INPUTS, BUCKETS = 32, len(ORDERS) + 2, 33
_LETTERS = np.random.default_rng(3).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the words (large binary) ends, from 0, and their bytes."""
    ends = np.frombuffer(words.buffers()[1], "<i8")[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    size = int(ends[-1] - ends[0]) if len(words) else 0
    return ends - ends[:1], np.frombuffer(data, np.uint8, size, int(ends[0])) if size else np.empty(0, np.uint8)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, none of them empty."""
    ends, data = _letters(words)
    out, a = np.empty(len(words), np.uint64), 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + HASHED, "right")) - 1)
        starts, lengths = ends[a:b] - ends[a], np.diff(ends[a : b + 1])
        power, _ = _powers(1 << max(int(lengths.max()).bit_length(), 18))
        place = np.arange(ends[b] - ends[a]) - np.repeat(starts, lengths)
        sums = np.add.reduceat(_LETTERS[data[ends[a] : ends[b]]] * power[place], starts)
        out[a:b] = _mixed(sums + lengths.astype(np.uint64))
        a = b
    return out


def pair_hashes(k: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each class and word."""
    return _mixed(hashes + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)).view(np.int64)


# ---------------------------------------------------------------- contexts

@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def shorter(context: np.ndarray, k: int) -> np.ndarray:
    """The context of the last ``k`` bytes."""
    return context // SPAN * SPAN + context % DIGIT**k


def counts_of(key: np.ndarray, byte: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each edge's eight bits how often 0 and 1 followed the key and the bits before."""
    order = np.lexsort((byte, key))
    key, byte = key[order], byte[order].astype(np.int16)
    differs = np.where(key[1:] != key[:-1], 256, byte[1:] ^ byte[:-1])
    new = np.append(True, differs > 0)[: len(key)]
    first = np.flatnonzero(new)  # from here on an edge is a distinct key and byte
    byte, differs = byte[first], differs[first[1:] - 1]
    sums = np.append(0, np.cumsum(n[order].astype(np.int64)))[np.append(first, len(order))]
    found = np.empty((8, 2, len(first)), np.float32)
    every = None
    for s in range(9):  # edges of one key that share s bits are neighbours
        bounds = np.concatenate([[0], np.flatnonzero(differs >= 1 << (8 - s)) + 1, [len(first)]])
        same = np.repeat(np.diff(sums[bounds]), np.diff(bounds))
        if s:
            one, other = byte >> (8 - s) & 1 == 1, every - same
            found[s - 1, 0], found[s - 1, 1] = np.where(one, other, same), np.where(one, same, other)
        every = same
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return np.ascontiguousarray(found.reshape(16, -1).T).reshape(-1, 8, 2)[at]


class Bits:
    """The bits of words, or of edges: bytes that follow a context, with the counts of the
    contexts of three and five bytes and of the word so far (none for words)."""

    def __init__(self, words: list[bytes], classes: np.ndarray):
        marked = [w if w == END else w + b" " for w in words]
        lengths = np.array([len(w) for w in marked], np.int64)
        self.starts = starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self._set(np.frombuffer(b"".join(marked), np.uint8), None, None)
        place = np.arange(self.n) - np.repeat(starts, lengths)
        classes = np.repeat(np.asarray(classes, np.int64), lengths)
        self.context = classes * SPAN
        for k in range(1, 6):
            digit = np.zeros(self.n, np.int64)
            digit[k:] = self.byte[: max(self.n - k, 0)].astype(np.int64) + 1
            digit[place < k] = 0
            self.context += digit * DIGIT ** (k - 1)
        power, inverse = _powers(1 << max(self.n.bit_length(), 18))
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_LETTERS[self.byte] * power[: self.n], out=sums[1:])
        begin = np.repeat(starts, lengths)
        topic = _mixed(classes.astype(np.uint64) + np.uint64(99))
        self.node = _mixed((sums[:-1] - sums[begin]) * inverse[begin] + place.astype(np.uint64) + topic)

    @classmethod
    def of_edges(cls, byte: np.ndarray, context: np.ndarray, long: list[np.ndarray]) -> "Bits":
        out = cls.__new__(cls)
        out._set(byte, context, long)
        return out

    def _set(self, byte, context, long):
        self.n, self.byte, self.context, self.long = len(byte), byte, context, long
        self.bit = (byte[:, None].astype(np.int64) >> (7 - np.arange(8))) & 1

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the distinct (word so far, byte) and the number of each place's one."""
        edge = _mixed(self.node + (self.byte.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
        _, first, of = np.unique(edge, return_index=True, return_inverse=True)
        return first, of


# ---------------------------------------------------------------- the model

@dataclass
class Classes:
    """A mixture of word distributions."""

    words: dict[bytes, int]
    prior: np.ndarray  # log10
    word: np.ndarray  # word, class: log10

    def of(self, words: list[bytes]) -> int:
        found = [i for i in map(self.words.get, words) if i is not None]
        return int((self.prior + self.word[found].sum(axis=0)).argmax())

    @functools.cached_property
    def listed(self) -> pa.Array:
        return pa.array(list(self.words), pa.large_binary())

    def of_all(self, cut: "Cut") -> np.ndarray:
        """The class of each text."""
        token = _places(cut.words, self.listed)[cut.code]
        sums = [np.bincount(cut.doc, x[token], cut.n) for x in self.by_class]
        return (self.prior + np.stack(sums, axis=1)).argmax(axis=1)

    @functools.cached_property
    def by_class(self) -> np.ndarray:
        """For each class its words' logs and 0 for others, whose place is -1."""
        return np.append(self.word.T, np.zeros((CLASSES, 1)), axis=1)


@dataclass
class Model:
    """Weights and the contexts of one and two bytes, which the alphabet bounds."""

    low: np.ndarray  # context of two bytes * 256 + byte, ascending
    low_n: np.ndarray
    weights: np.ndarray
    refined: np.ndarray  # gate, bucket: probability

    def prepared(self) -> "Model":
        context, byte = self.low // 256, self.low % 256
        self.short = [counts_of(shorter(context, k), byte, self.low_n) for k in (1, 2)]
        return self

    def inputs(self, bits: Bits, own: bool = False):
        """The predictors' logits and the gate of each bit.  With ``own`` each bit's own
        occurrence is in the counts and taken out."""
        found, seen = np.empty((INPUTS, bits.n * 8), np.float32), []
        one = bits.bit.ravel() == 1
        wanted = shorter(bits.context, 2) * 256 + bits.byte
        at = np.searchsorted(self.low, wanted)
        at[at == len(self.low)] = 0
        known = self.low[at] == wanted if len(self.low) else np.zeros(bits.n, bool)
        none = np.zeros((bits.n, 8, 2), np.float32)
        short = [t[at] if len(t) else none for t in self.short]
        if not known.all():
            short = [np.where(known[:, None, None], t, 0) for t in short]
        for i, n in enumerate([*short, *(bits.long or [none] * 3)]):
            n0, n1 = n[:, :, 0].ravel(), n[:, :, 1].ravel()
            if own:
                n1 = np.maximum(n1 - one, 0)
                n0 = np.maximum(n0 - ~one, 0)
            found[i] = np.log((n1 + PRIOR) / (n0 + PRIOR))
            seen.append(n0 + n1)
        found[-1] = 0.3
        words = np.minimum(np.log2(1 + seen[-1]), 15).astype(np.int64) // 2
        longest = np.minimum(np.log2(1 + seen[-2]) / 2.5, 3).astype(np.int64)
        return found, words * 4 + longest

    def mix(self, found: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(found.shape[1], np.float32)
        weights = self.weights.astype(np.float32)
        for i in range(INPUTS):
            z += found[i] * weights[:, i][gate]
        return np.clip(z, -14, 14)

    def refine(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        at = (np.clip(z, -7.99, 7.99) + 8) * 2
        low = at.astype(np.int64)
        part = at - low
        table = self.refined.astype(np.float32).ravel()
        low += gate * BUCKETS
        tuned = table[low] * (1 - part) + table[low + 1] * part
        return (1 / (1 + np.exp(-z)) + tuned) / 2

    def scores(self, bits: Bits) -> np.ndarray:
        """log10 of each byte's probability."""
        found, gate = self.inputs(bits)
        p = self.refine(self.mix(found, gate), gate)
        right = np.where(bits.bit.ravel() == 1, p, 1 - p)
        return np.log10(np.maximum(right, 1e-9)).reshape(-1, 8).sum(axis=1)

    def edge_scores(self, context: np.ndarray, byte: np.ndarray, long: list[np.ndarray]) -> np.ndarray:
        parts = [slice(at, at + STEP) for at in range(0, len(byte), STEP)]
        return np.concatenate([self.scores(Bits.of_edges(byte[p], context[p], [t[p] for t in long])) for p in parts])

    def learn(self, bits: Bits, counts: np.ndarray, squares: np.ndarray, hits: np.ndarray, tries: np.ndarray) -> None:
        """Online over some edges; weights, squares, hits and tries go on from what they were."""
        found, gate = self.inputs(bits, own=True)
        z = self.mix(found, gate)
        one, weight = bits.bit.ravel(), np.repeat(counts.astype(float), 8)
        error = (one - 1 / (1 + np.exp(-z))) * weight
        share = np.maximum(np.bincount(gate, weight, GATES), 1)
        for i in range(INPUTS):
            slope = np.bincount(gate, error * found[i], GATES) / share
            squares[:, i] += slope * slope
            self.weights[:, i] += RATE * slope / np.sqrt(squares[:, i])
        at = np.rint((np.clip(z, -7.99, 7.99) + 8) * 2).astype(np.int64) + gate * BUCKETS
        hits += np.bincount(at, weight * one, GATES * BUCKETS).reshape(GATES, BUCKETS)
        tries += np.bincount(at, weight, GATES * BUCKETS).reshape(GATES, BUCKETS)


def _flat_table() -> np.ndarray:
    return np.tile(1 / (1 + np.exp(-(np.arange(BUCKETS) / 2 - 8))), (GATES, 1))


# ---------------------------------------------------------------- training

def _tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


class Cut(NamedTuple):
    """The tokens of some texts: the text and the word of each.  An end mark is the last word,
    and the ends of all texts are the last tokens."""

    ids: pa.Array
    held_out: pa.Array
    learn: np.ndarray
    seeds: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    words: pa.Array  # distinct

    @property
    def n(self) -> int:
        return len(self.ids)


_CUTS = ("ids array<long>, held_out array<boolean>, learn array<boolean>, seeds array<long>, "
         "tokens binary, codes binary, lengths binary, letters binary")


def _cuts(rows: DataFrame) -> DataFrame:
    """Texts cut into lower-case words, as many in a row as have ``CUT`` bytes: each text's id,
    ``held_out``, ``learn``, hash and number of words; the words' numbers; the distinct words."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = pc.fill_null(batch.column(0).cast(pa.large_string()), "")
            ends, a = np.cumsum(pc.binary_length(texts).to_numpy() + 1), 0
            while a < len(texts):
                before = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + CUT, "right")))
                lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
                coded = pc.list_flatten(lists).dictionary_encode()
                code, listed = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())
                parent, some = pc.list_parent_indices(lists).to_numpy(), pc.greater(pc.binary_length(listed), 0)
                if not pc.all(some).as_py():  # the empty word at a text's blank beginning or end
                    keep = some.to_numpy(zero_copy_only=False)
                    code, parent = (np.cumsum(keep) - 1)[code[keep[code]]], parent[keep[code]]
                    listed = listed.filter(some)
                tokens = np.bincount(parent, minlength=b - a)
                word_ends, letters = _letters(listed)
                yield pa.RecordBatch.from_arrays([
                    *(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(c).slice(a, b - a))
                      for c in (1, 2, 3, 4)),
                    *(pa.array([x], pa.binary()) for x in (
                        tokens.astype("<i4").tobytes(), code.astype("<i4").tobytes(),
                        np.diff(word_ends).astype("<i4").tobytes(), letters.tobytes()))], names=names)
                a = b

    names = [f.split(" ")[0] for f in _CUTS.split(", ")]
    held_out = F.col("held_out") if "held_out" in rows.columns else F.lit(None).cast("boolean")
    return rows.select(
        "text", F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "learn",
        F.xxhash64("doc_id", "text").alias("seed")).mapInArrow(batches, _CUTS)


def _read_cuts(source: Iterator[pa.RecordBatch]) -> Iterator[Cut]:
    for batch in source:
        for i in range(batch.num_rows):
            ids, held_out, learn, seeds = (batch.column(c)[i].values for c in range(4))
            buffers = [batch.column(c)[i].as_buffer() for c in range(4, 8)]
            tokens, code, lengths = (np.frombuffer(x, "<i4") for x in buffers[:3])
            ends = pa.py_buffer(np.append(0, np.cumsum(lengths, dtype=np.int64)))
            n, words = len(tokens), pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, ends, buffers[3]])
            yield Cut(
                ids, held_out, learn.to_numpy(zero_copy_only=False).astype(bool), seeds.to_numpy(),
                np.append(np.repeat(np.arange(n), tokens), np.arange(n)),
                np.append(code.astype(np.int64), np.full(n, len(words))),
                pa.concat_arrays([words, pa.array([END], pa.large_binary())]))


def _places(words: pa.Array, listed: pa.Array) -> np.ndarray:
    """Where each word is in a list, -1 if it isn't."""
    return pc.fill_null(pc.index_in(words, listed), -1).to_numpy().astype(np.int64)


def _all_words(cuts: DataFrame) -> DataFrame:
    """(word, n) over all texts to learn from, end marks included."""
    return _counted(cuts, None).select("word", "n")


def _packed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """The bytes of the values, cut at ``ends``."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _vectors(cuts: DataFrame, common: list[bytes]) -> DataFrame:
    """Each learned text's numbers of common words and how often it has them; ``seed`` is its hash."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(common, pa.large_binary())
        for cut in _read_cuts(source):
            token = _places(cut.words, listed)[cut.code]
            wanted = (token >= 0) & cut.learn[cut.doc]
            pairs, n = np.unique(cut.doc[wanted] * len(common) + token[wanted], return_counts=True)
            learned = np.flatnonzero(cut.learn)
            ends = np.append(np.searchsorted(pairs, learned * len(common)), len(pairs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cut.seeds[learned]), _packed(ends, (pairs % len(common)).astype("<u2")),
                 _packed(ends, n.astype("<f4"))], names=["seed", "ids", "n"])

    return cuts.mapInArrow(batches, "seed long, ids binary, n binary")


def _first_shares(seeds: np.ndarray, start: int) -> np.ndarray:
    """Uneven random shares of the classes, given by each text's hash."""
    column = np.arange(CLASSES, dtype=np.uint64) + np.uint64(start * CLASSES + 1)
    spread = _mixed(seeds.view(np.uint64)[:, None] + column * np.uint64(_BASE)) >> np.uint64(11)
    share = ((spread + np.uint64(1)) / 2.0**53) ** (1 / 0.3)
    return share / share.sum(axis=1, keepdims=True)


def _round(vectors: DataFrame, starts: list[int], size: int, models: dict | None) -> dict:
    """One expectation step over all texts: per start the class-word sums, the classes' sums and
    the likelihood under ``models`` (start: logs of prior and words), None for the first one.
    Tasks add up their texts; blocks of words are summed by key."""
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros((CLASSES, size)) for s in starts}
        heads = {s: np.zeros(CLASSES + 1) for s in starts}
        for batch in source:
            first = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy() // 2))
            every = _joined(batch.column(1), "<u2").astype(np.intp), _joined(batch.column(2), "<f4").astype(float)
            for a in range(0, batch.num_rows, TEXTS):
                seeds = batch.column(0).to_numpy()[a : a + TEXTS]
                lengths = np.diff(first[a : a + TEXTS + 1])
                ids, n = (x[first[a] : first[a + len(seeds)]] for x in every)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                for s in starts:
                    if sent.value is None:
                        share = _first_shares(seeds, s)
                    else:
                        prior, word = sent.value[s]
                        logs = np.stack([np.bincount(doc, n * word[k][ids], len(lengths)) for k in range(CLASSES)], axis=1)
                        logs += prior
                        top = logs.max(axis=1, keepdims=True)
                        share = np.exp(logs - top)
                        total = share.sum(axis=1, keepdims=True)
                        share /= total
                        heads[s][CLASSES] += (top + np.log(total)).sum()
                    heads[s][:CLASSES] += share.sum(axis=0)
                    for k in range(CLASSES):
                        sums[s][k] += np.bincount(ids, n * np.repeat(share[:, k], lengths), size)
        keys, values = [], []
        for s in starts:
            keys.append(s << 40)
            values.append(heads[s].tobytes())
            for k in range(CLASSES):
                for at in range(0, size, WORD_BLOCK):
                    keys.append(s << 40 | (k + 1) << 32 | at)
                    values.append(sums[s][k, at : at + WORD_BLOCK].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], names=["key", "x"])

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "x": [sum(map(np.frombuffer, frame["x"])).tobytes()]})

    out = {s: (np.zeros((CLASSES, size)), np.zeros(CLASSES + 1)) for s in starts}
    made = vectors.mapInArrow(batches, "key long, x binary")
    for row in made.groupBy("key").applyInPandas(total, "key long, x binary").collect():
        s, k, at, x = row["key"] >> 40, (row["key"] >> 32) & 255, row["key"] & 0xFFFFFFFF, np.frombuffer(row["x"])
        if k:
            out[s][0][k - 1, at : at + len(x)] = x
        else:
            out[s][1][:] = x
    sent.unpersist()
    return out


def _classes(n_texts: int, cuts: DataFrame, words: DataFrame) -> Classes:
    """Expectation maximisation over all texts: each round's expectation step runs in tasks.  The
    likeliest of a few starts goes on until a round gains little."""
    size = max(CLASS_WORDS, min(MOST_CLASS_WORDS, n_texts // TEXTS_A_WORD))
    short = words.where(F.octet_length("word") <= COMMON_BYTES)
    common = short.orderBy(F.col("n").desc(), "word").limit(size).toArrow().column("word").to_pylist()
    place = {w: i for i, w in enumerate(common)}
    if not place:
        return Classes({}, np.zeros(CLASSES), np.zeros((0, CLASSES)))
    vectors = stored(_vectors(cuts, common), "vectors")
    models, starts, before = None, list(range(STARTS)), -math.inf
    for number in range(ROUNDS + 1):  # the first one only counts the random shares
        found = _round(vectors, starts, len(common), models)
        likely = {s: float(found[s][1][CLASSES]) for s in starts}
        models = {}
        for s, (sums, head) in found.items():
            word = sums + 0.05
            prior = head[:CLASSES] + 1
            models[s] = np.log(prior / prior.sum()), np.log(word / word.sum(axis=1, keepdims=True))
        if number == TRIALS:
            starts = [max(starts, key=likely.get)]
        elif number > TRIALS and likely[starts[0]] - before < GAIN * abs(before):
            break
        before = likely[starts[0]]
    prior, word = models[starts[0]]
    return Classes(place, prior / math.log(10), np.ascontiguousarray(word.T) / math.log(10))


_COUNTS = ("class", "word", "n", "uses", "total")


def _numbered(words: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word among the distinct ones, and where each of these comes first."""

    def firsts(of: np.ndarray) -> np.ndarray:
        first = np.empty(of.max(initial=-1) + 1, np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        return first

    of = pd.factorize(hashes)[0]
    first = firsts(of)
    if not pc.all(pc.equal(words, words.take(pa.array(first[of])))).as_py():  # two words of one hash
        of = words.dictionary_encode().indices.to_numpy()
        first = firsts(of)
    return of, first


class Counts(NamedTuple):
    """Words of classes, and how often they are in the texts to learn from, and in all."""

    k: np.ndarray
    words: pa.Array
    hashes: np.ndarray
    n: np.ndarray
    uses: np.ndarray

    @classmethod
    def added(cls, held: list["Counts"]) -> tuple["Counts", np.ndarray]:
        """Some added up, and how often each word is in all classes."""
        words = pa.concat_arrays([c.words for c in held])
        k, hashes, n, uses = (np.concatenate([c[i] for c in held]) for i in (0, 2, 3, 4))
        of, first = _numbered(words, hashes)
        pair, width = k * len(first) + of, max(len(first), 1)
        total = np.bincount(of, n, width).astype(np.int64)
        n, uses = (np.bincount(pair, x, CLASSES * width).astype(np.int64) for x in (n, uses))
        found = np.flatnonzero(uses)
        at = first[found % width]
        return cls(found // width, words.take(pa.array(at)), hashes[at], n[found], uses[found]), total[found % width]

    @property
    def size(self) -> int:
        return self.words.nbytes


def _added_edges(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = map(np.concatenate, zip(*held))
    of, keys = pd.factorize(keys)
    return keys, np.bincount(of, n, len(keys))


def _counted(cuts: DataFrame, classes: Classes | None) -> DataFrame:
    """(class, word, n, uses, total), end marks included: in the texts to learn from, in all, and in those of
    all classes to learn from.  In other rows, whose word is null, the distinct edges between words of all
    texts in bundles, and how often those to learn from have them.

    Without ``classes`` just the words of texts to learn from, as those of one class.  Counts are dealt by the
    hash of the word or edge and travel in bundles, a row for each part."""
    parts = 1 + cuts.count() // 2

    def dealt(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by parts, the parts and where each ends."""
        part = (hashes % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
        some = np.flatnonzero(np.diff(ends))
        return order, some, np.append(ends[some], len(part))

    def words_out(counts: Counts) -> pa.RecordBatch:
        order, some, ends = dealt(counts.hashes)
        offsets, data = _letters(counts.words.take(pa.array(order)))
        return pa.RecordBatch.from_arrays(
            [pa.array(2 * some), _packed(ends, counts.n[order].astype("<i8")), _packed(ends, counts.uses[order].astype("<i8")),
             _packed(ends, counts.k[order].astype("<u1")), _packed(ends, np.diff(offsets).astype("<i4")),
             _packed(offsets[ends], data)], names=names)

    def edges_out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order, some, ends = dealt(_mixed(keys.view(np.uint64)))
        none = pa.nulls(len(some), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(2 * some + 1), _packed(ends, n[order].astype("<i8")), _packed(ends, keys[order].astype("<i8")),
             none, none, none], names=names)

    def bundles(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, edges = [], []
        for cut in _read_cuts(source):
            if classes is None:
                uses = n = np.bincount(cut.code[cut.learn[cut.doc]], minlength=len(cut.words))
            else:
                k = classes.of_all(cut)
                pair = k[cut.doc] * len(cut.words) + cut.code
                uses, n = np.bincount(pair), np.bincount(pair, cut.learn[cut.doc])
                kind, keys = _crossings(cut, k)
                times, some = np.bincount(kind, cut.learn[cut.doc], keys.shape[1]), keys >= 0
                edges = [_added_edges([*edges, *((x[there], times[there]) for x, there in zip(keys, some))])]
            found = np.flatnonzero(uses)
            code = found % len(cut.words)
            words.append(Counts(found // len(cut.words), cut.words.take(pa.array(code)), word_hashes(cut.words)[code],
                                n[found].astype(np.int64), uses[found].astype(np.int64)))
            if sum(len(c.k) for c in words) > WORDS_HELD or sum(c.size for c in words) > LETTERS_HELD:
                words = [Counts.added(words)[0]]
                if len(words[0].k) > WORDS_HELD // 2 or words[0].size > LETTERS_HELD // 2:
                    yield words_out(words[0])
                    words = []
            if edges and len(edges[0][0]) > CROSSINGS_HELD:
                yield edges_out(*edges[0])
                edges = []
        if sum(len(c.k) for c in words):
            yield words_out(Counts.added(words)[0])
        if edges:
            yield edges_out(*edges[0])

    def opened(rows: pa.RecordBatch) -> Counts:
        n, uses, k, lengths, letters = (
            _joined(rows.column(c), t) for c, t in zip(names[1:], ("<i8", "<i8", "<u1", "<i4", "<u1")))
        offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        return Counts(k.astype(np.int64), words, word_hashes(words), n, uses)

    def summed(part: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        if part % 2:
            keys, n = _added_edges([(_joined(r.column("uses"), "<i8"), _joined(r.column("n"), "<i8")) for r in rows])
            bundle = _bundle(np.array([0, len(keys)]), [keys >> 8, keys >> 8, keys & 255, n, keys >> 8, keys & 255])
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, t) for t in (pa.int32(), pa.binary(), *[pa.int64()] * 3)), *bundle.columns], names=out)
        counts, total = Counts.added([opened(r) for r in rows])
        bundle = [pa.nulls(len(total), t) for t in (pa.int64(), *[pa.binary()] * len(_EDGE))]
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.k.astype(np.int32)), counts.words.cast(pa.binary()), pa.array(counts.n), pa.array(counts.uses),
             pa.array(total), *bundle], names=out)

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for batch in source:
            found = batch.column(0).to_numpy()
            starts = np.append(0, np.flatnonzero(found[1:] != found[:-1]) + 1)[: len(found)]
            for a, b in zip(starts, np.append(starts[1:], len(found))):
                if found[a] != part and held:
                    yield summed(part, held)
                    held = []
                part = int(found[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield summed(part, held)

    names = ["part", "n", "uses", "classes", "lengths", "letters"]
    schema = "class int, word binary, n long, uses long, total long, " + _BUNDLE
    out = [f.split(" ")[0] for f in schema.split(", ")]
    made = cuts.mapInArrow(bundles, "part long, n binary, uses binary, classes binary, lengths binary, letters binary")
    return made.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(sums, schema)


def _crossings(cut: Cut, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each token, and in ``CROSSING`` rows each kind's first edges as context * 256 + byte, -1 where
    there are fewer.  Tokens of a kind share the text's class, the five bytes before and their beginning."""
    offsets, data = (np.frombuffer(x, t) for x, t in zip(cut.words.buffers()[1:], ("<i8", np.uint8)))
    start, end = offsets[: len(cut.words)], offsets[1 : len(cut.words) + 1]
    size, power = end - start, DIGIT ** np.arange(6, dtype=np.int64)
    head, last = np.full((len(size), CROSSING), -1, np.int64), np.zeros(len(size), np.int64)
    for j in range(CROSSING):
        inside = j < size
        head[:, j] = np.where(inside, data[np.where(inside, start + j, 0)], np.where(j == size, BLANK - 1, -1))
        last += np.where(inside, data[np.where(inside, end - 1 - j, 0)].astype(np.int64) + 1, 0) * power[j]
    head[-1, 1:] = -1  # nothing follows the end mark
    n = len(cut.code) - cut.n
    code, doc = cut.code[:n], cut.doc[:n]
    begins = np.append(True, doc[1:] != doc[:-1])[:n]
    tail = last[code]  # the last four bytes of the text after each word
    few = np.flatnonzero((size < 4)[code])  # these reach over two blanks at most
    own, over, room = last[code[few]], power[size[code[few]]], power[4 - size[code[few]]]
    for _ in range(2):
        tail[few] = own + over * ((np.where(begins[few], 0, tail[few - 1]) * DIGIT + BLANK) % room)
    tokens = np.bincount(doc, minlength=cut.n)
    at_end = np.where(tokens > 0, np.append(0, tail)[np.cumsum(tokens)], 0)
    before = k[cut.doc] * DIGIT**4  # the class and four bytes: the blank after them is the fifth
    before[:n] += np.where(begins, 0, np.append(0, tail)[:n])
    before[n:] += at_end
    of_head, heads = pd.factorize((head + 1) @ power[:CROSSING])
    kind, both = pd.factorize(before * len(heads) + of_head[cut.code])
    context = both // len(heads)
    head = ((heads[:, None] // power[:CROSSING]) % DIGIT - 1).T[:, both - context * len(heads)]
    context = context // DIGIT**4 * SPAN + context % DIGIT**4 * DIGIT + BLANK
    keys = np.empty(head.shape, np.int64)
    for j in range(CROSSING):
        keys[j] = np.where(head[j] >= 0, context * 256 + head[j], -1)
        topic = context // SPAN * SPAN
        context = topic + ((context - topic) * DIGIT + head[j] + 1) % SPAN
    return kind, keys


def _batched(counts: DataFrame, n_words: int) -> DataFrame:
    """Neighbours in the order of class and word, a batch a row: their beginnings are shared."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in source:
            words, a = batch.column(1), 0
            ends = np.cumsum(pc.binary_length(words).to_numpy() + np.int64(1))
            columns = [batch.column(0).to_numpy().astype("<i8"), *(batch.column(c).to_numpy() for c in (2, 3, 4))]
            while a < len(words):
                before = ends[a - 1] if a else 0
                b = min(a + BATCH_WORDS, max(a + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
                some = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), words.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pc.binary_join(some, pa.scalar(b" ")),
                     *(pa.array([c[a:b].tobytes()], pa.binary()) for c in columns)],
                    names=["batch", "words", "classes", "n", "uses", "total"])
                number, a = number + 1, b

    parts = max(counts.sparkSession.sparkContext.defaultParallelism, n_words // 50_000)
    rows = counts.select(*_COUNTS).repartitionByRange(parts, "class", "word")
    return rows.sortWithinPartitions("class", "word").mapInArrow(
        batches, "batch long, words binary, classes binary, n binary, uses binary, total binary")


_EDGE = {"context": "<i8", "node": "<i8", "byte": "<i2", "n": "<i8", "batch": "<i8", "local": "<i4"}
#: Edges travel in bundles, many in a row.
_BUNDLE = "edges long, " + ", ".join(f"{name}_ binary" for name in _EDGE)


def _bundle(ends: np.ndarray, columns: list[np.ndarray], *keys: tuple[str, pa.Array]) -> pa.RecordBatch:
    """Bundles of edges, cut at ``ends``, and what stands beside them."""
    made = [_packed(ends, c.astype(k)) for c, k in zip(columns, _EDGE.values())]
    return pa.RecordBatch.from_arrays(
        [*(x for _, x in keys), pa.array(np.diff(ends).astype(np.int64)), *made],
        names=[*(name for name, _ in keys), "edges", *(f"{name}_" for name in _EDGE)])


def _unbundled(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of all edges of some bundles."""
    return [_joined(batch.column(f"{name}_"), kind) for name, kind in _EDGE.items()]


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    """The values that all rows have packed, one after the other."""
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    size = int(ends[-1] - ends[0]) // np.dtype(kind).itemsize if len(column) else 0
    return np.frombuffer(column.buffers()[2], kind, size, int(ends[0])) if size else np.empty(0, kind)


def _summed(bundles: DataFrame, k: int) -> DataFrame:
    """For each last ``k`` bytes (``tail``) and byte: n and ``edges``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            context, _, byte, n, _, _ = _unbundled(batch)
            of, keys = pd.factorize(shorter(context, k) * 256 + byte)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, of, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys >> 8), pa.array((keys & 255).astype(np.int16)), pa.array(sums),
                 pa.array(np.bincount(of, minlength=len(keys)))], names=["tail", "byte", "n", "edges"])

    made = bundles.select("edges", *(f"{name}_" for name in _EDGE)).mapInArrow(
        batches, "tail long, byte short, n long, edges long")
    return made.groupBy("tail", "byte").agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"))


def _by_ending(edges: DataFrame, hot: np.ndarray, common: np.ndarray, only: bool = False) -> DataFrame:
    """Edges bundled by ``tail``, the last three bytes; those of ``hot`` tails by ``context`` too, and those of
    ``common`` contexts by ``node`` (else null).  With ``only``, just those of hot tails."""
    hot, common = np.sort(hot), np.sort(common)

    def out(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        tail = shorter(columns[0], 3)
        in_hot = np.isin(tail, hot)
        if only:
            columns, tail, in_hot = [c[in_hot] for c in columns], tail[in_hot], in_hot[in_hot]
        in_common = in_hot & np.isin(columns[0], common)
        keys = [np.where(in_common, columns[1], 0), np.where(in_hot, columns[0], 0), tail]
        order = np.lexsort(keys) if in_hot.any() else np.argsort(tail, kind="stable")
        keys, differs = [x[order] for x in keys], np.zeros(max(len(order) - 1, 0), bool)
        for x in keys:
            differs |= x[1:] != x[:-1]
        starts = np.append(0, np.flatnonzero(differs) + 1)[: len(order)]
        at = order[starts]
        return _bundle(
            np.append(starts, len(order)), [c[order] for c in columns], ("tail", pa.array(tail[at])),
            ("context", pa.array(columns[0][at], mask=~in_hot[at])), ("node", pa.array(columns[1][at], mask=~in_common[at])))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in source:
            held.append(_unbundled(batch))
            n += len(held[-1][0])
            if n > EDGES_HELD:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    return edges.mapInArrow(batches, "tail long, context long, node long, " + _BUNDLE)


def _edges(batched: DataFrame) -> DataFrame:
    """The distinct (word so far, next byte) of each batch, with their counts; a bundle a batch."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for number, words, classes, n in zip(*(batch.column(c).to_pylist() for c in range(4))):
                bits = Bits(words.split(b" "), np.frombuffer(classes, "<i8"))
                first, of = bits.edges()
                total = np.bincount(of, np.repeat(np.frombuffer(n, "<i8"), bits.lengths).astype(float), len(first))
                yield _bundle(np.array([0, len(first)]), [
                    bits.context[first], bits.node[first], bits.byte[first], total, np.full(len(first), number),
                    np.arange(len(first))])

    return batched.select("batch", "words", "classes", "n").mapInArrow(batches, _BUNDLE)


def _parts(edges: DataFrame, tails: DataFrame, parts: int) -> DataFrame:
    """Edges dealt to ``parts`` by the class and the last three bytes, a part a row, so it has all
    that is to be counted of these contexts and longer ones.  ``of`` are the batches' edges.

    An ending with more than ``HOT`` edges is dealt by its last five bytes, and one of these by the
    word so far; then the part is given the sums by byte of the whole ending, or of the five bytes.
    ``tails`` has n and ``edges`` for each tail and byte.
    """
    # Both lists have at most a row for ``HOT`` edges.
    none, listed = np.empty(0, np.int64), lambda df, name: df.select(name).toArrow().column(name).to_numpy()
    hot = tails.groupBy("tail").agg(F.sum("edges").alias("in_tail")).where(F.col("in_tail") > HOT)
    hot = stored(hot, "hot_tails")
    hot_tails, hot_contexts = listed(hot, "tail"), none
    spread, given = F.xxhash64("tail"), None
    if len(hot_tails):
        common = _by_ending(edges, hot_tails, none, only=True).groupBy("context").agg(F.sum("edges").alias("in_context"))
        common = stored(common.where(F.col("in_context") > HOT), "hot_contexts")
        hot_contexts = listed(common, "context")
    rows = _by_ending(edges, hot_tails, hot_contexts)
    if len(hot_tails):
        rows = rows.join(F.broadcast(hot), "tail", "left").join(F.broadcast(common), "context", "left")
        spread = F.when(F.col("in_context").isNotNull(), F.xxhash64(
            "context", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_context") / HOT)))).when(
            F.col("in_tail").isNotNull(), F.xxhash64(
                "tail", F.pmod(F.xxhash64("context"), F.ceil(F.col("in_tail") / HOT)))).otherwise(spread)
        dealt = rows.withColumn("spread", spread)
        three = tails.select("tail", "byte", "n").join(
            dealt.where("in_tail IS NOT NULL").select("tail", "spread").distinct(), "tail")
        wide = dealt.where("in_context IS NOT NULL")
        five = _summed(wide, 5).select(F.col("tail").alias("context"), "byte", "n").join(
            wide.select("context", "spread").distinct(), "context")
        blank = [F.lit(0).cast("long").alias("node"), "byte", "n"]
        given = three.select(F.col("tail").alias("context"), *blank, F.lit(-3).cast("long").alias("batch"), "spread")
        given = given.unionByName(five.select("context", *blank, F.lit(-5).cast("long").alias("batch"), "spread"))
    names = ["edges", *(f"{name}_" for name in _EDGE)]
    rows = rows.withColumn("spread", spread).select("spread", *names)

    def bundles(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield _bundle(np.arange(len(batch) + 1), [batch.column(name).to_numpy() for name in _EDGE],
                          ("spread", batch.column("spread")))

    if given is not None:
        given = given.withColumn("local", F.lit(-1)).select("spread", *_EDGE)
        rows = rows.unionByName(given.mapInArrow(bundles, "spread long, " + _BUNDLE))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unbundled(batch) for batch in source if batch.num_rows]
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held)]
        del held
        sums = []
        for k in (3, 5):
            key, byte, n = (c[columns[4] == -k] for c in (columns[0], columns[2], columns[3]))
            once = np.unique(key * 256 + byte, return_index=True)[1]  # two shares of an ending may meet here
            sums.append([key[once], byte[once], n[once]])
        if len(sums[0][0]):
            own = columns[4] >= 0
            columns = [c[own] for c in columns]
        context, node, byte, n, batch, local = columns
        # Endings are in the order of a hash that keeps them apart, so each chunk has some of all classes.
        order = np.lexsort((byte, node, _mixed(shorter(context, 3).view(np.uint64))))
        new = np.append(True, (node[order][1:] != node[order][:-1]) | (byte[order][1:] != byte[order][:-1]))
        of = np.empty(len(order), np.int32)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        values = [context[first], node[first], byte[first], total, of, batch, local, *sums[0], *sums[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v.astype(k).tobytes()], pa.binary()) for v, k in zip(values, _PART_TYPES)], names=list(_PART))

    return rows.repartition(parts, "spread").mapInArrow(batches, ", ".join(f"{name} binary" for name in _PART))


_PART = {"context": "<i8", "node": "<i8", "byte": "<i2", "n": "<i8", "of": "<i4", "batch": "<i8", "local": "<i4",
         "context3": "<i8", "byte3": "<i2", "n3": "<i8", "context5": "<i8", "byte5": "<i2", "n5": "<i8"}
_PART_TYPES = tuple(_PART.values())


def _opened(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each part: its chunks of (context, byte, n, counts of the long contexts), made as they are
    asked for, and (of, batch, local)."""
    for whole in source:
        for row in zip(*whole.columns):
            values = [np.frombuffer(x.as_buffer(), k) for x, k in zip(row, _PART_TYPES)]
            yield _chunks(*values[:4], values[7:10], values[10:]), values[4:7]


def _chunks(context, node, byte, n, three, five) -> Iterator[tuple]:
    """A chunk has all edges of its endings: those of the part, and in the sums those of others."""
    tail, a = shorter(context, 3), 0
    ends = np.append(np.flatnonzero(tail[1:] != tail[:-1]) + 1, len(tail))
    while a < len(tail):
        b = int(ends[min(np.searchsorted(ends, a + CHUNK), len(ends) - 1)])
        part = slice(a, b)
        long = [_counts_with(tail[part], byte[part], n[part], *three), _counts_with(context[part], byte[part], n[part], *five),
                counts_of(node[part], byte[part], n[part])]
        yield context[part], byte[part].astype(np.uint8), n[part], long
        a = b


def _counts_with(key, byte, n, given_key, given_byte, given_n) -> np.ndarray:
    """As ``counts_of``; the sums stand for all edges of their keys."""
    if not len(given_key):
        return counts_of(key, byte, n)
    n = np.where(np.isin(key, given_key), 0, n)
    return counts_of(*map(np.concatenate, ((key, given_key), (byte, given_byte), (n, given_n))))[: len(key)]


_MODELS: dict[str, Model] = {}


def _on_worker(name: str, sent) -> Model:
    """The prepared model, once in each Python worker; only the newest is held."""
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = Model(**sent.value["model"]).prepared()
    return _MODELS[name]


def train(texts: DataFrame) -> tuple[dict, DataFrame]:
    """The weights, classes and short contexts within words and between them, and the table (word, n) of all words.

    ``texts`` has doc_id and text.
    """
    return _trained(texts.withColumn("learn", F.lit(True)))[:2]


def _trained(rows: DataFrame, cuts: DataFrame | None = None) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """As ``train`` for the rows to ``learn`` from; and the batches and parts of all words."""
    cuts = stored(_cuts(rows), "cuts") if cuts is None else cuts
    words = stored(_all_words(cuts), "word_counts")
    classes = _classes(rows.where("learn").count(), cuts, words)
    counted = stored(_counted(cuts, classes), "class_word_counts")
    counts = counted.where("word IS NOT NULL").select(*_COUNTS)
    size = counts.agg(F.count("*").alias("words"), F.sum(F.octet_length("word") + 1).alias("bytes")).first()
    batched = stored(_batched(counts, size["words"]), "batches")
    edges = stored(_edges(batched), "edges")
    tails = _tails(edges)
    parts = stored(_parts(edges, tails, 1 + (size["bytes"] or 0) // PART), "parts")
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    crossing = counted.where("word IS NULL").select("edges", *(f"{name}_" for name in _EDGE))
    between = _tails(crossing)
    n_crossing = crossing.agg(F.sum("edges").alias("n")).first()["n"] or 0
    crossings = stored(_parts(crossing, between, 1 + n_crossing // CROSSING_PART), "crossings")
    return {"model": _learned(parts, tails, DIGIT ** (CROSSING - 1)), "classes": classes, "total": sums["n"] or 0,
            "distinct": sums["v"], "crossing": _learned(crossings, between, 0), "crossings": crossings}, words, batched, parts


def _tails(edges: DataFrame) -> DataFrame:
    """How often a byte follows the last three, and how many edges that are."""
    return stored(_summed(edges, 3), "tails")


def _learned(parts: DataFrame, tails: DataFrame, least: int) -> dict:
    """The model of all edges of the parts, learned from those whose last bytes are ``least`` or more as a number."""
    two = F.expr(f"(tail - tail % {SPAN} + (tail % {SPAN}) % {DIGIT ** 2}) * 256 + byte")
    low = tails.groupBy(two.alias("low")).agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    keys = low.column("low").to_numpy()
    order = np.argsort(keys)
    model = {"low": keys[order], "low_n": low.column("n").to_numpy()[order],
             "weights": np.full((GATES, INPUTS), 0.3), "refined": _flat_table()}
    for _ in range(LESSONS):
        _lesson(parts, model, least)
    return model


def _lesson(parts: DataFrame, model: dict, least: int) -> None:
    """One round of learning: the weights go on through all chunks of a part and are averaged by
    tokens with those of the other parts, so what is learned depends neither on the number of
    cores nor on how rows lie.  The refinement is that of the last round."""
    sent, name = parts.sparkSession.sparkContext.broadcast({"model": model}), uuid.uuid4().hex

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks, _ in _opened(source):
            squares, share = np.full((GATES, INPUTS), 1e-3), 0.0
            hits, tries = np.zeros((GATES, BUCKETS)), np.zeros((GATES, BUCKETS))
            model = _on_worker(name, sent)
            model.weights = sent.value["model"]["weights"].copy()
            for number, (context, byte, n, long) in enumerate(chunks):
                n = np.where(context % SPAN >= least, n, 0)
                order = np.random.default_rng(number).permutation(np.flatnonzero(n))
                for at in range(0, len(order), STEP):
                    some = np.sort(order[at : at + STEP])
                    bits = Bits.of_edges(byte[some], context[some], [t[some] for t in long])
                    model.learn(bits, n[some], squares, hits, tries)
                share += float(n.sum())
            if share:
                flat = np.concatenate([(model.weights * share).ravel(), hits.ravel(), tries.ravel(), [share]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([flat.tobytes()], pa.binary())],
                    names=["k", "x"])

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "x": [sum(map(np.frombuffer, frame["x"])).tobytes()]})

    learned = parts.mapInArrow(batches, "k int, x binary").groupBy("k").applyInPandas(total, "k int, x binary")
    rows = [np.frombuffer(r["x"]) for r in learned.collect()]  # at most ``SUMS``, each as long as the model
    if rows:
        flat = sum(rows)
        w, t = GATES * INPUTS, GATES * BUCKETS
        model["weights"] = (flat[:w] / flat[-1]).reshape(GATES, INPUTS)
        hits, tries = flat[w : w + t].reshape(GATES, BUCKETS), flat[w + t : w + 2 * t].reshape(GATES, BUCKETS)
        model["refined"] = np.clip((hits + 20 * _flat_table()) / (tries + 20), 1e-6, 1 - 1e-6)
    sent.unpersist()


# ---------------------------------------------------------------- scoring

def _word_scores(batched: DataFrame, parts: DataFrame, model: dict) -> DataFrame:
    """(w, uses, n, score): the hash of class and word, in how many places, how often learned in all classes,
    and the score.  Edges are scored in their parts and added up in their batches.  A part
    hands on a row for each batch.
    Scores are those of the bytes from which on contexts don't reach over the blank before the word."""
    sent, name = batched.sparkSession.sparkContext.broadcast({"model": model}), uuid.uuid4().hex

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks, (of, batch, local) in _opened(source):
            model = _on_worker(name, sent)
            x = np.concatenate([model.edge_scores(context, byte, long) for context, byte, _, long in chunks])[of]
            order = np.argsort(batch, kind="stable")
            batch = batch[order]
            starts = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])[: len(batch)])
            ends = np.append(starts, len(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch[starts]), _packed(ends, local[order].astype("<i4")), _packed(ends, x[order])],
                names=["batch", "local", "x"])

    def add(words: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        given, classes = words["words"].iloc[0].split(b" "), np.frombuffer(words["classes"].iloc[0], "<i8")
        bits = Bits(given, classes)
        local, found = (np.frombuffer(b"".join(scores[c]), k) for c, k in (("local", "<i4"), ("x", "<f8")))
        x = np.empty(len(found))
        x[local] = found
        x = np.where(bits.context % SPAN >= DIGIT ** (CROSSING - 1), x[bits.edges()[1]], 0)
        w = pair_hashes(classes, word_hashes(pa.array(given, pa.large_binary())))
        uses, n = (np.frombuffer(words[c].iloc[0], "<i8") for c in ("uses", "total"))
        return pd.DataFrame({"w": w, "uses": uses, "n": n, "score": np.add.reduceat(x, bits.starts)})

    scores = parts.mapInArrow(batches, "batch long, local binary, x binary")
    return batched.groupBy("batch").cogroup(scores.groupBy("batch")).applyInPandas(
        add, "w long, uses long, n long, score double")


def _crossing_scores(crossings: DataFrame, model: dict) -> DataFrame:
    """(w, n, x) of the edges between words: context * 256 + byte, how often learned, score."""
    sent, name = crossings.sparkSession.sparkContext.broadcast({"model": model}), uuid.uuid4().hex

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks, _ in _opened(source):
            for context, byte, n, long in chunks:
                x = _on_worker(name, sent).edge_scores(context, byte, long)
                yield pa.RecordBatch.from_arrays([pa.array(context * 256 + byte), pa.array(n), pa.array(x)], names=["w", "n", "x"])

    return crossings.mapInArrow(batches, "w long, n long, x double")


def score_texts(
    docs: DataFrame, number: str = "doc_id", text: str = "text", held_out: Column | None = None
) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows where ``held_out`` (by default crc32 of the number mod 5 = 1) isn't true.
    """
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(number).cast("string"), F.lit(""))) % 5 == 1
    rows = docs.select(F.col(number).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    rows = rows.withColumn("learn", F.expr("coalesce(NOT held_out, false)"))
    cuts = stored(_cuts(rows), "cuts")
    made, words, batched, parts = _trained(rows, cuts)
    pairs = stored(_word_scores(batched, parts, made["model"]), "word_scores")
    classes, total = made["classes"], made["total"]
    below = total + 0.5 * (made["distinct"] + 1)
    top, least = _commonest(pairs, "uses", COMMON)
    held = Held.of(top, below)
    crossing = stored(_crossing_scores(made["crossings"], made["crossing"]), "crossing_scores")
    between, seldom = _commonest(crossing, "n", COMMON_CROSSINGS)
    between = Listed(between.column("w").to_numpy()), between.column("x").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((classes, held, between))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for cut in _read_cuts(source):
            ids = pa.array(np.arange(uid, uid + cut.n))
            uid += cut.n
            yield pa.RecordBatch.from_arrays([cut.ids, cut.held_out, ids, *_scored(cut, *sent.value)], names=names)

    names = ["doc_id", "held_out", "uid", "n_tokens", "n_known", "base_score", "score", "rare", "times"]
    schema = ("doc_id long, held_out boolean, uid long, n_tokens long, n_known long, base_score double, "
              "score double, rare array<long>, times array<int>")
    scored = stored(cuts.mapInArrow(batches, schema), "scored")
    # What the commonest words and edges don't cover gets its scores and counts by a join.
    uncommon = pairs.where(F.col("uses") <= least).select("w", "n", F.col("score").alias("x")).unionByName(
        crossing.where(F.col("n") <= seldom).withColumn("n", F.lit(None).cast("long")))
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    found = rare.select("uid", F.col("r.rare").alias("w"), F.col("r.times").alias("k")).join(
        uncommon.hint("shuffle_hash"), "w")  # a row for each w, so all parts are small
    found = found.groupBy("uid").agg(
        F.sum(F.col("k") * F.log10((F.col("n") + 0.5) / F.lit(below))).alias("base"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("known"),
        F.sum(F.col("k") * F.col("x")).alias("more"))
    return scored.drop("rare", "times").join(found, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def _commonest(rows: DataFrame, by: str, most: int) -> tuple[pa.Table, int]:
    """The rows that come first by a count and ``w``, and the count from which on others may follow."""
    times = rows.groupBy(by).count().toArrow().sort_by([(by, "descending")])  # few counts differ
    enough = np.flatnonzero(np.cumsum(times.column("count").to_numpy()) >= most)
    least = int(times.column(by)[int(enough[0])].as_py()) if len(enough) else 0
    found = rows.where(F.col(by) >= least).orderBy(F.col(by).desc(), "w").limit(most).toArrow()
    return found, pc.min(found.column(by)).as_py() or 0


@dataclass
class Listed:
    """Numbers whose places are looked up."""

    numbers: np.ndarray

    def __getstate__(self):
        return {"numbers": self.numbers}

    @functools.cached_property
    def index(self) -> pd.Index:
        return pd.Index(self.numbers)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Where each number is, -1 if it isn't listed."""
        return self.index.get_indexer(wanted)


@dataclass
class Held:
    """The commonest words of classes by hash, and what each use adds; nothing for the place -1."""

    words: Listed
    score: np.ndarray
    base: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, top: pa.Table, below: float) -> "Held":
        n = top.column("n").to_numpy()
        values = top.column("score").to_numpy(), np.log10((n + 0.5) / below), (n > 0).astype(float)
        return cls(Listed(top.column("w").to_numpy()), *(np.append(x, 0.0) for x in values))


def _scored(cut: Cut, classes: Classes, held: Held, between: tuple[Listed, np.ndarray]) -> list[pa.Array]:
    """n_tokens, n_known, base, score, words (hashes) and edges between words that aren't held, their counts."""
    k, width = classes.of_all(cut), len(cut.words)
    pair = k[cut.doc] * width + cut.code
    seen = np.zeros(CLASSES * width, bool)
    seen[pair] = True
    distinct = np.flatnonzero(seen)
    of = (np.cumsum(seen, dtype=np.int32) - 1)[pair]
    hashes = pair_hashes(distinct // width, word_hashes(cut.words)[distinct % width])
    place = held.words.places(hashes)
    known, base, score = (np.bincount(cut.doc, x[place][of], cut.n) for x in (held.known, held.base, held.score))
    other = np.flatnonzero((place < 0)[of])
    pairs, times = np.unique(cut.doc[other] * len(distinct) + of[other], return_counts=True)
    words = pairs // max(len(distinct), 1), hashes[pairs % max(len(distinct), 1)], times
    crossed, more = _crossing_sums(cut, k, *between)
    rare_doc, rare, times = map(np.concatenate, zip(words, more))
    order = np.argsort(rare_doc, kind="stable")
    ends = pa.array(np.searchsorted(rare_doc[order], np.arange(cut.n + 1)).astype(np.int32))
    return [
        pa.array(np.bincount(cut.doc, minlength=cut.n)), pa.array(known.astype(np.int64)), pa.array(base),
        pa.array(score + crossed + classes.prior[k]), pa.ListArray.from_arrays(ends, pa.array(rare[order])),
        pa.ListArray.from_arrays(ends, pa.array(times[order].astype(np.int32)))]


def _crossing_sums(cut: Cut, k: np.ndarray, listed: Listed, score: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Each text's sum over the listed edges between its words, and (text, edge, times) of all others."""
    kind, keys = _crossings(cut, k)
    at = listed.places(keys.ravel()).reshape(keys.shape)
    sums = np.append(score, 0.0)[at].sum(axis=0)  # -1 is the last
    rare = (at < 0) & (keys >= 0)
    tokens = np.flatnonzero(rare.any(axis=0)[kind])
    row, places = np.nonzero(rare[:, kind[tokens]])
    tokens = tokens[places]
    of, distinct = pd.factorize(keys[row, kind[tokens]])
    pairs, times = np.unique(cut.doc[tokens] * max(len(distinct), 1) + of, return_counts=True)
    more = pairs // max(len(distinct), 1), distinct[pairs % max(len(distinct), 1)], times
    return np.bincount(cut.doc, sums[kind], cut.n), more
