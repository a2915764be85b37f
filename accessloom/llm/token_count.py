"""Token counts of whole texts by byte-pair merging on a heap and a linked list.

Only counts are made: each merge joins two neighbours, so a piece of ``n`` symbols after
``m`` merges has ``n - m`` tokens and no identifier is ever looked up.

Null texts count as empty (no bytes, no tokens).  Repeated rows are counted each; null ids
and further columns pass through; a column named like a result is replaced by it; an empty
table gives an empty result.  A piece of any length takes time n log n.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from accessloom.llm.common import kept_columns
from accessloom.llm.tokens import encoder, load, tokenizer_path

#: Bytes of texts cut into words at once; a longer text is taken alone.
SLICE = 8 << 20
#: Bits of a symbol's number and of a place in a piece.
_BITS, _PLACE = 24, 32
_NUMBERS, _PLACES = (1 << _BITS) - 1, (1 << _PLACE) - 1
MADE = ("n_bytes", "n_tokens", "over_limit")


class MergeCounter:
    """Counts tokens for a byte-level or word-end BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str | None = None, remembered: int = 1_500_000, held_bytes: int = 64 << 20):
        with open(tokenizer_path(path), encoding="utf-8") as f:
            described = json.load(f)
        model, self.library = described["model"], load(path)
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"]:
            raise ValueError("only plain BPE files are counted")
        self.end = model["end_of_word_suffix"] or ""
        self.numbers = model["vocab"]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.numbers[a] << _BITS | self.numbers[b]] = rank << _BITS | self.numbers[a + b]
        special = [t["content"] for t in described["added_tokens"]]
        if any(t["normalized"] or t["single_word"] for t in described["added_tokens"]):
            raise ValueError("added tokens that are matched after normalizing aren't known here")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.remembered, self.held_bytes, self.memory, self.held = remembered, held_bytes, {}, 0
        squeezed = (described["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.cuts = squeezed.get("behavior") == "Removed"  # white space is dropped
        self.cores = encoder(path)._cores if self.cuts else None

    def symbols(self, piece: str) -> list[int]:
        """Their numbers; one that no rule knows where there is none."""
        last = self.numbers.get(piece[-1] + self.end, _NUMBERS)
        return [self.numbers.get(c, _NUMBERS) for c in piece[:-1]] + [last]

    def merged(self, symbols: list[int]) -> int:
        """How many symbols are left after all merges, lowest rank and leftmost first.

        A rule is its rank and what it makes in one number, a heap entry a rule and the place
        of its left symbol; ``now`` has the rule that holds at each place, so entries of pairs
        that are gone are known.
        """
        n, rule_of = len(symbols), self.merges.get
        now = [rule_of(a << _BITS | b, -1) for a, b in zip(symbols, symbols[1:])]
        heap = [rule << _PLACE | i for i, rule in enumerate(now) if rule >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        left, right, count = list(range(-1, n - 1)), list(range(1, n + 1)), n
        pop, push = heapq.heappop, heapq.heappush
        now.append(-1)
        while heap:
            entry = pop(heap)
            i, rule = entry & _PLACES, entry >> _PLACE
            if now[i] != rule:
                continue  # one of the two has been merged meanwhile
            made, j = rule & _NUMBERS, right[i]
            symbols[i], now[j], now[i] = made, -1, -1
            after = right[i] = right[j]
            count -= 1
            if after < n:
                left[after] = i
                rule = now[i] = rule_of(made << _BITS | symbols[after], -1)
                if rule >= 0:
                    push(heap, rule << _PLACE | i)
            before = left[i]
            if before >= 0:
                rule = now[before] = rule_of(symbols[before] << _BITS | made, -1)
                if rule >= 0:
                    push(heap, rule << _PLACE | before)
        return count

    def count_plain(self, text: str) -> int:
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return sum(self.merged(self.symbols(piece)) for piece, _ in pieces if piece)

    def count_marked(self, text: str) -> int:
        """A special string is one token wherever it stands."""
        if self.special is None or not (found := self.special.findall(text)):
            return self.count_plain(text) if text else 0
        return len(found) + sum(self.count_plain(t) for t in self.special.split(text) if t)

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each of many words, cut into pieces together where each stays by itself."""
        plain = words if self.special is None else [w for w in words if not self.special.search(w)]
        joined = " ".join(plain)
        normal = self.library.normalizer.normalize_str(joined) if self.library.normalizer else joined
        kept = normal.split(" ")
        if len(plain) != len(words) or len(kept) != len(words) or not all(kept):
            return [self.count_marked(w) for w in words]
        ends, counts = [], [0] * len(words)
        at = -1
        for word in kept:
            at += len(word) + 1
            ends.append(at)
        i = 0
        for piece, (start, _) in self.library.pre_tokenizer.pre_tokenize_str(normal):
            while start >= ends[i]:
                i += 1
            if piece:
                counts[i] += self.merged(self.symbols(piece))
        return counts

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            self.memory.update(zip(some, self.count_words(some)))
        self.held += sum(map(len, words))

    def _slice(self, texts: pa.Array) -> np.ndarray:
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        cores, tails = self.cores(coded.dictionary.to_pylist())
        new = {w for w in cores if w not in self.memory}
        if len(self.memory) + len(new) > self.remembered or self.held > self.held_bytes:
            self.memory, self.held, new = {}, 0, {*cores}
        new.discard("")
        self.memory[""] = 0
        self._learn(sorted(new))
        counts = np.fromiter(map(self.memory.__getitem__, cores), np.int64, len(cores)) + (tails >= 0)
        total = np.concatenate([[0], np.cumsum(counts[coded.indices.to_numpy()])])
        return np.diff(total[np.cumsum(pc.list_value_length(words).to_numpy())], prepend=0)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; null texts are empty.

        Words are counted once and remembered, in at most ``remembered`` words and about
        ``held_bytes`` bytes of them beside those of one slice of texts.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.cuts:
            return np.array([self.count_marked(t) for t in texts.to_pylist()], np.int64)
        sizes, at, out = np.cumsum(pc.binary_length(texts).to_numpy()), 0, [np.empty(0, np.int64)]
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            until = max(int(np.searchsorted(sizes, before + SLICE, side="right")), at + 1)
            out.append(self._slice(texts.slice(at, until - at)))
            at = until
        return np.concatenate(out)


@functools.cache
def _counter(path: str | None) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(
    docs: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = 2048
) -> DataFrame:
    """Every row of ``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    keep = [c for c in kept_columns(docs, MADE) if c != text]
    kinds = [T.LongType(), T.LongType(), T.BooleanType()]
    schema = T.StructType(
        [docs.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(MADE, kinds)]
    )

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in source:
            texts = batch.column(len(keep))
            tokens = counter.counts(texts)
            sizes = pc.fill_null(pc.binary_length(texts), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [
                    sizes.cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_()),
                ],
                names=[*keep, *MADE],
            )

    return docs.select(*keep, text).mapInArrow(batches, schema)
