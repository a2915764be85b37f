"""Token ids of whole texts from a public tokenizer file."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_FILE = "word_bpe_49k.json"
#: Words that an encoder remembers at most.
REMEMBERED = 1_500_000


def tokenizer_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_FILE)
    return str(path)


@functools.cache
def load(path: str | None):
    """The tokenizer, once in each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(path))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def id_type(path: str | None) -> np.dtype:
    """Two bytes an id where the vocabulary allows it (little endian)."""
    return np.dtype("<u2" if load(path).get_vocab_size() <= 65536 else "<u4")


class Encoder:
    """Encodes columns of texts and remembers the ids of words seen before.

    Texts are cut at ASCII white space.  That is exact only for a tokenizer that drops white
    space, which ``check`` makes sure of; others encode whole texts.  New words are encoded
    many at a time, as one text with ``MARK`` between them, whose one id stands nowhere else
    as words with that letter are encoded by themselves.  Where the tokenizer lower-cases and
    takes a mark of ``TAILS`` after letters as a token of its own, words of Latin-1 letters are
    remembered in lower case and without such a last mark.  The memory is emptied when it is
    full, so its size is bounded by ``remembered`` words and ``held_bytes`` bytes of words.
    """

    TAILS = ".,;:!?"

    MARK = "0"
    #: Bytes of texts cut into words at once; a longer text is taken alone.
    SLICE = 8 << 20

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED, held_bytes: int = 64 << 20):
        self.tokenizer, self.dtype = load(path), id_type(path)
        self.remembered, self.held_bytes = remembered, held_bytes
        self._forget()
        self.cuts = self.check()
        marks = self._batch([self.MARK, f"ab {self.MARK} Cd", "ab", "Cd"])
        self.mark = marks[0][0] if len(marks[0]) == 1 else None
        if self.mark is None or marks[1].tolist() != [*marks[2], self.mark, *marks[3]]:
            self.mark = None
        self.tails = self._tails()

    def _tails(self) -> dict[str, int]:
        """The id of each last mark that can be taken off; none if the tokenizer won't have it."""
        large = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
        letters = [*large, *large.lower()]
        whole, small, *found = self._batch([large, large.lower(), *letters, *self.TAILS, *(c + t for c in letters for t in self.TAILS)])
        one = {c: x.tolist() for c, x in zip([*letters, *self.TAILS], found)}
        both = iter(found[len(one) :])
        apart = all([next(both).tolist() == one[c] + one[t] for c in letters for t in self.TAILS])
        if not apart or whole.tolist() != small.tolist() or any(len(one[t]) != 1 for t in self.TAILS):
            return {}
        if any(one[c] != one[c.lower()] for c in large):
            return {}
        return {t: one[t][0] for t in self.TAILS}

    def _cores(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The words as they are remembered, and the id of the mark taken off (-1: none)."""
        cores, taken, tails = [], np.full(len(words), -1, np.int64), self.tails
        if not tails:
            return words, taken
        for i, word in enumerate(words):
            tail = tails.get(word[-1:])
            core = word if tail is None else word[:-1]
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                cores.append(core.lower())
                if tail is not None:
                    taken[i] = tail
            else:
                cores.append(word)
        return cores, taken

    def _forget(self) -> None:
        self.memory: dict[str, int] = {"": 0}
        self.pool, self.used, self.held = np.empty(1 << 16, self.dtype), 0, 0
        self.places = np.zeros((1 << 14, 2), np.int64)  # start in the pool and length of each word

    def check(self) -> bool:
        both = self._batch(["ab, Cd", "ab,\t\r\n\x0b\x0c Cd\n", "\nab,", "Cd"])
        whole = both[0].tolist()
        return whole == both[1].tolist() == [*both[2], *both[3]]

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end, and how many each has."""
        if self.mark is not None and words:
            ids, = self._batch([f" {self.MARK} ".join([*words, ""])])
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(words):
                return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1
        found = self._batch(words)
        return np.concatenate([np.empty(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.MARK not in w]
        groups = [plain[i : i + 1024] for i in range(0, len(plain), 1024)]
        for group, found in [(g, self._words(g)) for g in groups] + self._marked(words):
            ids, sizes = found
            while self.used + len(ids) >= len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            first = len(self.memory)
            while first + len(group) > len(self.places):
                self.places = np.concatenate([self.places, np.zeros_like(self.places)])
            ends = np.cumsum(sizes)
            self.places[first : first + len(group), 0] = self.used + ends - sizes
            self.places[first : first + len(group), 1] = sizes
            self.memory.update(zip(group, range(first, first + len(group))))
            self.used += len(ids)
            self.held += sum(map(len, group))

    def _marked(self, words: list[str]) -> list:
        """The words that hold the mark, encoded each by itself."""
        group = [w for w in words if self.MARK in w]
        if not group:
            return []
        found = self._batch(group)
        return [(group, (np.concatenate(found), np.array([len(x) for x in found], np.int64)))]

    def _looked_up(self, words: list[str]) -> np.ndarray:
        """The number of each word."""
        new = {w for w in words if w not in self.memory}
        if len(self.memory) + len(new) > self.remembered or self.held > self.held_bytes:
            self._forget()
            new = {*words} - {""}
        if new:
            self._learn(sorted(new))
        return np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            found = self._batch(texts.to_pylist())
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        cores, tails = self._cores(coded.dictionary.to_pylist())
        numbers, codes = self._looked_up(cores), coded.indices.to_numpy()
        tails = tails[codes]
        starts, sizes = self.places[numbers][codes].T
        sizes = sizes + (tails >= 0)
        ends = np.cumsum(sizes)
        # A mark taken off is put at the end of its word, where the gathered id isn't its own.
        ids = self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        ids[ends[tails >= 0] - 1] = tails[tails >= 0]
        ends = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(words).to_numpy())]
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[bytes]:
        """The ids of each text and ``end_id`` after them; null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at, width = 0, self.dtype.itemsize
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            until = max(int(np.searchsorted(sizes, before + self.SLICE, side="right")), at + 1)
            ids, lengths = self._slice(texts.slice(at, until - at))
            data, ends = np.insert(ids, np.cumsum(lengths), end_id).tobytes(), np.cumsum(lengths + 1) * width
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield data[a:b]
            at = until


@functools.cache
def encoder(path: str | None, remembered: int = REMEMBERED) -> Encoder:
    """One in each Python worker, which keeps it as long as it lives."""
    return Encoder(path, remembered)
