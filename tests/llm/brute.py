"""Plain answers on small tables: no Spark, no cleverness."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def ids(text):
    return _TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def pieces(docs, capacity=4096):
    """(doc_id, piece, start, length, crc) of every document, as a multiset."""
    out = []
    for number, text in docs:
        whole = ids(text) + [1]
        for piece, at in enumerate(range(0, len(whole), capacity)):
            part = whole[at : at + capacity]
            out.append((number, piece, at, len(part), crc(part)))
    return out


def token_counts(docs, limit=2048):
    return [(n, len((t or "").encode()), len(i := ids(t)), len(i) > limit) for n, t in docs]


def token_rows(docs):
    out, start = [], 0
    for number, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        whole = ids(text) + [2]
        out.append((number, start, len(whole), crc(whole)))
        start += len(whole)
    return out


def held_out(number, parts):
    return zlib.crc32(("" if number is None else str(number)).encode()) % parts == 1


def base_scores(docs):
    tokens = [words(t) + ["\n"] for _, t in docs]
    count = Counter(w for (n, _), ws in zip(docs, tokens) if not held_out(n, 5) for w in ws)
    total, distinct = sum(count.values()), len(count)
    below = total + 0.5 * (distinct + 1)
    return [
        (n, held_out(n, 5), len(ws), sum(count[w] > 0 for w in ws), total,
         sum(math.log10((count[w] + 0.5) / below) for w in ws))
        for (n, _), ws in zip(docs, tokens)
    ]


def repeats(texts, window=200):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    texts = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for at in range(len(t) - window + 1):
            places[t[at : at + window]].append((i, at))
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                gone[i][at : at + window] = True
    out = []
    for t, g in zip(texts, gone):
        rest = bytes(np.frombuffer(t, np.uint8)[~g])
        runs = int((np.diff(np.concatenate([[0], g.astype(int), [0]])) == 1).sum())
        out.append((len(t), int(g.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def _smallest(n, links, numbers):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[top(a)] = top(b)
    least = {}
    for i in range(n):
        if numbers[i] is not None:
            least[top(i)] = min(least.get(top(i), numbers[i]), numbers[i])
    return [least.get(top(i)) for i in range(n)]


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs):
    sets = [shingle_set(t) for _, t in docs]
    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    shared = Counter()
    for found in by_shingle.values():
        shared.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    numbers = [n for n, _ in docs]
    least = _smallest(len(docs), links, numbers)
    return [(n, len(s), c, n is not None and n == c) for (n, _), s, c in zip(docs, sets, least)]


def vectors(rows, threshold=0.98):
    """rows of (vec_id, embedding, label)"""
    good, groups = {}, defaultdict(list)
    for i, (_, v, label) in enumerate(rows):
        if label is None or v is None or not len(v) or any(x is None for x in v):
            continue
        v = np.array(v, float)
        if np.isfinite(v).all() and v.any():
            good[i] = v
            groups[label, len(v)].append(i)
    links = []
    for members in groups.values():
        m = np.stack([good[i] / np.abs(good[i]).max() for i in members])
        norm = np.linalg.norm(m, axis=1)
        cos = (m @ m.T) / np.outer(norm, norm)
        a, b = np.nonzero(np.triu(cos >= threshold - 1e-12, 1))
        links += [(members[x], members[y]) for x, y in zip(a, b)]
    count = Counter(x for link in links for x in link)
    numbers = [r[0] for r in rows]
    least = _smallest(len(rows), links, numbers)
    return [(n, count[i], least[i], n is not None and n == least[i]) for i, n in enumerate(numbers)]


def quality_figures(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), failed)


def fill(sizes, weights=(5, 2, 1)):
    """Targets by source: dealt by weight, capped, dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, due = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = due / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            due -= target[s]
        open_ -= full
    return target
