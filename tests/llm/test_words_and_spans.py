"""Spelling variants, ranked search and personal data against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from accessloom.llm import lexical, pii, spelling
from tests.llm.test_operators import SCHEMA, given, odd, rows_of, table  # noqa: F401

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_spelling(docs, damage=97):
    n = Counter()
    for number, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (a, b), words in holes.items():
        for w in words:
            near[w] |= words - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return Counter(out)


SPELLING = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling(table):  # noqa: F811
    df, docs = table
    assert rows_of(spelling.spelling_groups(df, damage=97), *SPELLING) == brute_spelling(docs)


def test_spelling_of_long_and_near_words(spark):
    rng = random.Random(3)
    base = ["aabbb", "abbbb", "aabb", "éèêëe", "x" * 63, "x" * 64, "x" * 65, "x" * 66, "y" * 200]
    base += ["".join(rng.choices("abcé", k=k)) for k in (5, 6, 7, 62, 63, 64, 65, 66, 300) for _ in range(4)]
    words = []
    for w in base:
        words += [w] * rng.randint(3, 9)
        for _ in range(6):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "b" + w[i + 1 :]])] * rng.randint(2, 30)
    rng.shuffle(words)
    docs = [(i, " ".join(words[i::9])) for i in range(9)] + [(None, None), (3, ""), (3, "1 2 3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute_spelling(docs, None)
    assert rows_of(spelling.spelling_groups(df), *SPELLING) == want
    assert sum(w[2] != w[1] and w[1] is not None for w in want) > 0  # chains of forms
    shorter = spelling.spelling_groups(df, shortest=2, least=1, factor=3)
    assert shorter.count() == len(set(words))


def test_hashed_keys_equal_written_ones():
    """Hashes of keys are equal exactly where the keys are."""
    words = ["ababababab", "babababab", "ababababa", "abababaab", "aaaaaaaaaa", "aaaaaaaaa"]
    seen = {}
    for w in words:
        whole, cut = spelling.hashed_keys(w)
        for i in range(len(w) + 1):
            seen.setdefault(w[i:] + "$" + w[:i], set()).add(tuple(whole[i].tolist()))
        for i in range(len(w)):
            seen.setdefault(w[i + 1 :] + "$" + w[:i], set()).add(tuple(cut[i].tolist()))
    assert all(len(h) == 1 for h in seen.values())
    assert len({next(iter(h)) for h in seen.values()}) == len(seen)


def test_roots(spark):
    up = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100 + i, 50) for i in range(300)], "rank long, to long")
    got = {r["rank"]: r["root"] for r in spelling.roots(up).collect()}
    assert got == {**{i: 0 for i in range(1, 40)}, **{100 + i: 50 for i in range(300)}}


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, k=10):
    docs = [(n, Counter(TERM.findall((t or "").translate(SMALL)))) for n, t in docs]
    docs = [(n, c, sum(c.values())) for n, c in docs if c]
    count, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(SMALL)))
        rows = []
        for number, c, n in docs:
            m = 10 + 90 * n * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms if t in c)
            if score > 0:
                rows.append((-score, number is None, number or 0))
        for rank, (score, none, number) in enumerate(sorted(rows)[:k], 1):
            out.append((item, rank, None if none else number, -score))
    return Counter(out)


RANKED = ("item_id", "rank", "doc_id", "score")


def test_search(table, spark, monkeypatch):  # noqa: F811
    df, docs = table
    monkeypatch.setattr(lexical, "SHARD_DOCS", 100)
    monkeypatch.setattr(lexical, "QUERIES", 7)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(docs)[1:2][0] or "" for _ in range(1))[:400]) for i in range(30)]
    items += [(50, None), (51, ""), (None, items[3][1]), (3, items[3][1]), (52, "nowhere and Nothing ÉÀ 12")]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, score long")
    assert rows_of(lexical.ranked_documents(df, asked), *RANKED) == brute_search(docs, items)
    few = lexical.ranked_documents(df, asked, k=2)
    assert rows_of(few, *RANKED) == brute_search(docs, items, 2)


def test_search_with_a_whole_index(odd, spark, monkeypatch):  # noqa: F811
    df, docs = odd
    items = [(i, t) for i, (_, t) in enumerate(docs) if t and len(t) < 2000]
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "WANTED_BYTES", 0)
    assert rows_of(lexical.ranked_documents(df, asked), *RANKED) == brute_search(docs, items)


def test_texts_cut_in_slices():
    """Slices of a column give the terms that the whole column gives."""
    texts = [f"Some TEXT no {i} é" * (i % 5) for i in range(50)] + [None, ""]
    whole = pa.array(texts)
    n, _, _, _ = lexical._counted(whole, None)
    for lo in (1, 7, 33):
        assert lexical._counted(whole.slice(lo, 15), None)[0].tolist() == n[lo : lo + 15].tolist()


@pytest.mark.parametrize("seed", range(6))
def test_blocks_are_skipped_and_results_whole(seed):
    rng = np.random.default_rng(seed)
    size, lists, total = 3000, [], np.zeros(3000, np.int64)
    for i in range(8):
        docs = np.flatnonzero(rng.random(size) < [0.01, 0.9, 0.3, 0.02, 0.6, 0.001, 0.5, 0.05][i])
        impact = rng.integers(1, 4 if seed % 2 else 900, len(docs))
        weight = int(rng.integers(1, 2 if seed % 2 else 50)) * (1 if i in (1, 2, 4, 6) else 40)
        cut = range(0, len(docs), lexical.BLOCK)
        blocks = [lexical.pack(docs[a : a + lexical.BLOCK], impact[a : a + lexical.BLOCK]) for a in cut]
        if len(docs):
            lists.append(lexical.PostingList(
                weight, int(impact.max()), [docs[min(a + lexical.BLOCK, len(docs)) - 1] for a in cut],
                [impact[a : a + lexical.BLOCK].max() for a in cut], blocks))
            total[docs] += weight * impact
    want = sorted((-s, d) for d, s in enumerate(total.tolist()) if s)[:10]
    docs, scores = lexical.best_documents(lists, size, 10, 256)
    assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist())] == want
    if seed % 2 == 0:
        assert sum(len(x.known) for x in lists) < sum(len(x.blocks) for x in lists)  # some never decompressed


def brute_spans(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m.group())
        total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(d[::-1]))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_of_hostile_texts():
    rng = random.Random(8)
    alphabets = ["a.@b-1", "0123.", "01 -", "+1 ().-9", "a@b.c%+ 12-3", "4 -1", "é@.a1+😀 "]
    for _ in range(4000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60)))
        got = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)]
        assert got == brute_spans(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "a@" * 200_000, "1" * 400_000, "1." * 200_000, "1-" * 200_000, "+1 " * 130_000,
                 "a.b" * 130_000 + "@", "x at " * 80_000, "1:" * 200_000, "(1" * 200_000, " (at) a" * 60_000):
        pii.proposals(text)


def test_personal_data(table):  # noqa: F811
    df, docs = table
    got = pii.personal_data(df).collect()
    want = Counter((n, hashlib.sha256(joined(s := brute_spans(t)).encode()).hexdigest(), *(sum(x[0] == k for x in s) for k in pii.KINDS)) for n, t in docs)
    assert Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    by = dict(docs)
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
        if docs.count((r["doc_id"], by[r["doc_id"]])) == 1 and [n for n, _ in docs].count(r["doc_id"]) == 1:
            assert {joined([s]) for s in brute_spans(by[r["doc_id"]])} <= set(spans)


def corpus(rng, rows):
    """Texts with base spans, wide personal data and numbers that are none."""
    word = lambda: rng.choice(["der", "thing", "elle", "casa", "onto", "wind", "red"])
    say = lambda n: " ".join(word() for _ in range(n))
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    docs, truth = [], {}
    for i in range(rows):
        kind = i % 8
        wide = {
            0: ("phone", f"call ({rng.randint(200, 999)}) 555-{d(4)}"), 1: ("phone", f"+{rng.choice([1, 44, 49])} {d(3)} {d(7)}"),
            2: ("email", f"write to {word()}{d(2)} (at) {word()} (dot) com"), 3: ("email", f"email {word()}@{word()}.org"),
            4: (None, f"serial {d(4)}/{d(3)}.{d(5)}"), 5: ("ip", f"host {rng.randint(11, 223)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(10, 255)}"),
            6: ("ip", f"from {rng.randint(11, 223)}[.]{rng.randint(10, 255)}[.]{rng.randint(10, 255)}[.]{rng.randint(10, 255)}"),
            7: (None, say(4)),
        }[kind]
        docs.append((i, f"{say(8)} {wide[1]} {say(6)}"))
        truth[i] = wide[0]
    return docs, truth


def test_added_spans(spark):
    """Wide spans that the labelers agree on are added, others and clean texts left alone."""
    docs, truth = corpus(random.Random(4), 1600)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    caught = Counter()
    for i, kind in truth.items():
        if kind is None:
            assert rows[i]["spans"] == ""
        else:
            caught[i % 8] += rows[i]["spans"].startswith(kind + ":")
    assert {k: v / 200 for k, v in caught.items()} == pytest.approx({0: 1, 1: 1, 2: 1, 3: 1, 5: 1, 6: 1}, abs=0.05)
    again = {r["doc_id"]: r for r in pii.personal_data(df.repartition(2)).collect()}
    assert rows == again  # however rows lie


def test_reliabilities():
    """Made votes: known reliabilities are found again."""
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    cols = [np.where(rng.random(len(truth)) < 0.2, "0", np.where((rng.random(len(truth)) < p) == truth, "+", "-")) for p in right]
    counts = Counter("".join(v) for v in zip(*cols))
    share, given, true = pii.reliabilities(counts)
    assert share == pytest.approx(0.3, abs=0.02)
    for j, p in enumerate(right):
        assert given[1, j, 2] == pytest.approx(0.8 * p, abs=0.03) and given[0, j, 0] == pytest.approx(0.8 * p, abs=0.03)
    assert true["+++++"] > 0.99 and true["-----"] < 0.01


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert spelling.spelling_groups(empty).isEmpty()
    assert lexical.ranked_documents(empty, items).isEmpty()
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical.ranked_documents(some, items.limit(0)).isEmpty()
    assert pii.personal_data(empty).isEmpty()


def test_refused(spark):
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        spelling.spelling_groups(some, factor=1)
    with pytest.raises(ValueError):
        pii.personal_data(some, threshold=1.0)
