"""Every operator against brute force, on given tables and on odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

import __spark_entry__ as entry
from accessloom.llm import (
    embed_dedup, lang_id, lm_score, mixing, near_dedup, packing, quality, suffix_dedup, token_count, token_files,
)
from accessloom.llm import components as components_of
from accessloom.llm.common import stored
from accessloom.llm.components import components
from tests.llm import brute

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("n_tokens", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("uid", T.StringType()), T.StructField("size", T.StringType()),
])


def odd_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = say(120), say(70)
    texts = [
        None, None, "", "  \n\t", "one two", "one two", "One  TWO", "a b c d e", "e d c b a",
        base, base, base, base.upper(), base + " tail", "head " + base, base.replace(base.split()[50], "changed"),
        say(40) + "\n" + passage + "\n" + say(30), passage + " " + say(60), say(50) + " " + passage,
        "x" * 5000, "x" * 700, "ab" * 900, "ab" * 901 + "c", "é" * 400, "é" * 400 + "!",
        "word word x \x1c y", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "J̌ İ don't we'll 12,5%",
        "same line here\n" * 30, "| # * $ | " * 20, "SHOUT!! " * 40, "12 34 56 " * 30,
        say(9000), " ".join(say(30) for _ in range(30)), base + "\n" + say(10) + "\n" + passage,
        "日本語 テキスト и русский текст", "\u0000 nul", "😀 smile 😀",
    ]
    rows = [(i * 7 - 20, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [(None, base, "de", None, 1), (None, say(20), None, "s1", 1), rows[9], rows[9], rows[15], rows[1]]
    return [(*r, "x", None, "u", "0") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["odd", "given"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_packing(table):
    df, docs = table
    packed = packing.pack_documents(df, shard_pieces=16).collect()
    got = Counter(
        (r["doc_id"], r["piece"], r["start"], r["length"], token_files.ids_crc32(r["ids"], r["id_bytes"])) for r in packed)
    assert got == Counter(brute.pieces(docs))
    used = defaultdict(list)
    for r in packed:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r["length"] for r in packed) // 4096)
    assert len(used) <= least * 1.03 + 1


def test_packed_sequences(odd):
    df, docs = odd
    packed = packing.pack_documents(df.limit(9), capacity=64)
    for r in packing.packed_sequences(packed).collect():
        assert len(r["ids"]) == 2 * sum(p["length"] for p in r["pieces"])
        assert [p["offset"] for p in r["pieces"]] == np.cumsum([0] + [p["length"] for p in r["pieces"]][:-1]).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_local_search(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [4096, 1500, 300, 2100][seed], 300)
    first = packing.best_fit(lengths, 4096)
    bins = packing.local_search([list(b) for b in first], lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert max(lengths[b].sum() for b in bins) <= 4096 and len(bins) <= len(first)


def test_local_search_exchanges():
    # Best fit makes 3 bins of these; exchanging 3 for 4 empties one.
    lengths = np.array([4, 4, 3, 3, 3, 3])
    assert len(packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 10)) == 2


def test_token_counts(table):
    df, docs = table
    got = token_count.count_tokens(df)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter(brute.token_counts(docs))
    assert "text" not in got.columns and "source" in got.columns


def test_merges_of_one_long_piece():
    texts = ["a" * 3000, "abc" * 2000, "thethe" * 500 + "é" * 100]
    assert token_count.MergeCounter().counts(pa.array(texts)).tolist() == [len(brute.ids(t)) for t in texts]


def test_token_files(spark, table, tmp_path):
    df, docs = table
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, block_bytes=4000, partitions=3)
    got = token_files.read_token_files(spark, path, digest=True).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got][:-1]).tolist()
    numbers = [r["doc_id"] for r in got]
    assert numbers == sorted(numbers, key=lambda n: (n is not None, n or 0))
    want = brute.token_rows(docs)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((a, c, d) for a, _, c, d in want)
    texts = dict(docs)
    if len(texts) == len(docs):
        assert [(r["doc_id"], r["start"]) for r in got] == [(a, b) for a, b, _, _ in want]
    whole = token_files.read_token_files(spark, path).collect()
    assert Counter((r["doc_id"], token_files.ids_crc32(r["ids"], r["id_bytes"])) for r in whole) == Counter(
        (a, d) for a, _, _, d in want)
    for block in spark.read.schema(token_files.BLOCK_SCHEMA).parquet(path).limit(3).collect():
        block = block.asDict(recursive=True)
        parts = [token_files.document(block, i) for i in range(block["n_docs"])]
        assert b"".join(parts) == block["ids"]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 5), (500, 3), (500, 10**6), (777, 2**40), (65, 2**62)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    coded = token_files.EliasFano.of(values)
    assert [coded.select(i) for i in range(n)] == values.tolist()
    if n:
        assert coded.all().tolist() == values.tolist()
        assert len(coded.low) + len(coded.high) <= n * (2 + max(1, top // n).bit_length()) / 8 + 2


def test_lm_scores(table):
    df, docs = table
    got = lm_score.score_texts(df).collect()
    want = brute.base_scores(docs)
    plain = lambda n, h, t, k, total, base: (n, h, t, k, total, round(base, 6))
    assert Counter(plain(*(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"))) for r in got
                   ) == Counter(plain(*w) for w in want)
    assert all(r["score"] < 0 for r in got)


def test_lm_classes_know_rare_texts(spark):
    rng, usual = random.Random(4), [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(usual, k=12))) for i in range(12_000)]
    docs += [(20_000 + i, f"alpha{i} beta{i} " + "gamma delta " * 6) for i in range(12)]
    parts, _ = lm_score.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert set(parts["classes"].words) == {w.encode() for _, t in docs for w in t.split()} | {lm_score.END}
    assert parts["classes"].of([b"gamma", b"delta"] * 6) != parts["classes"].of([w.encode() for w in usual[:12]])


def test_lm_scores_do_not_depend_on_lists(given, monkeypatch):
    got = lambda: {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm_score.score_texts(given[0]).collect()}
    want = got()
    monkeypatch.setattr(lm_score, "COMMON", 7)
    few = got()
    assert few.keys() == want.keys() and all(few[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_lm_counts_are_exact(given, monkeypatch):
    for name, few in (("BATCH_WORDS", 50), ("CHUNK", 100), ("PART", 2000)):
        monkeypatch.setattr(lm_score, name, few)
    docs, texts = given
    parts, _, _, table = lm_score._trained(docs.withColumn("learn", lm_score.F.lit(True)))
    want, last = Counter(), defaultdict(Counter)
    for _, t in texts:
        words = lm_score._tokens((t or "").encode())
        k = parts["classes"].of(words)
        for w in words:
            w = w if w == lm_score.END else w + b" "
            want.update((k, w[:i], w[i]) for i in range(len(w)))
            for i in range(len(w)):
                last[k, w[:i][-3:], i >= 3][w[i]] += 1
    rows = table.toArrow()
    found, three = [], {}
    chunks = (chunk for some, _ in lm_score._opened(rows.to_batches()) for chunk in some)
    for number, (context, byte, n, long) in enumerate(chunks):
        found += n.tolist()
        for c, b, x in zip(lm_score.shorter(context, 3).tolist(), byte.tolist(), long[0][:, 7].tolist()):
            assert three.setdefault((c, b), (number, x)) == (number, x)  # one chunk has all of a context
    assert rows.num_rows > 10 and sorted(found) == sorted(want.values())
    assert sorted(x[b & 1] for (_, b), (_, x) in three.items()) == sorted(n for c in last.values() for n in c.values())


def test_lm_common_endings_are_split_and_counted_whole(given, monkeypatch):
    def counts():
        table = lm_score._trained(given[0].withColumn("learn", lm_score.F.lit(True)))[3].toArrow()
        found, tails = {}, defaultdict(set)
        for number, (chunks, _) in enumerate(lm_score._opened(table.to_batches())):
            nodes = np.frombuffer(table.column("node")[number].as_py(), "<i8")
            at = 0
            for context, byte, n, long in chunks:
                for i in range(len(byte)):
                    found[int(nodes[at]), int(byte[i])] = (int(n[i]), *(t[i].tolist() for t in long))
                    tails[int(lm_score.shorter(context, 3)[i])].add(number)
                    at += 1
        return found, max(map(len, tails.values()))

    monkeypatch.setattr(lm_score, "PART", 2000)
    want, parts = counts()
    assert parts == 1
    monkeypatch.setattr(lm_score, "HOT", 5)
    got, parts = counts()
    assert parts > 1 and got == want


def test_lm_edges_travel_in_bundles(given, monkeypatch):
    """A row a batch, then a row for each ending that a task holds; hot ones also by context and node."""
    monkeypatch.setattr(lm_score, "BATCH_WORDS", 500)
    batched = lm_score._trained(given[0].withColumn("learn", lm_score.F.lit(True)))[2]
    edges = lm_score._edges(batched).coalesce(1)
    flat = lambda df: [np.concatenate(c) for c in zip(*map(lm_score._unbundled, df.toArrow().to_batches()))]
    rows = lambda columns: sorted(zip(*(c.tolist() for c in columns)))
    want = flat(edges)
    assert edges.count() == batched.count() < len(want[0]) // 100
    tails, n = np.unique(lm_score.shorter(want[0], 3), return_counts=True)
    sums, got = Counter(), Counter()
    for t, b, x in zip(lm_score.shorter(want[0], 3).tolist(), want[2].tolist(), want[3].tolist()):
        sums[t, b, "n"] += x
        sums[t, b, "edges"] += 1
    for r in lm_score._summed(edges, 3).collect():
        got.update({(r["tail"], r["byte"], c): r[c] for c in ("n", "edges")})
    assert got == sums
    none = np.empty(0, np.int64)
    dealt = lm_score._by_ending(edges, none, none)
    assert dealt.count() == len(tails) and rows(flat(dealt)) == rows(want)
    hot = tails[np.argsort(-n)[:3]]
    inside = np.isin(lm_score.shorter(want[0], 3), hot)
    common = want[0][inside][:1]
    dealt = lm_score._by_ending(edges, hot, common)
    assert rows(flat(dealt)) == rows(want)
    keys = {(t, c if t in hot else None, x if c in common else None)
            for t, c, x in zip(lm_score.shorter(want[0], 3).tolist(), want[0].tolist(), want[1].tolist())}
    assert {(r["tail"], r["context"], r["node"]) for r in dealt.select("tail", "context", "node").collect()} == keys
    assert rows(flat(lm_score._by_ending(edges, hot, none, only=True))) == rows([c[inside] for c in want])


def test_lm_scores_are_the_same_however_rows_lie(spark, given):
    scores = lambda df: {r["doc_id"]: r["score"] for r in lm_score.score_texts(df).collect()}
    want = scores(given[0].repartition(1))
    got = scores(given[0].repartition(7).sortWithinPartitions(lm_score.F.desc("doc_id")))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_lm_beats_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm_score.score_texts(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_scores_depend_on_the_order_of_words(spark):
    docs = [(i, "the cat sat on a red mat " * 3) for i in range(60)]
    docs += [(1000, "the cat sat on a red mat"), (1001, "mat red a on sat cat the")]
    got = {r["doc_id"]: r for r in lm_score.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1000]["score"] > got[1001]["score"] + 5


def test_lm_edges_between_words_are_exact(table, monkeypatch):
    monkeypatch.setattr(lm_score, "CROSSINGS_HELD", 50)
    docs, texts = table
    parts = lm_score._trained(docs.withColumn("learn", lm_score.F.lit(True)))[0]
    want, three = Counter(), Counter()
    for _, t in texts:
        words = lm_score._tokens((t or "").encode())
        k, before = parts["classes"].of(words), b""
        for w in words:
            w = w if w == lm_score.END else w + b" "
            for i in range(min(len(w), lm_score.CROSSING)):
                last = (before + b" " + w[:i])[-5:]
                number = k * lm_score.SPAN + sum((b + 1) * lm_score.DIGIT**j for j, b in enumerate(reversed(last)))
                want[number, w[i]] += 1
                three[int(lm_score.shorter(np.int64(number), 3)), w[i]] += 1
            before = (before + b" " + w[:-1])[-5:]  # a text begins with a blank
    found = {}
    for chunks, _ in lm_score._opened(parts["crossings"].toArrow().to_batches()):
        for context, byte, n, long in chunks:
            for i in range(len(byte)):
                key = int(context[i]), int(byte[i])
                assert key not in found
                found[key] = int(n[i])
                assert long[0][i, 7, byte[i] & 1] == three[int(lm_score.shorter(context[i], 3)), byte[i]]
                assert long[1][i, 7, byte[i] & 1] == n[i]
    assert found == want


def test_lm_counts_travel_in_bundles(spark, given):
    """Words and edges between them are counted in one pass, in as many rows as parts, and with the sums of all classes."""
    docs, texts = given
    cuts = lm_score.stored(lm_score._cuts(docs.repartition(3).withColumn("learn", lm_score.F.expr("doc_id % 5 <> 1"))), "cuts")
    listed = {lm_score.END: 0, b"the": 1}
    classes = lm_score.Classes(listed, np.zeros(lm_score.CLASSES), np.array([[0.0] * 6, [1.0] + [0.0] * 5]))
    rows = lm_score._counted(cuts, classes)
    found = rows.where("word IS NOT NULL").collect()
    got = {(r["class"], bytes(r["word"])): (r["n"], r["uses"]) for r in found}
    n, uses, total = Counter(), Counter(), Counter()
    for i, t in texts:
        words = lm_score._tokens((t or "").encode())
        k = classes.of(words)
        uses.update((k, w) for w in words)
        if i is not None and i % 5 != 1:
            n.update((k, w) for w in words)
            total.update(words)
    assert len(got) == len(found) and got == {x: (n[x], uses[x]) for x in uses}
    assert all(r["total"] == total[bytes(r["word"])] for r in found)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Aggregate" not in plan  # no row travels for each word
    assert rows.where("edges IS NOT NULL").count() <= 1 + cuts.count() // 2


def test_lm_words_of_one_hash_are_told_apart():
    words = lm_score.pa.array([b"a", b"b", b"a", b"c", b"b"], lm_score.pa.large_binary())
    ones = np.ones(5, np.int64)
    counts = lm_score.Counts(np.array([0, 0, 0, 1, 1]), words, np.zeros(5, np.uint64), ones, ones)
    got, total = lm_score.Counts.added([counts, counts])
    assert sorted(zip(got.k.tolist(), got.words.to_pylist(), got.n.tolist(), total.tolist())) == [
        (0, b"a", 4, 4), (0, b"b", 2, 4), (1, b"b", 2, 4), (1, b"c", 2, 2)]
    hashes = lm_score.word_hashes(words)
    assert hashes[0] == hashes[2] and len({*hashes.tolist()}) == 3


def test_lm_scores_do_not_depend_on_listed_edges(given, monkeypatch):
    got = lambda: {r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in lm_score.score_texts(given[0]).collect()}
    want = got()
    monkeypatch.setattr(lm_score, "COMMON_CROSSINGS", 7)
    few = got()
    assert few.keys() == want.keys() and all(few[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_lm_probabilities_sum_to_one(spark, odd):
    parts, _ = lm_score.train(odd[0])
    model = lm_score.Model(**parts["model"]).prepared()
    # one bit after another: the probability of 0 and 1 after the same context sum to 1, so all
    # one-byte beginnings do, too
    bits = lm_score.Bits([b"b", b"c"], np.array([0, 0]))  # they differ in the last bit of the first byte
    found, gate = model.inputs(bits)
    p = model.refine(model.mix(found, gate), gate).reshape(-1, 8)
    assert np.allclose(p[0, :8], p[2, :8]) and ((p > 0) & (p < 1)).all()


def test_lm_scores_long_words(spark):
    long = ["日本語" * 33_334, "".join(random.Random(2).choices("abcdefgh+/", k=300_000))]  # 300,006 and 300,000 bytes
    docs = [(i, t) for i, t in enumerate([*long, "a few words", long[0] + " " + long[1], *["so it is"] * 8])]
    got = lm_score.score_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == {(i, len(t.split()) + 1) for i, t in docs}
    scores = {r["doc_id"]: r["score"] for r in got}
    assert all(np.isfinite(s) and s < 0 for s in scores.values()) and scores[1] < 100 * scores[2]


def test_suffix_dedup(table):
    df, docs = table
    got = rows_of(suffix_dedup.without_repeats(df, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((n, *r) for (n, _), r in zip(docs, brute.repeats([t for _, t in docs])))


def test_suffix_dedup_splits_a_common_anchor(spark, monkeypatch):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    docs = []
    for i in range(60):
        left, right = ("".join(rng.choices("ijklmn ", k=rng.randint(0, 300))) for _ in range(2))
        docs.append((i, left + passage[: rng.choice([230, 240, 260])] + right))
    monkeypatch.setattr(suffix_dedup, "REGIONS", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(suffix_dedup.without_repeats(df, digest=True), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((n, *r) for (n, _), r in zip(docs, brute.repeats([t for _, t in docs])))


def test_bucket_pointers():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab", k=rng.randint(20, 60))).encode() for _ in range(20)] + [b"a" * 50] * 2
    numbers = suffix_dedup.equal_windows(texts, window=20, gram=4)
    named, seen = {}, {}
    for t, found in zip(texts, numbers):
        assert len(found) == len(t) - 19
        for at, x in enumerate(found.tolist()):
            assert named.setdefault(x, t[at : at + 20]) == t[at : at + 20]
            assert seen.setdefault(t[at : at + 20], x) == x


def test_suffix_dedup_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 900)
    rng = random.Random(3)
    base = "".join(rng.choices("abcdefghij", k=5000))
    texts = [base, base[700:3000] + "Z" + base[3000:3600], "q" * 3000]
    found = defaultdict(list)
    for r in suffix_dedup._regions(spark.createDataFrame(list(enumerate(texts)), "h long, text string"), False).collect():
        found[r["h"]] += range(r["first"], r["last"] + 1)
    assert all(sorted(found[i]) == list(range(len(t) - 199)) for i, t in enumerate(texts))


def test_quality(table):
    df, docs = table
    got = quality.quality_report(df)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got, *names) == Counter((n, *brute.quality_figures(t)) for n, t in docs)
    assert got.where("base_failed AND kept").isEmpty()
    verdict = quality.cascade(df)
    assert verdict.where("kept").count() == got.where("kept").count()
    assert verdict.where("kept = (rejected_by IS NOT NULL)").isEmpty()
    assert quality.cascade(df, quality.RULES[::-1]).where("kept").count() == got.where("kept").count()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r for r in got if r["lang_pred"] == r["lang"]]
    assert len(right) > 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_languages_of_odd_rows(odd):
    df, docs = odd
    got = lang_id.predict_languages(df).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((n, brute.held_out(n, 3)) for n, _ in docs)
    letters = Counter((n, not lang_id.has_letter(t)) for n, t in docs)
    assert Counter((r["doc_id"], r["lang_pred"] == "und") for r in got) == letters


def test_temperature():
    rng = np.random.default_rng(0)
    true = rng.normal(size=(4000, 3))
    p = np.exp(true) / np.exp(true).sum(axis=1, keepdims=True)
    labels = (p.cumsum(axis=1) > rng.random((4000, 1))).argmax(axis=1)
    assert abs(lang_id.temperature(true * 5, labels) - 5) < 0.5


def test_near_documents(table):
    df, docs = table
    got = rows_of(near_dedup.near_documents(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter(brute.near(docs))
    left = near_dedup.without_near_copies(df)
    assert left.columns == df.columns
    roots = brute.near(docs)
    lone = sum(1 for r in roots if r[1] == 0)
    groups = {r[2] for r in roots if r[1] and r[2] is not None}
    nameless = sum(1 for r in roots if r[1] and r[2] is None)
    assert left.count() == lone + len(groups) + nameless


def test_chains_of_near_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    docs, text = [], [word() for _ in range(200)]
    for i in range(90):
        docs.append((i, " ".join(text)))
        at = rng.randrange(200)
        text = text[:at] + [word()] + text[at + 1 :]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(near_dedup.near_documents(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter(brute.near(docs))


def test_vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        v = rng.normal(size=12) if i % 3 or not rows else rows[-1][1] + rng.normal(size=12) * 0.06
        rows.append((i, v, i % 3 // 2))
    rows = [(n, [float(np.float32(x)) for x in v], y) for n, v, y in rows]
    rows += [rows[3], rows[4], (None, rows[5][1], 0), (900, None, 0), (901, [], 0), (902, [0.0] * 12, 0), (903, [1.0, None], 0),
             (904, [float("nan")] * 12, 1), (905, [float("inf"), 1.0], 1), (906, rows[5][1], None), (907, [1.0], 0),
             (908, [2.0], 0), (909, [1e30] * 12, 1), (910, [1e-30] * 12, 1), (911, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = rows_of(embed_dedup.near_vectors(df, tile=40), "vec_id", "n_links", "component_id", "kept")
    want = [(n, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for n, v, y in rows]
    assert got == Counter(brute.vectors(want))


def test_quantised_bound():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(50, 30)), rng.normal(size=(60, 30))
    ua, ub = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
    qa, sa, ea, ha = embed_dedup.quantised(ua)
    qb, sb, eb, hb = embed_dedup.quantised(ub)
    rough = (qa @ qb.T) * np.outer(sa, sb)
    assert (np.abs(rough - ua @ ub.T) <= np.outer(ea, hb) + eb[None, :] + 1e-9).all()
    cos = ua @ ub.T
    assert (embed_dedup.tile_links(a, b, 0.3) == (cos >= 0.3)).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200, x) for x in range(210, 260)]
    links += [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    least = brute._smallest(341, links, list(range(341)))
    assert got == {n: least[n] for link in links if link[0] != link[1] for n in link}


def test_component_rounds_make_few_files(spark, monkeypatch):
    """However many partitions their shuffles have."""
    made = []
    monkeypatch.setattr(components_of, "stored", lambda *x: made.append(stored(*x)) or made[-1])
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in zip(names, ("40", "false")):
            spark.conf.set(n, value)
        got = dict(components(spark.range(300).selectExpr("id a", "id + 1 - id % 3 % 2 b")).collect())
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert got and len(made) > 2
    assert max(len(df.inputFiles()) for df in made[1:]) <= components_of.FEW_FILES


def test_pieces_are_the_same_however_few_words_are_remembered(table):
    pieces = lambda **x: {r["uid"]: r for r in packing.token_pieces(table[0], **x).collect()}
    assert pieces(remembered=3) == pieces()


def test_mixing(table):
    df, docs = table
    sources = Counter()
    got = mixing.mix(df).collect()
    for r in got:
        sources[r["source"]] += r["size"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((n, len(brute.words(t))) for n, t in docs)
    want, taken = brute.fill(sources), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sources[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for source, words in taken.items():
        assert abs(words - want[source]) <= 130
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(5)).collect()))


def test_mixed_documents(table):
    df, docs = table
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken, made = Counter(), Counter()
    for r in mixing.mix(df).collect():
        taken[r["doc_id"]] += r["taken"]
    for r in out.collect():
        made[r["doc_id"]] += len(brute.words(r["text"]))
    assert +taken == +made


def test_quotas_are_of_highest_quotients(spark):
    rows = [("a", 1, 64000, 100_000.0), ("b", 2, 6400, 12_800.0), ("c", 3, 20000, 7_000.0), ("d", 4, 10, 20.0), (None, 5, 0, 0.0)]
    df = spark.createDataFrame(rows, "source string, place int, source_size long, target double")
    table = mixing.quotas(df, shards=4).collect()
    due = {r["place"]: r["target"] * r["blocks"] / max(r["source_size"], 1) for r in table}
    for shard in range(1, 5):
        seats = Counter()
        house = round(sum(x * shard / 4 for x in due.values()))
        for _ in range(house):
            seats[max(due, key=lambda p: (due[p] / (2 * seats[p] + 1), -p))] += 1
        assert {r["place"]: r["seats"] for r in table if r["shard"] == shard} == {p: seats[p] for p in due}
    for r in table:
        assert r["quota"] >= 0


def test_quotas_of_many_sources(spark):
    """Equal quotients, sources of one word and one that holds most, against all quotients sorted."""
    rng = np.random.default_rng(5)
    sizes = [1, 64, 64, 6400, 6400, 2_000_000] + rng.integers(0, 3000, 300).tolist()
    rows = [(f"s{p}", p, int(n), float(n * (1 + p % 5) / 3)) for p, n in enumerate(sizes, 1)]
    rows = [(s, p, n, min(t, 2.0 * n)) for s, p, n, t in rows]
    table = mixing.quotas(spark.createDataFrame(rows, "source string, place int, source_size long, target double"), shards=3)
    table = table.collect()
    due = {r["place"]: (r["target"] * r["blocks"] / r["source_size"] if r["source_size"] else 0.0, r["blocks"]) for r in table}
    order = sorted((-u / (2 * k - 1), p, k) for p, (u, n) in due.items() if u for k in range(1, 2 * n + 1))
    for shard in (1, 2, 3):
        house = int(sum(u for u, _ in due.values()) * shard / 3 + 0.5)
        seats = Counter(p for _, p, _ in order[:house])
        assert {r["place"]: r["seats"] for r in table if r["shard"] == shard} == {p: seats[p] for p in due}


def test_shards_have_their_quotas(table):
    """Each shard's rows hold the words said of it, of each document, near its share of the target."""
    df, _ = table
    said, made, wanted = Counter(), Counter(), {}
    for r in mixing.mix(df, by_shard=True, shards=3).collect():
        assert sum(r["shard_words"]) == r["taken"] and len(r["shard_words"]) == 3
        wanted[r["source"]] = r["target"]
        for shard, n in enumerate(r["shard_words"], 1):
            said[r["doc_id"], r["source"], shard] += n
    out = mixing.mixed_documents(df, shard="source_shard", shards=3)
    assert out.columns == [*df.columns, "source_shard"]
    for r in out.collect():
        made[r["doc_id"], r["source"], r["source_shard"]] += len(brute.words(r["text"]))
    assert +said == +made
    for source, target in wanted.items():
        for shard in (1, 2, 3):
            words = sum(n for (_, s, k), n in said.items() if (s, k) == (source, shard))
            assert abs(words - target / 3) <= 200


def test_mixing_spreads_one_id(spark):
    docs = spark.createDataFrame([(None if i % 3 else 7, "s", f"word{i} and more") for i in range(300)],
                                 "doc_id long, source string, text string")
    placed = mixing._placed(docs, "source", "text", "doc_id", {}).collect()
    assert sorted(r["begins"] for r in placed) == list(range(0, 900, 3))
    spread = docs.select(mixing._seeded("mix", docs["doc_id"], docs["text"]).substr(1, 3).alias("slice"))
    assert spread.distinct().count() > 200


def test_empty_tables(spark, empty, tmp_path):
    assert packing.pack_documents(empty).isEmpty()
    assert token_count.count_tokens(empty).isEmpty()
    token_files.write_token_files(empty, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).isEmpty()
    assert lm_score.score_texts(empty).isEmpty()
    assert suffix_dedup.without_repeats(empty).isEmpty()
    assert quality.quality_report(empty).isEmpty() and quality.cascade(empty).isEmpty()
    assert lang_id.predict_languages(empty).isEmpty()
    assert near_dedup.near_documents(empty).isEmpty() and near_dedup.without_near_copies(empty).isEmpty()
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_vectors(none).isEmpty()
    assert mixing.mix(empty).isEmpty() and mixing.mixed_documents(empty).isEmpty()


def test_first_key():
    rng = np.random.default_rng(9)
    one = rng.integers(0, 4, 64).astype(np.uint16)
    others = np.where(rng.random((50, 64)) < 0.2, 9, one).astype(np.uint16)
    mine = near_dedup.keys(one[None, :])[0]
    for other, slot in zip(near_dedup.keys(others), near_dedup.first_key(one, others)):
        shared = np.flatnonzero(mine == other)
        if len(shared):
            assert slot == shared[0] == mine[shared[0]] & 63


def test_a_group_around_one_text(spark):
    """Copies that are like their source but not like each other."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    base = [word() for _ in range(300)]
    docs = []
    for i in range(120):
        text = list(base)
        for at in rng.sample(range(300), 8):
            text[at] = word()
        docs.append((i, " ".join(text)))
    docs += [(500, " ".join(base))] + [(600 + i, " ".join([*base[:200], *(word() for _ in range(100))])) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(near_dedup.near_documents(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == Counter(brute.near(docs))


def test_encoder_equals_the_library():
    from accessloom.llm.tokens import Encoder, load

    texts = [
        None, "", "  ", "<|endoftext|> a0 b", "<|ENDOFTEXT|> <|EndOfText|>.", "0 00 a0b 0", "a b\x85c\x1cd\u00a0e",
        "e\u0301 ΑΣ. ΑΣ, \u0301x", "½ ０ ٠", "'s 't don't DON'T.", "Ab. ab, ÀÉ! ß? Ÿ. µ; ª: . ., a.b. x.. İ.", "x" * 5000,
    ]
    want = [e.ids + [2] for e in load(None).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for coder in (Encoder(), Encoder(remembered=5), Encoder(held_bytes=8)):
        coder.SLICE = 40
        for _ in range(2):
            assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(pa.array(texts), 2)] == want
    assert Encoder().cuts and Encoder().mark is not None and Encoder().tails
