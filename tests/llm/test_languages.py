"""Language identification: no language is lost, and the model is what a plain computation gives."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from accessloom.llm import lang_id
from tests.llm import brute


def made(rng, letters, words=12):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(words))


def test_a_language_of_copies_is_not_lost(spark):
    """One text of many copies under one id, whichever language has it."""
    rng = random.Random(1)
    number = next(i for i in range(2000, 2100) if not brute.held_out(i, 3))
    for few, many in (("fr", "en"), ("en", "fr")):
        docs = [(i, made(rng, "abcdefg"), many) for i in range(1500)] + [(number, "nous voulons partir", few)] * 3000
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6)
        got = Counter(map(tuple, lang_id.predict_languages(df).select("doc_id", "lang_pred").collect()))
        assert got[number, few] == 3000 and sum(n for (_, x), n in got.items() if x == few) < 3010


def test_many_languages(spark):
    rng = random.Random(2)
    letters = {f"l{i:03d}": rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèàçñøåß", 6) for i in range(200)}
    docs = [(i, made(rng, letters[lang], 20), lang) for i, lang in enumerate(sorted(letters) * 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    rows = lang_id.predict_languages(df).where("held_out").collect()
    true = {n: lang for n, _, lang in docs}
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in rows) > 0.9 * len(rows)
    assert len({r["lang_pred"] for r in rows}) > 190


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "SAMPLE_PER_LABEL", 20)
    docs = [("a", f"text {i}") for i in range(300)] + [("b", "one")] * 500 + [("b", "two")] + [("c", "three")]
    got = lang_id.sampled(spark.createDataFrame(docs, "lang string, text string").repartition(5)).collect()
    by = defaultdict(dict)
    for r in got:
        by[r["lang"]][r["text"]] = r["copies"]
    assert len(by["a"]) == 20 and set(by["a"].values()) == {1}
    assert by["b"] == {"one": 10, "two": 1} and by["c"] == {"three": 1}


def plain_model(rows, idf, epochs):
    """Per-coordinate FTRL with dictionaries of numbers; rows are ({feature: x}, label number)."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f, c):
        if abs(z[f, c]) <= lang_id.L1:
            return 0.0
        return (math.copysign(lang_id.L1, z[f, c]) - z[f, c]) / (
            (lang_id.BETA + math.sqrt(n[f, c])) / lang_id.ALPHA + lang_id.L2)

    classes = 1 + max(y for _, y in rows)
    for order in epochs:
        for i in order:
            x, y = rows[i]
            w = {(f, c): weight(f, c) for f in x for c in range(classes)}
            score = [sum(v * w[f, c] for f, v in x.items()) for c in range(classes)]
            e = [math.exp(s - max(score)) for s in score]
            for c in range(classes):
                p = e[c] / sum(e) - (c == y)
                for f, v in x.items():
                    g = v * p
                    step = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / lang_id.ALPHA
                    z[f, c] += g - step * w[f, c]
                    n[f, c] += g * g
    return weight


def test_model_equals_a_plain_one():
    rng = random.Random(3)
    texts = [made(rng, "abcd" if i % 3 else "cdef", 4) for i in range(40)]
    labels = ["x" if i % 3 else "y" for i in range(40)]
    grams = [dict(zip(*map(np.ndarray.tolist, lang_id.gram_counts(t)))) for t in texts]
    df = Counter(f for g in grams for f in g)
    idf = np.array([math.log(41 / (1 + df[f])) + 1 for f in range(lang_id.FEATURES)])
    model = lang_id.fit(texts, labels, [1] * 40, idf)
    rows = []
    for g, y in zip(grams, labels):
        x = {f: (1 + math.log(c)) * idf[f] for f, c in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rows.append(({f: v / norm for f, v in x.items()}, ["x", "y"].index(y)))
    aside = {i for y in "xy" for i in [j for j in range(40) if labels[j] == y][4::5]}
    kept = np.array([i for i in range(40) if i not in aside])
    weight = plain_model(rows, idf, [np.random.default_rng(e).permutation(kept) for e in range(lang_id.EPOCHS)])
    for f in df:
        for c in range(2):
            assert model["weights"][f, c] == pytest.approx(weight(f, c), abs=1e-5)
    assert model["labels"] == ["x", "y"] and model["temperature"] > 0
