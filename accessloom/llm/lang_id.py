"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text, weighted by
(1 + ln tf) * idf and scaled to length 1.  Document frequencies cover all training texts.  The
weights are learned by follow-the-regularised-leader with elastic-net penalties on a sample of
each language: ``SAMPLE_PER_LABEL`` of its different texts (fewer of each where there are more
than 20 languages, ``SAMPLE`` in all), or all it has.  Texts that occur more often count as often
as there is room for, so a language of few texts in many copies isn't lost.  A fifth of the rows of
each language with five or more is kept aside for a temperature that makes the probabilities true.
One task learns; it holds the sample and 20 bytes for each feature and language, 130 MB for 200.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if no
training text has a language.  Training texts without a language or a letter are left out.
A null id counts as the text '' for the held-out rule.  Repeated rows count each.  An empty
table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEATURES, GRAMS = 1 << 15, (1, 2, 3)
SAMPLE_PER_LABEL, SAMPLE = 1200, 24_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 0.02, 0.05
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(FEATURES, np.int64)
    h = np.zeros(len(codes), np.uint32)
    for n in GRAMS:
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        total += np.bincount((mixed >> np.uint32(17)).astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf[at]
    return x / max(np.linalg.norm(x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Leader:
    """Follow the regularised leader, per coordinate, for each class."""

    def __init__(self, classes: int):
        self.z = np.zeros((FEATURES, classes))
        self.n = np.zeros((FEATURES, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - step * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    low, high, part = -4.0, 4.0, (5**0.5 - 1) / 2
    a, b = high - part * (high - low), low + part * (high - low)
    while high - low > 1e-3:
        if loss(a) < loss(b):
            high, b = b, a
            a = high - part * (high - low)
        else:
            low, a = a, b
            b = low + part * (high - low)
    return float(np.exp((low + high) / 2))


def fit(texts: list[str], labels: list[str], copies: list[int], idf: np.ndarray) -> dict:
    """Labels, weights and temperature from a sample, whose order is that of learning before it is shuffled."""
    names = sorted(set(labels))
    number = {name: i for i, name in enumerate(names)}
    rows = [(*gram_counts(t), number[y]) for t, y in zip(texts, labels)]
    rows = [(at, weighted(at, tf, idf), y) for at, tf, y in rows]
    order = np.repeat(np.arange(len(rows)), copies)
    label = np.array([y for _, _, y in rows])[order]
    aside = np.zeros(len(order), bool)
    for y in range(len(names)):
        mine = np.flatnonzero(label == y)
        if len(mine) >= 5:
            aside[mine[4::5]] = True
    leader = Leader(len(names))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(order[~aside]):
            leader.learn(*rows[i])
    w = leader.weights(slice(None))
    t = 1.0
    if aside.any() and len(names) > 1:
        logits = np.stack([rows[i][1] @ w[rows[i][0]] for i in order[aside]])
        t = temperature(logits, label[aside])
    return {"labels": names, "weights": w.astype(np.float32), "temperature": t}


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many hold each feature."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in source:
            for text in batch.column(0).to_pylist():
                if has_letter(text):
                    df[gram_counts(text)[0]] += 1
                    n += 1
        if n:
            df[-1] = n
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["f", "n"])

    sums = texts.select("text").mapInArrow(batches, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # a row per feature at most
    df = np.zeros(FEATURES + 1, np.int64)
    df[found.column("f").to_numpy()] = found.column("n").to_numpy()
    return int(df[-1]), df[:-1]


def sampled(rows: DataFrame) -> DataFrame:
    """(lang, text, place, copies) of at most ``SAMPLE_PER_LABEL`` different texts of each language.

    Texts are compared and counted by a digest, so a text of many copies never gathers; the
    sample takes the least digests, however rows lie.
    """
    rows = rows.select("lang", "text", F.md5(F.col("text").cast("binary")).alias("place"))
    counted = rows.groupBy("lang", "place").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("lang").agg(F.count("*").alias("different"))
    labels = sizes.count()
    most = max(min(SAMPLE_PER_LABEL, SAMPLE // max(labels, 1)), 5)
    # digests are even numbers of chance: of a large language far fewer than all can be among the least
    below = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / (1 << 32)
    near = counted.join(F.broadcast(sizes), "lang").where(below < (4 * most + 100) / F.col("different"))
    first = near.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("place"))).where(F.col("r") <= most)
    room = F.greatest(F.floor(F.lit(most) / F.count("*").over(W.partitionBy("lang"))), F.lit(1))
    chosen = first.withColumn("copies", F.least("n", room).cast("int")).select("lang", "place", "copies")
    texts = rows.join(F.broadcast(chosen), ["lang", "place"])  # at most 24,000 rows, or 5 for each language
    return texts.groupBy("lang", "place").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))


def train(rows: DataFrame) -> dict | None:
    """The model from (doc_id, text, lang); None if there is nothing to learn from."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    if rows.isEmpty():
        return None
    n, df = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[[has_letter(t) for t in frame["text"]]].sort_values(["place", "lang"])
        model = pickle.dumps(fit(
            frame["text"].tolist(), frame["lang"].tolist(), frame["copies"].tolist(), idf)) if len(frame) else b""
        return pd.DataFrame({"model": [model]})

    # The sample is bounded, so one task may hold it.
    made = sampled(rows).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "model binary").collect()
    if not made or not made[0]["model"]:
        return None
    return {**pickle.loads(made[0]["model"]), "idf": idf}


def predict_languages(
    docs: DataFrame, number: str = "doc_id", text: str = "text", lang: str = "lang",
    held_out: Column | None = None,
) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred and score, the calibrated probability.

    Learned from the rows where ``held_out`` (by default crc32 of the number mod 3 = 1) isn't true.
    """
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(number).cast("string"), F.lit(""))) % 3 == 1
    rows = docs.select(
        F.col(number).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"),
        F.col(lang).alias("lang"))
    model = train(rows.where("NOT held_out").drop("held_out"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in source:
            names, scores = [], []
            for t in batch.column(2).to_pylist():
                if model is None or not has_letter(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, tf = gram_counts(t)
                p = softmax(weighted(at, tf, model["idf"]) @ model["weights"][at] / model["temperature"])
                best = int(p.argmax())
                names.append(model["labels"][best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        batches, "doc_id long, held_out boolean, lang_pred string, score double")
