"""The stages one after the other, each judged by brute force on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from accessloom.llm import quality, token_files
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, odd_rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out, base = {"documents": docs}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{base}/{name}")
        docs = out[name] = spark.read.parquet(f"{base}/{name}")
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    *kept, last = list(stages)
    for name in kept:
        assert stages[name].columns == list(corpus_pipeline.COLUMNS)
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality_stage(stages):
    left = {r["doc_id"] for r in quality.quality_report(stages["documents"]).where("kept").collect()}
    assert Counter(pairs(stages["quality_rules"])) == Counter(p for p in pairs(stages["documents"]) if p[0] in left)


def test_near_stage(stages):
    before = pairs(stages["quality_rules"])
    kept = [p for p, r in zip(before, brute.near(before)) if r[3] or r[1] == 0]
    assert Counter(pairs(stages["minhash_near_dedup"])) == Counter(kept)


def test_suffix_stage(stages):
    before = pairs(stages["minhash_near_dedup"])
    want = {n: r[0] - r[1] for (n, _), r in zip(before, brute.repeats([t for _, t in before]))}
    after = dict(pairs(stages["suffix_array_dedup"]))
    assert set(after) == set(want)
    for n, text in after.items():
        assert 0 <= want[n] - len(text.encode()) <= 40  # broken characters go too


def test_mixing_stage(stages):
    words = Counter()
    for _, text in pairs(stages["suffix_array_dedup"]):
        words["before"] += len(brute.words(text))
    for _, text in pairs(stages["source_mixing"]):
        words["after"] += len(brute.words(text))
    assert words["after"] == pytest.approx(1.5 * words["before"], rel=0.02)


def test_packing_stage(stages):
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], token_files.ids_crc32(r["ids"], r["id_bytes"]))
                  for r in stages["best_fit_packing"].collect())
    assert got == Counter(brute.pieces(pairs(stages["source_mixing"])))


@pytest.mark.parametrize("rows", [[], odd_rows()], ids=["empty", "odd"])
def test_odd_tables(spark, tmp_path, rows):
    """No rows, or null ids and texts, repeated rows, very long texts and columns of clashing names."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert bool(rows) or docs.isEmpty()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], token_files.ids_crc32(r["ids"], r["id_bytes"]))
                  for r in docs.collect())
    assert got == Counter(brute.pieces(pairs(before)))
