"""Documents to packed training sequences: each stage's result is written and read again.

Stages take tables with at least the columns of documents; others, whatever their names, are
dropped by the first.  Null ids and null, empty or very long texts go through every stage as its
operator says; repeated rows are copies, of which near-dedup keeps one.  An empty table gives an
empty result of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessloom.llm.mixing import mixed_documents
from accessloom.llm.near_dedup import without_near_copies
from accessloom.llm.packing import pack_documents
from accessloom.llm.quality import cascade
from accessloom.llm.suffix_dedup import MADE, without_repeats
from accessloom.sources.workspace import fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a worker remembers when it encodes: it lives on into other stages, and holds them there.
REMEMBERED = 400_000


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return cascade(docs).where("kept").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least number of each group of near copies."""
    return without_near_copies(docs.select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 200-byte strings that stand elsewhere too."""
    return _counted(without_repeats(docs.select(*COLUMNS)).drop(*MADE))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each use of a document."""
    return _counted(mixed_documents(docs.select(*COLUMNS)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences of 4096."""
    return pack_documents(docs, remembered=REMEMBERED)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens, signatures and sorted suffixes aren't for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
