"""The operators over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessloom.llm import (
    embed_dedup, lang_id, lexical, lm_score, mixing, near_dedup, packing, pii, quality, spelling,
    suffix_dedup, token_count, token_files,
)
from accessloom.sources.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), digest=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir).select("doc_id", "text"), digest=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict_languages(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token_files")
    token_files.write_token_files(documents(spark, sf_dir), path)
    return token_files.read_token_files(spark, path, digest=True)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_documents(documents(spark, sf_dir))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), by_shard=True)
    by_shard = F.array_join(F.col("shard_words").cast("array<string>"), ",").alias("shard_words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", by_shard)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(documents(spark, sf_dir), damage=97)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (op1_best_fit_packing, op2_token_counts, op3_lm_scoring, op4_suffix_array_dedup, op5_quality_rules,
             op6_language_id, op7_token_files, op8_minhash_near_dedup, op9_embedding_near_dedup, op10_mixing,
             op11_spelling_variants, op12_lexical_search, op13_personal_data, pipeline)
    return {fn.__name__: fn for fn in found}


# Vectors here have one dimension; a vector that links with nothing has a cosine with none.
_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
smallest AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id,
       coalesce(vec_id = component_id, FALSE) AS kept
FROM v JOIN smallest USING (r) LEFT JOIN n USING (r)"""

_MIX = f"""SELECT doc_id, size, source_size, target, taken, array_to_string(shard_words, ',') AS shard_words
FROM ({mixing.MIX_SQL})"""


def oracle_sql() -> dict[str, str]:
    out = {
        "op5_quality_rules": quality.REPORT_SQL, "op9_embedding_near_dedup": _VECTORS_SQL, "op10_mixing": _MIX,
        "op11_spelling_variants": spelling.SPELLING_SQL, "op12_lexical_search": lexical.SEARCH_SQL,
    }
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL is not None:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
