"""One query for each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import bpe, html, mixing, quality, simhash, spherical, substring, token_count, toxicity, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    return token_count.count_tokens(read(spark, sf_dir, "documents"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy among the embeddings, with the one that its group keeps."""
    return spherical.near_duplicates(read(spark, sf_dir, "embeddings"))


def embedding_near_dedup_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the embeddings and made copies of them, some nearer than the threshold and some not: the
    smallest tables have no near copies of their own."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    at = lambda i: (i + F.col("vec_id")).cast("int")
    uneven = F.transform("embedding", lambda x, i: (x * (1 + F.lit(0.05).cast("float") * (at(i) % 3))).cast("float"))
    turned = F.transform("embedding", lambda x, i: F.when(at(i) % 4 == 0, -x).otherwise(x))
    made = [(5, 1_000_000, uneven), (7, 2_000_000, turned), (11, 3_000_000, F.reverse("embedding"))]
    for every, base, vector in made:
        e = e.unionByName(read(spark, sf_dir, "embeddings").filter(F.col("vec_id") % every == 0).select((F.col("vec_id") + base).alias("vec_id"), vector.alias("embedding")))
    return spherical.near_duplicates(e)


_MADE = """(SELECT vec_id, embedding FROM embeddings
  UNION ALL SELECT vec_id + 1000000, list_transform(embedding, lambda x, i: (x * (1 + 0.05::FLOAT * ((i - 1 + vec_id) % 3)))::FLOAT) FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL SELECT vec_id + 2000000, list_transform(embedding, lambda x, i: CASE WHEN (i - 1 + vec_id) % 4 = 0 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 7 = 0
  UNION ALL SELECT vec_id + 3000000, list_reverse(embedding) FROM embeddings WHERE vec_id % 11 = 0)"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate and the copies of every document."""
    return mixing.mix_rates(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page without its host's boilerplate."""
    return html.extract(read(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.detect(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, and whether it is kept."""
    return quality.rate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near copy among the documents, with the one that its group keeps."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of words that repeats in the corpus."""
    return substring.find_repeats(read(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, decoded again."""
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page from damaged WARC files, and the gaps between what was salvaged."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "embedding_near_dedup_with_copies": embedding_near_dedup_with_copies,
    "op2_mixing": op2_mixing,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_token_counts": op10_token_counts,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op1_embedding_near_dedup": spherical.oracle("embeddings"), "embedding_near_dedup_with_copies": spherical.oracle(_MADE), "op7_substring_dedup": substring.ORACLE, "op10_token_counts": token_count.ORACLE}
