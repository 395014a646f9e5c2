"""Queries over the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import encode_decode
from .centroids import cluster_sql, cluster_vectors
from .decontamination import find_contamination
from .embedding_dedup import near_embeddings
from .jaccard_join import jaccard_join
from .language_id import fit_language, identify_language
from .license_scan import license_sql, scan_licenses
from .personal_data import find_personal_data
from .quality import fit_quality, score_quality
from .spelling import group_spellings
from .suffix_dedup import drop_repeats
from .token_counts import count_tokens
from .token_store import store_and_read


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "n_words")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_language(docs, fit_language(docs))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), threshold=0.8, shingle=5).drop("text_hash")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(_table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_language_id": op5_language_id,
        "op6_token_store": op6_token_store,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_license_scan": op8_license_scan,
        "op9_quality": op9_quality,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_centroids": op11_centroids,
        "op12_spelling": op12_spelling,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_license_scan": license_sql(), "op11_centroids": cluster_sql()}
