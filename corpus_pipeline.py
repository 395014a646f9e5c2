"""The corpus pipeline: stages over `documents`, each written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.bpe_codec import encode_decode
from tracewright.llm.common import dropped_checkpoints, remove, scratch_path
from tracewright.llm.decontamination import drop_contaminated
from tracewright.llm.jaccard_join import jaccard_join
from tracewright.llm.language_id import fit_language, identify_language
from tracewright.llm.suffix_dedup import drop_repeats


OWN = "own_"


def apart(docs: DataFrame) -> DataFrame:
    """The documents under names that no operator's output has."""
    return docs.toDF(*[OWN + c for c in docs.columns])


def back(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(OWN + c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay.

    Texts without a letter go, and those that the classifier finds unlike every language it
    learned (not `familiar`).  Where nothing could be learned only the first rule is left.
    """
    own = apart(docs)
    found = identify_language(own, fit_language(docs), id_col=OWN + "doc_id", text_col=OWN + "text", keep=[c for c in own.columns if c != OWN + "doc_id"])
    return back(found.where("familiar"), docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id (rows that share it stay or go by their own texts)."""
    gone = jaccard_join(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    own = apart(docs)
    left = own.join(gone, (F.col(OWN + "doc_id") == F.col("gone_id")) & (F.xxhash64(OWN + "text") == F.col("gone_hash")), "left_anti")
    return back(left, docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occurred before are cut out; a document that is left empty by this goes."""
    own = apart(docs).withColumn("null_text", F.col(OWN + "text").isNull())
    rest = [c for c in own.columns if c not in (OWN + "doc_id", OWN + "text")]
    cut = drop_repeats(own, id_col=OWN + "doc_id", text_col=OWN + "text", keep=rest, text_out=True)
    changed = F.col("n_removed") > 0
    cut = cut.where(~changed | (F.length(F.trim("kept_text")) > 0))
    text = F.when(~F.col("null_text"), F.col("kept_text"))
    chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col(OWN + "n_chars"))
    return back(cut.withColumns({OWN + "text": text, OWN + "n_chars": chars}), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words, in any order of passages, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of what is left."""
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_dedup", jaccard_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe_codec", bpe_codec),
]

#: No stage but the last can be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each stage's rows are written as Parquet in the shared folder and read again.

    A stage's checkpoints go once its rows are written, and its table once the next stage's is; the
    last table stays, as the result reads it.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with dropped_checkpoints(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
