"""The registered queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import codes, conversations, ctw, decontaminate, embed, langid, licenses, minhash, mixing, packing, quality, suffix, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_read(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_bytes(_read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(_read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are files named by their id in a directory named by their source."""
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    return licenses.licences(_read(spark, sf_dir, "documents").withColumn("path", path))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.structure(conversations.damaged(_read(spark, sf_dir, "conversations")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_language_id,
        op3_embedding_dedup,
        op4_quality_rules,
        op5_packing,
        op6_minhash,
        op7_mixing,
        op8_suffix_dedup,
        op9_lm_scores,
        op10_licenses,
        op11_decontamination,
        op12_conversations,
        op13_vector_codes,
    )
}
ORACLES: dict[str, str] = {
    "op6_minhash": minhash.oracle(),
    "op7_mixing": mixing.oracle(),
    "op11_decontamination": decontaminate.oracle(),
    "op12_conversations": conversations.oracle(),
    "op13_vector_codes": codes.oracle(),
}
