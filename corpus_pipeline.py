"""Documents to packed training batches: quality rules, near and exact repeats, mixing, packing.

Each stage takes the documents that the one before kept and is written before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenure.llm import minhash, mixing, packing, quality, suffix
from tenure.llm.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fitted classifier."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five words, 0.8)."""
    return minhash.keep_one(docs)


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier."""
    return suffix.without_repeats(docs)


def mixed_by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum."""
    return mixing.curriculum(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch for every document; the batches of a bucket follow the order of docs as written."""
    return packing.pack(packing.numbered(docs), ordered=True)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("suffix_dedup", repeats_cut),
    ("mixing", mixed_by_weight),
    ("packing", packed),
]
#: The classifier, the signatures and the transforms have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
