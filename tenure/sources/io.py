"""Parquet and JSON tables in and out."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLE_NAMES = ("customers", "transactions", "clickstream", "support_tickets", "survival_labels")


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet table; a missing path raises AnalysisException. Give a schema to skip inference."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(
    df: DataFrame, path: str, *, overwrite: bool = True, partition_by: Sequence[str] = ()
) -> None:
    """Snappy Parquet; with overwrite=False an existing target raises."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("compression", "snappy").parquet(path)


def write_bundle(
    datasets: dict[str, DataFrame],
    root: str,
    *,
    overwrite: bool = True,
    partition_by: dict[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """One table per name under `root`; big event tables may be partitioned by a date column."""
    paths = {name: os.path.join(root, name) for name in datasets}
    for name, df in datasets.items():
        write_table(
            df, paths[name], overwrite=overwrite, partition_by=(partition_by or {}).get(name, ())
        )
    return paths


def read_bundle(spark: SparkSession, root: str, names: Sequence[str] = TABLE_NAMES) -> dict[str, DataFrame]:
    return {name: read_table(spark, os.path.join(root, name)) for name in names}


def read_pair(spark: SparkSession, reference: str, current: str) -> tuple[DataFrame, DataFrame]:
    """The two tables a drift comparison reads."""
    return read_table(spark, reference), read_table(spark, current)


def write_json(df: DataFrame, path: str, *, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)
