"""Cut a lineage by writing a table to the cluster's shared checkpoint folder.

A written table survives the loss of executors and, unlike a row checkpoint, stays columnar, so
later jobs still prune columns and push filters into the scan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


_own_root: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names, else the one set on the context. Where there is neither, a local
    master gets one of our own, per application; on a cluster that would be a folder only the driver sees, so it is an error."""
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        on_context = context._jsc.sc().getCheckpointDir()
        root = on_context.get() if on_context.isDefined() else None
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_root:
            _own_root[app] = tempfile.mkdtemp(prefix="tenure-checkpoint-")
        root = _own_root[app]
    return root.rstrip("/")


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return _marked(spark.read.schema(df.schema).parquet(path), path)


def _marked(df: DataFrame, path: str) -> DataFrame:
    df._written_to = path
    return df


def materialise_by(df: DataFrame, column: str, label: str = "table") -> DataFrame:
    """The same, partitioned by a column: a filter on it reads its rows alone."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(column).parquet(path)
    return _marked(spark.read.parquet(path), path)


def is_written(df: DataFrame) -> bool:
    """Whether this is a table as it was written here, so that scanning it again computes nothing again."""
    return hasattr(df, "_written_to")


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
