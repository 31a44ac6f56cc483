"""Intermediate tables in the shared folder that `spark.checkpoint.dir` names."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.plans.materialise import checkpoint_root


class Scratch:
    """Writes tables that outlive executors, in a new folder below the checkpoint folder.

    The folder is read from the session; only where none is set, as in tests, a local master uses a temporary one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: dict[int, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        """Write df and return it as read back; its earlier plan is not run again."""
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read any more, and let Spark clean finished shuffles."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def with_key(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with doc_id as long, text as string, and `_key`: a number of its own for every row, ascending with doc_id (null last).

    The key is doc_id itself where that is unique and never null; otherwise rows are numbered by doc_id, then text, then a hash
    of the other columns.
    """
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    rest = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t and "variant" not in t))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text"), rest]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.table(ranged.withColumn("_key", F.monotonically_increasing_id()))
