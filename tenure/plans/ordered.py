"""Running totals, ranks and as-of lookups over a global order, without a one-task sort.

A window that orders a whole table puts every row in one task. The helpers here first collapse
the table to one row per distinct key (partial aggregation absorbs hot keys), then cut the key
range into buckets at approximate quantiles, run the window inside each bucket, and add the sum
of the earlier buckets. Where the number of distinct keys is measured to be small the bucketing
is skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.plans.columns import quoted
from tenure.plans.materialise import materialise

BUCKET = "_bucket"
ONE_WINDOW_LIMIT = 50_000  # distinct keys one ordered window may hold
VALUES_PER_BUCKET = 1000  # distinct keys from which a bucket's border is estimated
MAX_BUCKETS = 1024  # bounds every per-bucket table
SKETCH_ERROR = 0.05  # a wider sketch carries thousands of buffer columns through the plan


@dataclass(frozen=True)
class Splits:
    """Bucket borders for one key; no borders means one window is enough."""

    key: str
    points: tuple[float, ...] = ()

    @property
    def bucketed(self) -> bool:
        return bool(self.points)


def measure_splits(
    df: DataFrame,
    keys: Sequence[str],
    limit: int = ONE_WINDOW_LIMIT,
    distinct: dict[str, int] | None = None,
) -> dict[str, Splits]:
    """Bucket borders of several keys: distinct counts in one scan (or given), then quantiles of the distinct keys of those
    beyond the limit, so that a value most rows share takes no borders from the others.
    """
    if distinct is None:
        row = df.agg(*[F.approx_count_distinct(quoted(k), SKETCH_ERROR).alias(k) for k in keys]).first()
        distinct = row.asDict()
    wanted = {
        k: max(2, min(MAX_BUCKETS, int(distinct[k] // limit) + 1))
        for k in keys
        if (1 + 3 * SKETCH_ERROR) * distinct[k] > limit
    }
    found = {k: Splits(k) for k in keys}
    for k, n in wanted.items():
        cut = F.percentile_approx(F.col(quoted(k)).cast("double"), [i / n for i in range(1, n)], max(1000, 20 * n))
        row = some_distinct(df.select(quoted(k)), quoted(k), distinct[k], n).agg(cut.alias("cut")).first()
        found[k] = Splits(k, tuple(sorted({p + 0.0 for p in row["cut"] or []})))
    return found


def some_distinct(df: DataFrame, key: str, distinct: int, buckets: int) -> DataFrame:
    """Distinct rows of df, of about VALUES_PER_BUCKET values of the key for each bucket: those whose hash falls into a share of all hashes.

    A value is in or out as a whole, however often it repeats, and only those that are in are shuffled.
    """
    share = max(1, int(distinct // (VALUES_PER_BUCKET * buckets)))
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(share)) == 0).distinct()


def with_bucket(df: DataFrame, splits: Splits, name: str = BUCKET) -> DataFrame:
    """Add the bucket number of the key, 0 everywhere when not bucketed.

    The number is never null, so joins on it add no filter to their inputs.
    """
    if not splits.bucketed:
        return df.withColumn(name, F.lit(0))
    borders = [float("-inf"), *splits.points, float("inf")]
    # Adding zero makes one of both zeros, which are one key.
    binner = Bucketizer(splits=borders, inputCol="_key", outputCol="_at", handleInvalid="keep")
    placed = binner.transform(df.withColumn("_key", F.col(quoted(splits.key)).cast("double") + F.lit(0.0)))
    return placed.withColumn(name, F.coalesce(F.col("_at").cast("int"), F.lit(-1))).drop("_key", "_at")


def running(
    cells: DataFrame,
    key: str,
    outputs: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    product: bool = False,
    bucketed: bool = True,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums (or products) of `outputs` along `key` within `by`.

    `cells` holds one row per (by, key) and a bucket column. `totals` may give the outputs summed
    per (by, bucket) where that is cheaper than summing the cells, and may bring more columns,
    which are kept. Totals hold at most MAX_BUCKETS rows per group, so they are broadcast.
    """
    fold = F.product if product else F.sum
    staged = cells.select("*", *[e.alias(f"_in_{n}") for n, e in outputs.items()])
    plain = [c for c in cells.columns if c not in outputs]
    order = F.col(key).desc() if descending else F.col(key).asc()
    within = (
        Window.partitionBy(*by, *([BUCKET] if bucketed else []))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if not bucketed:
        return staged.select(*plain, *[fold(f"_in_{n}").over(within).alias(n) for n in outputs])
    kept: list[str] = []
    if totals is None:
        # Totals and rows are read separately: write the cells rather than compute them twice.
        staged = materialise(staged, "cells")
        totals = staged.groupBy(*by, BUCKET).agg(
            *[fold(f"_in_{n}").alias(f"_tot_{n}") for n in outputs]
        )
    else:
        kept = [c for c in totals.columns if c not in (*by, BUCKET, *outputs)]
        totals = totals.select(
            *by, BUCKET, *kept, *[F.col(n).alias(f"_tot_{n}") for n in outputs]
        )
    bucket_order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = (
        Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    neutral = F.lit(1.0) if product else F.lit(0)
    offsets = totals.select(
        *by,
        BUCKET,
        *kept,
        *[F.coalesce(fold(f"_tot_{n}").over(before), neutral).alias(f"_off_{n}") for n in outputs],
    )
    joined = staged.join(F.broadcast(offsets), [*by, BUCKET])
    combined = []
    for n in outputs:
        inner = fold(f"_in_{n}").over(within)
        offset = F.col(f"_off_{n}")
        combined.append((inner * offset if product else inner + offset).alias(n))
    return joined.select(*plain, *kept, *combined)


def dense_ranks(df: DataFrame, key: str, rank: str, splits: Splits) -> DataFrame:
    """(key, rank) for every distinct key, ranks from 0 in key order."""
    distinct = with_bucket(df.select(key).distinct(), splits)
    ranked = running(distinct, key, {rank: F.lit(1)}, bucketed=splits.bucketed)
    return ranked.select(key, (F.col(rank) - 1).cast("long").alias(rank))


def average_ranks(df: DataFrame, key: str, rank: str, splits: Splits) -> DataFrame:
    """(key, rank) with ties sharing the mean of their positions, from 1."""
    counted = with_bucket(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), splits)
    ranked = running(counted, key, {"_upto": F.col("_n")}, bucketed=splits.bucketed)
    return ranked.select(key, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(rank))


def step_lookup(
    df: DataFrame,
    x: str,
    table: DataFrame,
    key: str,
    values: Sequence[str],
    limit: int = ONE_WINDOW_LIMIT,
    salts: int = 16,
) -> DataFrame:
    """Add the `values` of the last table row whose key is <= x; null where there is none.

    A table of at most `limit` rows (counted) becomes a binary search in the JVM plus a broadcast
    of that table. A larger one is merged with the rows along the key, bucket by bucket; rows are
    salted so that one frequent x does not fill a task.
    """
    size = table.count()
    if size <= limit:
        return _small_step_lookup(df, x, table, key, values)
    return _merged_step_lookup(df, x, table, key, values, salts)


def _small_step_lookup(
    df: DataFrame, x: str, table: DataFrame, key: str, values: Sequence[str]
) -> DataFrame:
    steps = table.select(F.col(key).cast("double").alias(key), *values).toArrow().to_pandas()
    steps = steps.sort_values(key, kind="stable").drop_duplicates(key, keep="last")
    if steps.empty:
        kinds = dict(table.dtypes)
        return df.select("*", *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    borders = [float("-inf"), *steps[key].tolist(), float("inf")]
    steps = steps.drop(columns=[key]).assign(_step=range(1, len(steps) + 1))
    steps_df = df.sparkSession.createDataFrame(pa.Table.from_pandas(steps, preserve_index=False))
    placed = Bucketizer(
        splits=borders, inputCol=x, outputCol="_step", handleInvalid="keep"
    ).transform(df.withColumn(x, F.col(x).cast("double")))
    placed = placed.withColumn("_step", F.col("_step").cast("long"))
    return placed.join(F.broadcast(steps_df), "_step", "left").drop("_step")


def _merged_step_lookup(
    df: DataFrame, x: str, table: DataFrame, key: str, values: Sequence[str], salts: int
) -> DataFrame:
    keyed = table.select(F.col(key).cast("double").alias("_k"), *values)
    queries = df.withColumn("_k", F.col(x).cast("double"))
    points: set[float] = set()
    for side in (keyed, queries):
        points |= set(measure_splits(side, ["_k"], limit=1)["_k"].points)
    splits = Splits("_k", tuple(sorted(points)))

    steps = with_bucket(keyed, splits)
    last = steps.groupBy(BUCKET).agg(
        F.max_by(F.struct(*values), "_k").alias("_last")
    )
    numbers = df.sparkSession.range(len(splits.points) + 1).select(
        F.col("id").cast("int").alias(BUCKET)
    )
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = numbers.join(last, BUCKET, "left").select(
        BUCKET, F.last("_last", ignorenulls=True).over(before).alias("_carry")
    )

    spread = steps.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    ).select("_k", BUCKET, "_salt", F.struct(*values).alias("_value"), F.lit(0).alias("_asks"))
    body = F.struct(*[F.col(c) for c in df.columns])
    asked = with_bucket(queries, splits).select(
        "_k",
        BUCKET,
        # Numbers of rows, not their contents: rows that repeat spread as well.
        F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("_salt"),
        body.alias("_row"),
        F.lit(1).alias("_asks"),
    )
    merged = spread.unionByName(asked, allowMissingColumns=True)
    window = (
        Window.partitionBy(BUCKET, "_salt")
        .orderBy("_k", "_asks")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = merged.withColumn("_value", F.last("_value", ignorenulls=True).over(window))
    found = found.filter(F.col("_asks") == 1).join(F.broadcast(carried), BUCKET, "left")
    value = F.coalesce("_value", "_carry")
    return found.select("_row.*", *[value[v].alias(v) for v in values])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
