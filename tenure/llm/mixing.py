"""Mixing sources to target weights along a time-varying curriculum.

A document's size is its number of words. Each source has a weight; the sources share a budget of words by
weight, none beyond `most` times its own size: what it cannot take is shared by the others, by weight again.

A source's weight changes along training time 0..1 on a straight line from `start` to `end` times its weight. The
integral of that line, scaled to the source's target, is the words it is asked for until time t. The source's documents stand
in the order of a hash; the words before a document, put into the inverse of that integral, give its training position.
The mixed table is sorted by position, by range. Where the target exceeds the source, its documents come again: whole passes
over all of them, then those first in the order of the hash whose middle lies before what is left.

Sums before a document come from sums of buckets of the hash and a window inside a bucket, so no source meets in one
task. Null texts have size 0 and are never taken; a null source is a source of its own, the last. Rows that repeat a
doc_id or lack one are documents of their own, each with its own passes and positions: the hash is then that of the text
where there is no doc_id, and ties are broken by size, then text. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.scratch import Scratch, with_key

WEIGHTS = (5.0, 2.0, 1.0)
#: Of the weight, at the start and the end of training, in the order of WEIGHTS.
CURVES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MOST = 3
BUCKET_ROWS = 5_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(sizes: DataFrame, scratch: Scratch, budget: float = 1.0, most: int = MOST) -> DataFrame:
    """source, source_size, weight, rank, target of sizes(source, source_size).

    One row per source; each round fixes at `most` times its size every source that would get more.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kind = F.pmod(rank, F.lit(len(WEIGHTS)))
    current = sizes.withColumn("rank", rank).withColumn("weight", F.array(*map(F.lit, WEIGHTS))[kind])
    current = scratch.table(current.withColumn("target", F.lit(None).cast("double")))
    total = current.agg(F.sum("source_size")).first()[0] or 0
    left = budget * total
    while True:
        row = current.agg(
            F.sum(F.when(F.col("target").isNull(), F.col("weight"))).alias("weight"), F.sum("target").alias("fixed")
        ).first()
        if not row["weight"]:
            return current
        per = max(0.0, left - (row["fixed"] or 0.0)) / row["weight"]
        over = F.col("target").isNull() & (F.col("weight") * per > most * F.col("source_size"))
        after = scratch.table(current.withColumn("target", F.when(over, 1.0 * most * F.col("source_size")).otherwise(F.col("target"))))
        if after.filter("target is not null").count() == current.filter("target is not null").count():
            return after.withColumn("target", F.coalesce("target", F.col("weight") * per))
        current = after


def position(words_before: Column, target: Column, start: Column, end: Column) -> Column:
    """The time at which the integral of the line from start to end, scaled to target, reaches words_before."""
    area = F.greatest(F.lit(0.0), F.least(F.lit(1.0), words_before / target)) * (start + end) / 2
    slope = end - start
    root = F.sqrt(start * start + 2 * slope * area)
    return F.when(F.abs(slope) < 1e-12, area / start).otherwise((root - start) / slope)


def mixed(docs: DataFrame, budget: float = 1.0, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes (times taken), first_position and what that comes from."""
    scratch = Scratch(docs.sparkSession)
    return _plan(with_key(docs.select("doc_id", "source", "text"), scratch), scratch, budget, most).drop("_key")


def _plan(docs: DataFrame, scratch: Scratch, budget: float, most: int) -> DataFrame:
    """mixed() of docs(_key, doc_id, source, text), with _key."""
    hashed = F.coalesce(F.col("doc_id").cast("string"), "text", F.col("_key").cast("string"))
    base = scratch.table(docs.select("_key", "doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(hashed).alias("_order")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    digits = max(0, math.ceil(math.log(max(1, largest / BUCKET_ROWS), 16)))
    base = base.withColumn("_bucket", F.substring("_order", 1, digits) if digits else F.lit(""))
    target = shares(sizes.select("source", "source_size"), scratch, budget, most)
    buckets = base.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "size", "_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    facts = buckets.join(target.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    rows = rows.join(facts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    before = F.col("_base") + F.col("_inside")
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    passes = F.floor(ratio + 1e-12)
    left = F.col("target") - passes * F.col("source_size")
    again = (passes < most) & (before + F.col("size") / 2 <= left) & (F.col("size") > 0)
    curve = F.pmod("rank", F.lit(len(CURVES)))
    at = position(before, F.greatest("target", F.lit(1.0)), *(F.array(*(F.lit(c[k]) for c in CURVES))[curve] for k in (0, 1)))
    rows = rows.withColumn("passes", F.when(F.col("size") > 0, passes + again.cast("long")).otherwise(F.lit(0)).cast("long"))
    return rows.select(
        "_key", "doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"), "passes",
        at.alias("first_position"), before.alias("words_before"), F.col("_order").alias("order"),
        *(F.array(*(F.lit(c[k]) for c in CURVES))[curve].alias(n) for k, n in enumerate(("start", "end"))),
    )


def _copies(plan: DataFrame) -> DataFrame:
    """_key, size and _position of each time the mix takes a document."""
    copies = plan.filter("passes > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    words = F.col("words_before") + F.col("_pass") * F.col("source_size")
    return copies.select("_key", "size", position(words, F.col("target"), F.col("start"), F.col("end")).alias("_position"))


def _in_order(copies: DataFrame) -> DataFrame:
    return copies.repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key")


def curriculum(docs: DataFrame, budget: float = 1.0, most: int = MOST) -> DataFrame:
    """docs as the mix takes them, a row for each time, sorted by training position."""
    scratch = Scratch(docs.sparkSession)
    keyed = with_key(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row")), scratch)
    copies = _copies(_plan(keyed.select("_key", "doc_id", "source", "text"), scratch, budget, most)).drop("size")
    return _in_order(keyed.select("_key", "_row").join(copies, "_key")).select("_row.*")


def taken(docs: DataFrame, budget: float = 1.0, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, first_position of every document, counted from the mix itself.

    The mix, a row for each time a document is taken, is written in the order of the curriculum, without the texts. A
    document that it never takes has taken and passes 0 and the position at which it would stand.
    """
    scratch = Scratch(docs.sparkSession)
    plan = scratch.table(_plan(with_key(docs.select("doc_id", "source", "text"), scratch), scratch, budget, most))
    mix = scratch.table(_in_order(_copies(plan)))
    found = mix.groupBy(F.col("_key").alias("_k")).agg(F.sum("size").alias("_taken"), F.count("*").alias("_passes"), F.min("_position").alias("_first"))
    of = plan.join(found, F.col("_key") == F.col("_k"), "left")
    none = F.lit(0).cast("long")
    return of.select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", none).alias("taken"), F.coalesce("_passes", none).alias("passes"),
        F.coalesce("_first", "first_position").alias("first_position"),
    )


def oracle(rounds: int = 8) -> str:
    """DuckDB SQL for the columns of mixed() that op7 returns, over documents: `rounds` rounds of sharing, more than there can be sources at their limit."""
    weights, curves = list(WEIGHTS), [list(c) for c in CURVES]
    steps = "t0 AS (SELECT *, NULL::DOUBLE AS target FROM ranked)"
    for i in range(rounds):
        steps += f""", p{i} AS (SELECT greatest(0.0::DOUBLE, (SELECT sum(source_size) FROM ranked) - coalesce(sum(target), 0)) / sum(weight) FILTER (WHERE target IS NULL) AS per FROM t{i}),
        t{i + 1} AS (SELECT t.* REPLACE (CASE WHEN target IS NULL AND weight * per > {MOST} * source_size THEN {MOST}::DOUBLE * source_size ELSE target END AS target)
            FROM t{i} t, p{i})"""
    return f"""WITH base AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
        ranked AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
            ({weights}::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight FROM base GROUP BY source),
        {steps},
        shared AS (SELECT t.* REPLACE (coalesce(target, weight * per) AS target), ({curves}::DOUBLE[][])[rank % {len(weights)} + 1] AS curve FROM t{rounds} t, p{rounds - 1}),
        rows AS (SELECT b.*, source_size, target, curve[1] AS a, curve[2] AS z, floor(target / greatest(source_size, 1) + 1e-12)::BIGINT AS whole,
            coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY h, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM base b JOIN shared ON b.source IS NOT DISTINCT FROM shared.source),
        taken AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + (whole < {MOST} AND before + size / 2 <= target - whole * source_size)::BIGINT END AS passes,
            greatest(0.0::DOUBLE, least(1.0::DOUBLE, before / greatest(target, 1.0::DOUBLE))) * (a + z) / 2 AS area FROM rows)
        SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken, passes::BIGINT AS passes,
            CASE WHEN abs(z - a) < 1e-12 THEN area / a ELSE (sqrt(a * a + 2 * (z - a) * area) - a) / (z - a) END AS first_position FROM taken"""
