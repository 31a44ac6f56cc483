"""Streaming forms of the session roll-up, scoring and drift."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tenure.operators.drift import ReferenceProfile, drift_report
from tenure.operators.scoring import counted, score
from tenure.operators.survival import DEFAULT_HORIZONS, SurvivalModel
from tenure.plans.materialise import discard, materialise

COUNTERS = "total long, failed long, seconds double, mean_seconds double"


MERGE_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
LAST_TIME = "9000-01-01 00:00:00"


def session_stream(clicks: DataFrame, gap_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream of events: per customer, closed by a silence of `gap_seconds`.

    A session is emitted once the watermark (latest event time minus `delay`) has passed its end,
    and its state is dropped then; events later than the watermark are discarded. With MERGE_EARLY set to true in
    the session, sessions are merged inside each task before the shuffle, so a customer with very many events sends few rows.
    """
    return (
        clicks.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
        .withWatermark("event_timestamp", delay)
        .groupBy("customer_id", F.session_window("event_timestamp", f"{gap_seconds} seconds").alias("w"))
        .agg(
            F.sum("time_on_page_seconds").alias("session_duration_s"),
            F.count(F.lit(1)).alias("pages_per_session"),
            F.max(F.col("added_to_cart").cast("double")).alias("added_to_cart_in_session"),
        )
        .select(
            "customer_id",
            F.col("w.start").alias("session_start"),
            F.col("w.end").alias("session_end"),
            "session_duration_s",
            "pages_per_session",
            "added_to_cart_in_session",
        )
    )


def replay_sessions(clicks: DataFrame, gap_seconds: int, path: str, delay: str = "1 hour") -> DataFrame:
    """Every session of a stream that ends, those still open at its end included; written below `path`.

    The stream is read to its end first. Then one closing event, later than any time a session could reach, is let into a second
    source of the same query: the watermark passes the ends of all open sessions, which come out and leave the state. The closing
    event's own session stays open. A replay that fails goes on where its checkpoint is when it is started again.
    """
    spark = clicks.sparkSession
    fields = "customer_id string, event_timestamp timestamp, time_on_page_seconds double, added_to_cart boolean"
    closing = f"{path}/closing"
    spark.createDataFrame([], fields).write.mode("overwrite").parquet(closing)
    typed = clicks.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")])
    events = typed.unionByName(spark.readStream.schema(fields).parquet(closing))

    def to_the_end() -> None:
        before = spark.conf.get(MERGE_EARLY, "false")
        spark.conf.set(MERGE_EARLY, "true")
        try:
            query = (
                session_stream(events, gap_seconds, delay)
                .writeStream.format("parquet")
                .option("path", f"{path}/sessions")
                .option("checkpointLocation", f"{path}/state")
                .trigger(availableNow=True)
                .start()
            )
        finally:
            spark.conf.set(MERGE_EARLY, before)
        query.awaitTermination()

    to_the_end()
    end = spark.range(1).select(
        F.lit(None).cast("string").alias("customer_id"),
        F.lit(LAST_TIME).cast("timestamp").alias("event_timestamp"),
        F.lit(0.0).alias("time_on_page_seconds"),
        F.lit(False).alias("added_to_cart"),
    )
    end.coalesce(1).write.mode("append").parquet(closing)
    to_the_end()
    return spark.read.parquet(f"{path}/sessions")


def each_batch(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> DataStreamWriter:
    """Run a batch job on every micro-batch and write its result under the batch's own folder, so
    a batch that is replayed after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def score_stream(
    features: DataFrame,
    model: SurvivalModel,
    path: str,
    checkpoint: str,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
) -> DataStreamWriter:
    """Scores of every arriving customer row below `path`, rows that cannot be scored, with the names of what
    they lack, below `path`-rejected, and one row of counters per micro-batch below `path`-counters: its
    rows, those that failed, the seconds it took and the mean of them per row."""

    def write(batch: DataFrame, number: int) -> None:
        begin = time.perf_counter()
        wide, seen = counted(batch, model)
        written = materialise(wide, "batch")
        for table, folder in zip(score(written, model, horizons), (path, f"{path}-rejected")):
            table.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        discard(written)
        total, failed = seen.get["total"], seen.get["failed"]
        seconds = time.perf_counter() - begin
        counters = batch.sparkSession.createDataFrame([(total, failed, seconds, seconds / total if total else None)], COUNTERS)
        counters.coalesce(1).write.mode("overwrite").parquet(f"{path}-counters/batch={number}")

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def scoring_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row over all micro-batches of a score stream: batches, total, failed, mean_seconds per row."""
    rows = spark.read.parquet(f"{path}-counters")
    return rows.agg(
        F.count("batch").alias("batches"),
        F.sum("total").alias("total"),
        F.sum("failed").alias("failed"),
        F.try_divide(F.sum("seconds"), F.sum("total")).alias("mean_seconds"),
    )


def drift_stream(
    current: DataFrame, reference: DataFrame | ReferenceProfile, path: str, checkpoint: str, **options
) -> DataStreamWriter:
    """A drift report of every micro-batch against a fixed reference.

    A table is made into a profile before the stream starts, below `path`-reference; the micro-batches read that.
    """
    if not isinstance(reference, ReferenceProfile):
        profile = f"{path}-reference/{uuid.uuid4().hex}"
        reference = ReferenceProfile.fit(reference, profile, options.get("columns"))

    def report(batch: DataFrame) -> DataFrame:
        written = materialise(batch, "batch")  # read more than once
        out = materialise(drift_report(reference, written, **options), "report")
        discard(written)
        return out

    return each_batch(current, report, path, checkpoint)
