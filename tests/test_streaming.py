from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tenure.operators.features import session_rollup
from tenure.operators.survival import CoxPH
from tenure.streaming.jobs import drift_stream, replay_sessions, score_stream, scoring_counters, session_stream

from conftest import day

GAP = 1800


def clicks(spark):
    base = day("2024-01-01")
    rows = []
    for customer in range(6):
        at = 0
        for i in range(40):
            at += [60, 600, 1799, 1800, 4000][(i * 7 + customer) % 5]
            rows.append((f"c{customer}", base + timedelta(seconds=at), float(i), i % 9 == 0, "d", "p"))
    return spark.createDataFrame(
        rows,
        "customer_id string, event_timestamp timestamp, time_on_page_seconds double, "
        "added_to_cart boolean, device_type string, page_type string",
    )


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_streamed_sessions_equal_batch_sessions(spark, tmp_path):
    batch = clicks(spark)
    source = str(tmp_path / "in")
    batch.repartition(1).sortWithinPartitions("event_timestamp").write.parquet(source)
    # A far later event moves the watermark past every session of interest.
    last = batch.limit(1).withColumn("customer_id", F.lit("late")).withColumn(
        "event_timestamp", F.lit("2024-03-01").cast("timestamp")
    )
    last.write.mode("append").parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    run(
        session_stream(stream, GAP)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
    )
    columns = ["customer_id", "pages_per_session", "session_duration_s", "added_to_cart_in_session"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    want = session_rollup(batch, gap_seconds=GAP).select(*columns)
    assert want.count() > 20
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_replay_yields_open_sessions_too(spark, tmp_path):
    batch = clicks(spark)
    source = str(tmp_path / "in")
    for day_part in range(3):  # several micro-batches
        hours = F.hour("event_timestamp")
        part = batch.filter((hours >= 8 * day_part) & (hours < 8 * day_part + 8))
        part.repartition(1).sortWithinPartitions("event_timestamp").write.mode("append").parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = replay_sessions(stream, GAP, str(tmp_path / "replay"), delay="40 hours")
    columns = ["customer_id", "pages_per_session", "session_duration_s", "added_to_cart_in_session"]
    got, want = out.select(*columns), session_rollup(batch, gap_seconds=GAP).select(*columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_events_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = clicks(spark).schema

    def arrive(customer, text):
        clicks(spark).limit(1).withColumn("customer_id", F.lit(customer)).withColumn(
            "event_timestamp", F.lit(text).cast("timestamp")
        ).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(schema).parquet(source)
        run(
            session_stream(stream, GAP, delay="10 minutes")
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state"))
        )

    arrive("a", "2024-01-05 00:00:00")
    drain()
    arrive("too_late", "2024-01-01 00:00:00")
    arrive("end", "2024-02-01 00:00:00")
    drain()
    got = {r["customer_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a"}


def test_scores_and_drift_of_micro_batches(spark, cohort, tmp_path):
    features = ["f1", "f2", "f3"]
    model = CoxPH().fit(cohort, features)
    source = str(tmp_path / "in")
    cohort.select("customer_id", *features).write.parquet(source)
    broken = spark.createDataFrame([("x", None, 1.0, 2.0), ("y", float("inf"), 1.0, 2.0)], "customer_id string, f1 double, f2 double, f3 double")
    broken.write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    run(score_stream(stream, model, str(tmp_path / "scores"), str(tmp_path / "c1"), [10, 20]))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == cohort.count()
    assert {r["customer_id"] for r in spark.read.parquet(str(tmp_path / "scores-rejected")).collect()} == {"x", "y"}
    counters = scoring_counters(spark, str(tmp_path / "scores")).first()
    assert (counters["total"], counters["failed"]) == (cohort.count() + 2, 2) and counters["mean_seconds"] > 0
    run(
        drift_stream(
            stream, cohort, str(tmp_path / "drift"), str(tmp_path / "c2"), columns=["f1", "f2"]
        )
    )
    report = spark.read.parquet(str(tmp_path / "drift"))
    assert report.filter("NOT drifted").count() == 2
