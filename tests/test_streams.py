"""Streams give what the batch operators give."""

from __future__ import annotations

from cadastra.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_credits(spark):
    same = [sorted(tuple(r) for r in QUERIES[q](spark, SF).select("credit_id", "state", "applied").collect()) for q in ("stream_credits", "stream_credits_batch")]
    assert same[0] == same[1] and any(r[2] > 1 for r in same[0])


def test_restart_goes_on(spark, tmp_path):
    """A stopped stream reads each file once, over runs with one checkpoint."""
    from cadastra.streaming import ledger as L

    schema = "doc_id bigint, text string"
    for i in range(2):
        spark.createDataFrame([(i, f"Part {i}\n\n(a) the use")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        L.run_available(L.stream_ingest(L.read_available(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted((r["document_id"], r["reading_order"], r["block_type"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 0, "heading"), (0, 2, "list_item"), (1, 0, "heading"), (1, 2, "list_item")]


def test_credit_timers_over_runs(spark, tmp_path):
    """A reservation outlives the run that made it: the next run's watermark gives it back, and a late consume finds nothing."""
    from pyspark.sql import functions as F

    from cadastra.streaming import ledger as L

    schema = "credit_id bigint, ts timestamp, event_id bigint, event string, start_state string"
    hour = lambda h: f"2024-01-01 {h:02d}:00:00"
    runs = [
        [(1, hour(1), 1, "reserve", "available"), (2, hour(1), 2, "reserve", "available"), (2, hour(2), 3, "consume", "available"), (3, hour(1), 4, "note", "available")],
        [(3, hour(9), 5, "reserve", "available")],
        [(1, hour(10), 6, "consume", "available"), (4, hour(10), 7, "note", "reserved"), (4, hour(14), 8, "consume", "reserved"), (5, hour(10), 9, "reserve", "available"), (5, hour(13), 10, "consume", "available")],
    ]
    seen = []
    for run in runs:
        spark.createDataFrame(run, "credit_id bigint, ts string, event_id bigint, event string, start_state string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(str(tmp_path / "in"))
        L.run_available(L.stream_credits(L.read_available(spark, str(tmp_path / "in"), schema), refund_after_ms=4 * 3_600_000), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        out = spark.read.parquet(str(tmp_path / "out")).groupBy("credit_id").agg(F.max_by("state", "applied").alias("state"), F.max("applied").alias("applied"))
        seen.append({r["credit_id"]: (r["state"], r["applied"]) for r in out.collect()})
    assert seen[0] == {1: ("reserved", 1), 2: ("consumed", 2), 3: ("available", 0)}
    assert seen[1] == {1: ("available", 2), 2: ("consumed", 2), 3: ("reserved", 1)}
    # Credit 4 was due at 14:00, before its consume; credit 5 was consumed in time.
    assert seen[2] == {1: ("available", 2), 2: ("consumed", 2), 3: ("reserved", 1), 4: ("available", 1), 5: ("consumed", 2)}
