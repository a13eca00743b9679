"""Streaming forms of the ledger and ingest operators. All take and give streaming DataFrames (batch ones work too)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.blocks import classify_block, normalize_text


def stream_ingest(docs: DataFrame) -> DataFrame:
    """Lines of arriving documents, normalised and classified; stateless."""
    lines = docs.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("reading_order", "raw_text")).where(F.col("raw_text").rlike(r"\S"))
    return lines.select("document_id", F.col("reading_order").cast("long").alias("reading_order"), normalize_text(F.col("raw_text")).alias("text"), classify_block(F.col("raw_text")).alias("block_type"))


def stream_dedupe(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def stream_rate(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """Events of each user in sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def stream_funnel(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each type by day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after ``gap`` without an event."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def stream_feedback_join(runs: DataFrame, feedback: DataFrame, within: str = "1 hour") -> DataFrame:
    """Feedback with the run of its user that came before it within the bound; both sides forget what is older."""
    r = runs.withWatermark("run_ts", within)
    f = feedback.withWatermark("feedback_ts", within)
    bound = (F.col("feedback_ts") >= F.col("run_ts")) & (F.col("feedback_ts") <= F.col("run_ts") + F.expr(f"interval {within}"))
    return r.join(f, (F.col("run_user") == F.col("feedback_user")) & bound)


def read_available(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process all input that is there, then stop. The checkpoint makes a restarted run go on where it ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


CREDIT_MOVES = {("available", "reserve"): "reserved", ("reserved", "consume"): "consumed", ("reserved", "refund"): "available"}


def stream_credits(events: DataFrame, late: str = "1 hour", refund_after_ms: int | None = None) -> DataFrame:
    """Credit state machine over a stream: (credit_id, state, applied) after each batch with news of the credit.

    ``events``: credit_id, ts, event_id, event, start_state. Within a batch a credit's events apply in
    order of time and id. With ``refund_after_ms`` a reservation of that age is refunded: before an event
    that comes then or later, or by a timer once the watermark is past it. A credit that starts reserved
    counts as reserved at its first event. The state of a credit is three values, however many events it has.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def advance(key, frames, state: GroupState):
        import pandas as pd

        now, applied, since = state.get if state.exists else (None, 0, None)
        if state.hasTimedOut:
            now, applied, since = "available", applied + 1, None
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "event_id"], kind="stable")
            if now is None:
                now = rows["start_state"].iloc[0]
                since = int(rows["at"].iloc[0]) if now == "reserved" else None
            for event, at in zip(rows["event"], rows["at"], strict=True):
                if refund_after_ms is not None and now == "reserved" and at >= since + refund_after_ms:
                    now, applied = "available", applied + 1
                after = CREDIT_MOVES.get((now, event), now)
                if after != now:
                    applied += 1
                    since = int(at)
                now = after
            since = since if now == "reserved" else None
        state.update((now, applied, since))
        if refund_after_ms is not None and now == "reserved":
            state.setTimeoutTimestamp(max(since + refund_after_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"credit_id": [key[0]], "state": [now], "applied": [applied]})

    timeout = GroupStateTimeout.EventTimeTimeout if refund_after_ms is not None else GroupStateTimeout.NoTimeout
    timed = events.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("credit_id").applyInPandasWithState(advance, "credit_id long, state string, applied long", "state string, applied long, since long", "append", timeout)
