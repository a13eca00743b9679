"""Streaming queries: the given tables as streams, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadastra.plans.base import query
from cadastra.sources.lineage import shared_folder
from cadastra.streaming import ledger as L

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _run(t, table, schema, f, mode="append"):
    """What the stream over a table gives when all of it has been read, last value of each key in update mode."""
    folder = _folder(t.spark)
    source = L.read_available(t.spark, f"{t.sf_dir}/{table}.parquet*", schema)
    out = f(source)
    L.run_available(out, f"{folder}/out", f"{folder}/checkpoint", mode=mode)
    return t.spark.read.schema(out.schema).parquet(f"{folder}/out")


def _events(s):
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ingest")
def stream_ingest(t):
    return _run(t, "documents", "doc_id bigint, text string, lang string, source string, n_chars bigint", L.stream_ingest)


@query("stream_dedupe", "SELECT event_id, user_id, event_type FROM {events}")
def stream_dedupe(t):
    return _run(t, "events", EVENTS, lambda s: L.stream_dedupe(_events(s.unionByName(s))).select("event_id", "user_id", "event_type"))


# In append mode a window comes out when the watermark (an hour behind the last event) has passed its end.
_DONE = "(SELECT max(ts) - INTERVAL 1 HOUR FROM {events})"


@query(
    "stream_funnel",
    f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM {{events}} GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_DONE}""",
)
def stream_funnel(t):
    out = _run(t, "events", EVENTS, lambda s: L.stream_funnel(_events(s)))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "stream_sessions",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {{events}}),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us FROM i GROUP BY user_id, island HAVING max(ts) + INTERVAL 30 MINUTE <= {_DONE}""",
)
def stream_sessions(t):
    out = _run(t, "events", EVENTS, lambda s: L.stream_sessions(_events(s)))
    return out.select("user_id", "n", F.unix_micros("start").alias("start_us"))


@query(
    "stream_rate",
    f"""WITH w AS (SELECT user_id, unnest(range(0, 6)) AS i, to_timestamp(floor(epoch(ts) / 10) * 10)::TIMESTAMP AS slot, ts FROM {{events}}),
        s AS (SELECT user_id, epoch(ts) AS e, floor(epoch(ts) / 10) * 10 - i * 10 AS start FROM w)
        SELECT user_id, start::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, start HAVING start + 60 <= (SELECT epoch(max(ts)) - 3600 FROM {{events}})""",
)
def stream_rate(t):
    out = _run(t, "events", EVENTS, lambda s: L.stream_rate(_events(s)))
    return out.select("user_id", F.unix_seconds("start").alias("start_s"), "n")


@query(
    "stream_feedback_join",
    "SELECT r.event_id AS run_id, f.event_id AS feedback_id FROM {events} r JOIN {events} f ON r.user_id = f.user_id AND r.event_type = 'click' AND f.event_type = 'view' AND f.ts >= r.ts AND f.ts <= r.ts + INTERVAL 1 HOUR",
)
def stream_feedback_join(t):
    def f(s):
        e = _events(s)
        runs = e.where("event_type = 'click'").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("run_user"), F.col("ts").alias("run_ts"))
        votes = e.where("event_type = 'view'").select(F.col("event_id").alias("feedback_id"), F.col("user_id").alias("feedback_user"), F.col("ts").alias("feedback_ts"))
        return L.stream_feedback_join(runs, votes).select("run_id", "feedback_id")

    return _run(t, "events", EVENTS, f)


def _credit_rows(e):
    """Credit events out of the event log, a credit for each user; a third of the credits start reserved."""
    kind = F.col("event_type")
    event = F.when(kind == "click", "reserve").when(kind == "purchase", "consume").when(kind == "error", "refund").otherwise("note")
    return e.select(F.col("user_id").alias("credit_id"), "ts", "event_id", event.alias("event"), F.when(F.col("user_id") % 3 == 0, "reserved").otherwise("available").alias("start_state"))


#: A reservation of this age goes back.
REFUND_MS = 12 * 3_600_000


def _folded(refund_ms: int | None) -> str:
    """The credits folded event by event; with ``refund_ms`` what is due before an event, or before the last watermark, goes back."""
    due = "false" if refund_ms is None else f"f.state = 'reserved' AND e.ms >= f.since + {refund_ms}"
    left = "false" if refund_ms is None else f"state = 'reserved' AND since + {refund_ms} < (SELECT max(ms) - 3600000 FROM e)"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS credit_id, epoch_ms(ts::TIMESTAMP) AS ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts::TIMESTAMP), event_id) AS k,
            CASE event_type WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'consume' WHEN 'error' THEN 'refund' ELSE 'note' END AS event FROM {{events}}),
        f(credit_id, k, state, applied, since) AS (
            SELECT credit_id, 0::BIGINT, CASE WHEN credit_id % 3 = 0 THEN 'reserved' ELSE 'available' END, 0::BIGINT, ms FROM e WHERE k = 1
            UNION ALL
            SELECT f.credit_id, e.k, n.s, f.applied + CASE WHEN {due} THEN 1 ELSE 0 END + CASE WHEN n.s <> m.s THEN 1 ELSE 0 END, CASE WHEN n.s <> m.s THEN e.ms ELSE f.since END
            FROM f JOIN e ON e.credit_id = f.credit_id AND e.k = f.k + 1, LATERAL (SELECT CASE WHEN {due} THEN 'available' ELSE f.state END AS s) m,
            LATERAL (SELECT CASE WHEN m.s = 'available' AND e.event = 'reserve' THEN 'reserved' WHEN m.s = 'reserved' AND e.event = 'consume' THEN 'consumed'
                                 WHEN m.s = 'reserved' AND e.event = 'refund' THEN 'available' ELSE m.s END AS s) n),
        z AS (SELECT credit_id, arg_max(state, k) AS state, arg_max(applied, k) AS applied, arg_max(since, k) AS since FROM f GROUP BY credit_id)
        SELECT credit_id, CASE WHEN {left} THEN 'available' ELSE state END AS state, applied + CASE WHEN {left} THEN 1 ELSE 0 END AS applied FROM z"""


def _last(out):
    return out.groupBy("credit_id").agg(F.max_by("state", "applied").alias("state"), F.max("applied").alias("applied"))


@query("stream_credits", _folded(None))
def stream_credits(t):
    return _last(_run(t, "events", EVENTS, lambda s: L.stream_credits(_credit_rows(_events(s)))))


@query("stream_credit_timers", _folded(REFUND_MS))
def stream_credit_timers(t):
    """Reservations that nobody ends go back by event time: within the stream before the next event, at its end by timers."""
    return _last(_run(t, "events", EVENTS, lambda s: L.stream_credits(_credit_rows(_events(s)), refund_after_ms=REFUND_MS)))


@query("stream_credits_batch", _folded(None))
def stream_credits_batch(t):
    """The batch fold over the same events, to compare with the stream."""
    from cadastra.operators.ledger import credit_transitions

    events = _credit_rows(_events(t.events))
    credits = events.select("credit_id", F.col("start_state").alias("state")).distinct()
    out = credit_transitions(credits, events.select("credit_id", "ts", "event_id", "event"))
    return out.select("credit_id", F.col("final_state").alias("state"), "applied")
