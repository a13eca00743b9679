"""Queries over answers, claims and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import answers as A
from cadastra.plans.base import query


def _replies(t):
    """Replies of a model, one for each order: fenced, bare or broken JSON."""
    k = F.col("o_orderkey")
    claims = F.concat(F.lit('[{"subject":"height","value":"'), (k % 40).cast("string"), F.lit('.5 m","confidence":0.'), (k % 9 + 1).cast("string"), F.lit('}, {"subject":"lot","value":"1,250 sq.ft","confidence":0.5}]'))
    body = F.concat(F.lit('{"answer":"At most '), (k % 40).cast("string"), F.lit(' m","status":"answered","claims":'), claims, F.lit("}"))
    raw = F.when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 5 == 1, F.lit("{broken")).otherwise(F.concat(F.lit("Here: "), body))
    return t.orders.select(k.alias("answer_id"), A.parse_answers(raw).alias("parsed"))


@query("parse_answers", "SELECT o_orderkey AS answer_id, CASE WHEN o_orderkey % 5 <> 1 THEN 'At most ' || (o_orderkey % 40) || ' m' END AS answer, CASE WHEN o_orderkey % 5 = 1 THEN 'insufficient_source' ELSE 'answered' END AS status FROM {orders}")
def parse_answers(t):
    return _replies(t).select("answer_id", "parsed.answer", "parsed.status")


@query(
    "explode_claims",
    """SELECT o_orderkey AS answer_id, 0 AS idx, 'height' AS subject, (o_orderkey % 40) || '.5 m' AS value, (o_orderkey % 9 + 1) / 10.0 AS confidence FROM {orders} WHERE o_orderkey % 5 <> 1
       UNION ALL SELECT o_orderkey, 1, 'lot', '1,250 sq.ft', 0.5 FROM {orders} WHERE o_orderkey % 5 <> 1""",
)
def explode_claims(t):
    return A.explode_claims(_replies(t))


@query("synthesize_claim", "SELECT o_orderkey AS answer_id, o_orderkey % 40 + 0.5::DOUBLE AS value, 'm' AS unit FROM {orders} WHERE o_orderkey % 5 <> 1")
def synthesize_claim(t):
    c = A.explode_claims(_replies(t)).where("idx = 0").withColumn("v", A.parse_value(F.col("value")))
    return c.select("answer_id", "v.value", "v.unit")


_FEEDBACK = "SELECT event_id AS feedback_id, user_id * 3 % 400 AS claim_id, user_id AS answer_id, event_type IN ('click', 'view') AS flag, event_id % 5 + 1 AS rating, ts AS created_at FROM {events}"


def _feedback(t):
    return t.spark.sql(_FEEDBACK, events=t.events)


@query("claim_verify", f"WITH f AS (SELECT claim_id, arg_max(flag, (created_at, feedback_id)) AS flag FROM ({_FEEDBACK}) GROUP BY claim_id) SELECT o_orderkey AS claim_id, CASE WHEN flag THEN 'verified' WHEN NOT flag THEN 'disputed' ELSE 'open' END AS status FROM {{orders}} LEFT JOIN f ON claim_id = o_orderkey")
def claim_verify(t):
    return A.claim_status(t.orders.select(F.col("o_orderkey").alias("claim_id"), F.lit("open").alias("status")), _feedback(t))


@query("feedback_rollup", f"SELECT answer_id, avg(rating) AS rating, count(rating) AS ratings, count_if(flag) AS flags FROM ({_FEEDBACK}) GROUP BY answer_id")
def feedback_rollup(t):
    return A.feedback_rollup(_feedback(t))


_HITS = """WITH s AS (SELECT question_id, list(DISTINCT source_fragment_id) AS ids FROM {d_candidates} WHERE base_score >= 0.9 GROUP BY 1),
    c AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 4 = 0 THEN [] ELSE [5000000000000 + c_custkey * 1000 + 1, 5000000000000 + c_custkey * 1000 + 2] END AS expected, lower(c_mktsegment) AS k, lower(c_name || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END) AS a FROM {customer}),
    h AS (SELECT c.question_id, len(expected) = 0 OR coalesce(list_has_any(expected, ids), false) AS retrieval_hit, contains(a, k) AS answer_hit FROM c LEFT JOIN s USING (question_id))"""


def _hits(t):
    k = F.col("c_custkey")
    base = k * 1000 + 5000000000000
    cases = t.customer.select(k.alias("question_id"), F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(base + 1, base + 2)).alias("expected_ids"), F.array("c_mktsegment").alias("keywords"))
    answers = t.customer.select(k.alias("question_id"), F.concat("c_name", F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("answer"))
    return A.eval_hits(cases, t.d_candidates.where("base_score >= 0.9"), answers)


@query("eval_hits", _HITS + " SELECT * FROM h")
def eval_hits(t):
    return _hits(t)


@query("eval_report", _HITS + " SELECT count(*) AS cases, count_if(retrieval_hit) AS retrieval_hits, count_if(answer_hit) AS answer_hits FROM h")
def eval_report(t):
    return A.eval_report(_hits(t))
