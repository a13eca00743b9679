"""Answers: parsing, claims, feedback, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "answer string, status string, claims array<struct<subject:string,value:string,confidence:double>>"


def parse_answers(raw: Column) -> Column:
    """struct(answer, status, claims) from a reply: fences go, the outermost braces count; what does not parse becomes insufficient_source."""
    body = F.regexp_extract(F.regexp_replace(raw, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, ANSWER)
    bad = F.struct(F.lit(None).cast("string").alias("answer"), F.lit("insufficient_source").alias("status"), F.array().cast("array<struct<subject:string,value:string,confidence:double>>").alias("claims"))
    return F.when(parsed.isNull() | parsed["answer"].isNull(), bad).otherwise(parsed)


def explode_claims(answers: DataFrame) -> DataFrame:
    """One row per claim of parsed answers (answer_id, parsed)."""
    return answers.select("answer_id", F.posexplode("parsed.claims").alias("idx", "c")).select("answer_id", F.col("idx").cast("long").alias("idx"), "c.subject", "c.value", "c.confidence")


def parse_value(t: Column) -> Column:
    """struct(value double, unit) of the first number with a unit."""
    pattern = r"(\d[\d,]*(?:\.\d+)?)\s*([A-Za-z.%/]+)?"
    return F.struct(F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit("")).try_cast("double").alias("value"), F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")).alias("unit"))


def claim_status(claims: DataFrame, feedback: DataFrame) -> DataFrame:
    """Claims with the verdict of their latest feedback: verified, disputed, or as they were."""
    latest = feedback.groupBy("claim_id").agg(F.max_by("flag", F.struct("created_at", "feedback_id")).alias("flag"))
    joined = claims.join(latest, "claim_id", "left")
    return joined.withColumn("status", F.when(F.col("flag"), "verified").when(~F.col("flag"), "disputed").otherwise(F.col("status"))).drop("flag")


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    """Mean rating, number of ratings and of flags of each answer."""
    return feedback.groupBy("answer_id").agg(F.avg("rating").alias("rating"), F.count("rating").alias("ratings"), F.count_if("flag").alias("flags"))


def eval_hits(cases: DataFrame, selected: DataFrame, answers: DataFrame) -> DataFrame:
    """retrieval_hit: any expected id among the selected (true where none is expected); answer_hit: all keywords in the answer."""
    ids = selected.groupBy("question_id").agg(F.collect_set("source_fragment_id").alias("ids"))
    joined = cases.join(ids, "question_id", "left").join(answers, "question_id", "left")
    retrieved = (F.size("expected_ids") == 0) | F.coalesce(F.arrays_overlap("expected_ids", "ids"), F.lit(False))
    low = F.lower(F.coalesce("answer", F.lit("")))
    return joined.select("question_id", retrieved.alias("retrieval_hit"), F.forall("keywords", lambda k: low.contains(F.lower(k))).alias("answer_hit"))


def eval_report(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("cases"), F.count_if("retrieval_hit").alias("retrieval_hits"), F.count_if("answer_hit").alias("answer_hits"))
