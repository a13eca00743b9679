"""The flagship: every channel and expansion brings something, on a small hand-made corpus and on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators.retrieval import hash_embed, hybrid_search
from cadastra.registry import flagship


def corpus(spark):
    fragments = spark.createDataFrame(
        [(1, 1, None, "Part 1 Regions"), (2, 1, 1, "Minimum lot area in the R-1 zone"), (3, 1, 1, "Signs"), (4, 1, 1, "Fences"), (9, 1, None, "Sizes of parcels"), (10, 1, None, None)], "fragment_id long, document_id long, parent_fragment_id long, text string"
    )
    cells = spark.createDataFrame([(5, 0, 0, "Zone"), (5, 0, 1, "Minimum Lot Area"), (5, 1, 0, "R-1"), (5, 1, 1, "400 metres"), (5, 2, 0, "R-2"), (5, 2, 1, "500 metres")], "table_id long, row_index long, col_index int, text string")
    facts = spark.createDataFrame([(51, "dimensional_standard", "R-1", "minimum lot area", "400 metres", 0.9), (52, "dimensional_standard", "R-2", "minimum lot area", "500 metres", 0.9)], "fact_id long, relation_type string, row_entity string, col_entity string, value string, confidence double")
    parts = spark.createDataFrame([(51, "zone", "R-1"), (51, "standard", "minimum lot area"), (52, "zone", "R-2"), (52, "standard", "minimum lot area")], "fact_id long, role string, name string")
    refs = spark.createDataFrame([(2, 9), (2, None)], "fragment_id long, target_fragment_id long")
    votes = spark.createDataFrame([], "source_fragment_id long, vote string")
    return fragments, cells, facts, parts, refs, votes


def test_channels_and_expansions(spark):
    fragments, cells, facts, parts, refs, votes = corpus(spark)
    asked = spark.createDataFrame([(1, "What is the minimum lot area in the R-1 zone?"), (2, "")], "question_id long, question string")
    found = hybrid_search(asked, fragments, cells, facts, parts, refs, votes).where("question_id = 1").collect()
    by = {(r["source_type"], r["source_id"]): (r["retrieval_channel"], r["expansion"]) for r in found}
    assert by["fact", 51] == ("semantic", None) and ("fact", 52) not in by
    assert by["table", 5_000_010] == ("table", None)
    assert by["fragment", 2] == ("text", None)
    assert {("fragment", 1), ("fragment", 3), ("fragment", 9)} <= set(by)
    assert {c for c, _ in by.values()} >= {"semantic", "table", "text", "hierarchy"}
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == sorted({r["rank"] for r in found})
    stored = hash_embed(fragments, "fragment_id", "text")
    again = hybrid_search(asked, fragments, cells, facts, parts, refs, votes, vectors=stored).where("question_id = 1").collect()
    assert {(r["source_type"], r["source_id"], r["rank"]) for r in again} == {(r["source_type"], r["source_id"], r["rank"]) for r in found}


def test_budget_prefers_facts_and_tables(spark):
    asked = spark.createDataFrame([(1, "What is the minimum lot area in the R-1 zone?")], "question_id long, question string")
    found = hybrid_search(asked, *corpus(spark), budget=14).collect()
    assert [r["source_type"] for r in found] == ["fact"]  # the first candidate stays whatever it costs


def test_given_tables(spark):
    found = flagship(spark, "/root/testdata/sf0.001")
    kinds = {r[0]: r[1] for r in found.groupBy("source_type").agg(F.count_distinct("question_id")).collect()}
    assert set(kinds) == {"fact", "table", "fragment"} and min(kinds.values()) >= 2
    assert found.groupBy("question_id").agg(F.max("used_tokens").alias("u")).where("u > 3000").count() == 0
