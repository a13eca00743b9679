"""Edges between facts and entities, on golden rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import factgraph as G
from cadastra.operators import retrieval as R
from cadastra.operators import semantic as S
from cadastra.plans.base import Tables
from cadastra.registry import QUERIES


def test_condition_edges_lead_to_sections(spark):
    texts = [(1, 10, "3", "[1] applies as Section 4 and section  5 say"), (1, 11, "4", "Corner lots"), (1, 12, "5", "[2] and [1] apply"), (2, 20, "4", "[1] of another document"), (1, 13, "6", None)]
    fragments = spark.createDataFrame(texts, "document_id bigint, fragment_id bigint, citation_label string, text string")
    cells = spark.createDataFrame(
        [(7, 1, 1, "permission", "office use", [], "DD", "[1]", ["[1]"], 1), (7, 2, 1, "permission", "shop use", [], "DD", "x", [], 1), (8, 1, 1, "requirement", "lot area", ["additions"], "additions", "4 [2]", ["[2]"], 1)],
        "table_id bigint, row_index bigint, col_index int, relation_type string, row_entity string, row_contexts array<string>, col_entity string, value string, markers array<string>, document_id bigint",
    )
    g = G.united(G.condition_graph(fragments), G.matrix_graph(cells))
    names = {r["entity_id"]: (r["document_id"], r["name"]) for r in g.participants.collect()}
    edges = sorted((r["edge_type"], r["source"], names[r["target_id"]], r["confidence"]) for r in g.edges.collect())
    assert edges == [
        ("conditioned_by", "cell 7 1 1", (1, "[1]"), 0.85),
        ("conditioned_by", "cell 8 1 1", (1, "[2]"), 0.8),
        ("references", "fragment 10", (1, "Section 4"), 0.8),
        ("references", "fragment 10", (1, "section 5"), 0.8),
    ]
    facts = {r["fact_id"] for r in g.facts.collect()}
    assert len(facts) == 7 and {r["source_id"] for r in g.edges.collect()} <= facts

    seeds = g.edges.where("source = 'cell 7 1 1'").selectExpr("1 as question_id", "source_id as fact_id")
    found = R.walk_facts(seeds, g.participants, g.facts, g.edges, g.sources, G.section_targets(g.participants, fragments))
    got = {r["fragment_id"]: (r["depth"], r["expansion"]) for r in found.collect()}
    # The cell's condition is defined in 10 and 12; 10 names 11 and 12 as sections. Document 2 is out of reach.
    assert got.keys() == {10, 11, 12} and got[10] == (2, "semantic_fact_source") and got[11] == (3, "semantic_section_reference")
    # 12 is both; the fact with the smaller id comes first.
    assert got[12] in ((2, "semantic_fact_source"), (3, "semantic_section_reference"))


def test_ids_are_stable_and_apart(spark):
    row = spark.range(1).select(*[G.object_id(*[F.lit(p) for p in parts]).alias(f"c{i}") for i, parts in enumerate([("a", "bc"), ("ab", "c"), ("a", "bc"), ("a", None), ("a", "")])]).first()
    assert row["c0"] == row["c2"] != row["c1"] and row["c3"] == row["c4"] and len(row["c0"]) == 32


def test_walk_reads_no_more_than_the_nodes_that_count(spark, monkeypatch):
    facts = spark.range(400).selectExpr("id as fact_id", "if(id % 2 = 0, 'permission', 'definition') as relation_type")
    participants = facts.selectExpr("fact_id", "9000L as entity_id", "'zone' as role")
    sources = facts.selectExpr("fact_id", "fact_id + 10000 as fragment_id")
    edges = spark.createDataFrame([], "source_kind string, source_id long, target_kind string, target_id long, edge_type string")
    sections = spark.createDataFrame([], "entity_id long, fragment_id long")
    seeds = spark.createDataFrame([(q, q) for q in range(3)], "question_id long, fact_id long")
    kept, write = [], R.written

    def count(df):
        out = write(df)
        kept.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(R, "written", count)
    found = {}
    for r in R.walk_facts(seeds, participants, facts, edges, sources, sections).orderBy("question_id", "rank").collect():
        found.setdefault(r["question_id"], []).append((r["fragment_id"] - 10000, r["depth"], r["expansion"], r["score"]))
    for q in range(3):
        # Definitions come before permissions, by id; the question's own fact is the first.
        want = [(q, 0, "semantic_fact_source", 8.0)] + [(i, 2, "semantic_fact_source", 7.0) for i in range(1, 400, 2) if i != q]
        assert found[q] == want[:25]
    # 25 of the 200 nodes of the second level give all that a question lacks.
    assert sum(n for columns, n in kept if "order" in columns) <= 3 * 26
    hops = participants.selectExpr("0 as from_fact", "entity_id as from_id", "1 as fact", "fact_id as id", "200 as place")
    assert sorted(r["id"] for r in R._first_hops(hops, 300).collect()) == list(range(300)) and R._first_hops(hops, 400) is hops


def test_walks_begin_at_conditional_facts_of_every_row(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    facts = S.matrix_facts(t.d_tables, S.table_profiles(t.d_tables)).where("size(markers) > 0").withColumn("document_id", F.col("table_id").cast("long"))
    place = [F.col(c) for c in ("table_id", "row_index", "col_index")]
    known = facts.select(G.object_id(F.lit("fact"), F.col("document_id"), F.col("relation_type"), *place).alias("question_id"), (F.col("row_index") % 20).alias("r"))
    walked = QUERIES["fact_walk"](spark, t.sf_dir).select("question_id").distinct()
    assert walked.join(known, "question_id", "left_anti").isEmpty()
    assert walked.join(known, "question_id").where("r <> 1").count() > 0  # rows were taken one in twenty
