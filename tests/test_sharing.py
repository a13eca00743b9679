"""Equal requests are answered once, and no join gives more rows than the answers need."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadastra.operators import evidence as E
from cadastra.operators import retrieval as R
from cadastra.operators import semantic as S
from cadastra.operators import structure as T


@pytest.fixture
def joined(spark):
    """Rows of a frame, and the most rows that one of its joins gave."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def run(df):
        rows = df.collect()
        df._jdf.collectToPython()

        def most(node):
            metrics = node.metrics()
            own = metrics.apply("numOutputRows").value() if "Join" in node.nodeName() and metrics.contains("numOutputRows") else 0
            children = node.children()
            return max([own, *[most(children.apply(i)) for i in range(children.size())]])

        return rows, most(df._jdf.queryExecution().executedPlan())

    yield run
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_permission_rows_reads_equal_calls_once(spark, joined):
    cells = spark.createDataFrame([(1, r, c, "Red shop" if r and not c else ("DD", "HR-1", "CEN-2")[c - 1] if not r else "P") for r in range(4) for c in range(4) if r or c], "table_id long, row_index long, col_index int, text string")
    calls = spark.createDataFrame([(i, "red shop", None if i % 2 else "DD") for i in range(50)], "question_id long, use string, zone string")
    rows, most = joined(E.permission_rows(calls, cells))
    assert len(rows) == 150 and most <= 150
    assert {r["text"] for r in rows if r["question_id"] == 1} == {"red shop: DD=P; HR-1=P; CEN-2=P"}
    assert {r["text"] for r in rows if r["question_id"] == 2} == {"red shop: DD=P"}


def test_fact_match_meets_facts_once(spark, joined):
    requests = spark.createDataFrame([(q, ["permission"], *e) for q in range(40) for e in (("zone", "DD"), ("condition_ref", "[1]"))], "question_id long, relation_types array<string>, entity_type string, name string")
    participants = spark.createDataFrame([(f, "zone", "DD") for f in range(30)] + [(7, "condition_ref", "[1]")], "fact_id long, entity_type string, name string")
    facts = spark.createDataFrame([(f, "permission", 0.5) for f in range(30)], "fact_id long, relation_type string, confidence double")
    rows, most = joined(S.fact_match(requests, participants, facts))
    assert sorted(tuple(r) for r in rows) == [(q, 7, 5.5) for q in range(40)] and most <= 40


def test_table_candidates_meet_cells_once(spark, joined):
    questions = spark.createDataFrame([(q, ["red"], "DD") for q in range(60)], "question_id long, terms array<string>, zone string")
    cells = spark.createDataFrame([(1, r, 0, "red") for r in range(1, 41)] + [(1, 9, 1, "dd")], "table_id long, row_index long, col_index int, text string")
    rows, most = joined(R.table_candidates(questions, cells, k=2))
    assert {tuple(r[c] for c in ("row_index", "base_score", "rank")) for r in rows} == {(9, 3.0, 1), (1, 1.0, 2)}
    assert len(rows) == 120 and most <= 120


def test_score_keyword_scores_equal_requests_once(spark, joined):
    requests = spark.createDataFrame([(q, "yard", 1) for q in range(30)], "question_id long, query string, document_id long")
    fragments = spark.createDataFrame([(f, 1, "front yard" if f < 3 else "x", "", "", "parsed") for f in range(200)], "fragment_id long, document_id long, text string, citation_label string, citation_path string, parse_status string")
    rows, most = joined(R.score_keyword(requests, fragments))
    assert len(rows) == 90 and {r["base_score"] for r in rows} == {25.0} and most <= 200


def test_a_label_of_many_fragments_brings_its_first(spark, joined):
    fragments = spark.createDataFrame([(f, 1, "(1)", f // 4) for f in range(500)], "fragment_id long, document_id long, citation_label string, page_start long")
    refs = spark.createDataFrame([(i, 1, "clause (1)") for i in range(20)], "ref_id long, document_id long, ref string")
    rows, most = joined(E.resolve_section_refs(refs, fragments))
    assert sorted((r["fragment_id"], r["rank"]) for r in rows if r["ref_id"] == 5) == [(0, 1), (1, 2), (2, 3)]
    assert len(rows) == 60 and most <= 500
    calls = refs.select("ref_id", "document_id").selectExpr("ref_id as question_id", "document_id", "'(1)' as citation_label")
    rows, most = joined(E.sections(calls, fragments))
    assert len(rows) == 20 and {(r["source_fragment_id"], r["n"]) for r in rows} == {(0, 500)} and most <= 500


def test_rings_end_after_as_many_rounds_as_ways_to_them_are_long(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(T, "cut", lambda df: rounds.append(1) or df.localCheckpoint())
    ring = [(i, i + 1 if i % 3 < 2 else i - 2) for i in range(600)]  # rings of three
    tails = [(1000 + i, 999 + i if i else 0) for i in range(5)] + [(2000, 2001), (2001, None)]
    got = T.cycles(spark.createDataFrame(ring + tails, "fragment_id long, parent_fragment_id long"))
    assert sorted(r[0] for r in got.collect()) == list(range(600))
    assert len(rounds) <= 10  # two writes a round; it was as many rounds as the logarithm of all fragments


def test_texts_and_questions_of_a_kind_meet_once(spark, joined):
    texts = spark.createDataFrame([(i, "Yard of a house") for i in range(100)] + [(200, "House, yard and roof"), (201, "roof")], "source_fragment_id long, text string")
    questions = spark.createDataFrame([(q, f"house yard roof unheard{q}") for q in range(40)], "question_id long, question string")
    rows, most = joined(R.keyword_candidates(questions, texts, 3))
    assert sorted((r["source_fragment_id"], r["rank"], r["base_score"]) for r in rows if r["question_id"] == 7) == [(0, 2, 0.5), (1, 3, 0.5), (200, 1, 0.75)]
    assert len(rows) == 120 and most <= 300
    calls = spark.createDataFrame([(1, "yard"), (2, "yard"), (3, "none")], "question_id long, question string")
    found = E.search_context(calls, texts.withColumnRenamed("source_fragment_id", "fragment_id"), (("roof", 2.0), ("house", 1.0)), 2).collect()
    assert sorted((r["question_id"], r["source_fragment_id"], r["base_score"]) for r in found) == [(q, f, s) for q in (1, 2) for f, s in ((0, 2.0), (200, 3.0))]


def test_ranges_of_pages_meet_before_their_members(spark, joined):
    fragments = spark.createDataFrame([(f, 1, 5, 7) for f in range(30)] + [(99, 2, 5, 7)], "fragment_id long, document_id long, page_start long, page_end long")
    tables = spark.createDataFrame([(t, 1, 5, 8) for t in range(30)] + [(88, 1, 8, 9)], "table_id long, document_id long, page_start long, page_end long")
    rows, most = joined(R.related_tables(fragments, tables))
    assert sorted(tuple(r) for r in rows) == [(f, t) for f in range(30) for t in range(30)] and most <= 900


def test_graph_walk_without_a_cap_keeps_every_node(spark):
    edges = spark.createDataFrame([(0, i, "references") for i in range(1, 151)] + [(150, 151, "references")], "source_id long, target_id long, edge_type string")
    seeds = spark.createDataFrame([(1, 0)], "question_id long, node_id long")
    assert R.expand_graph(seeds, edges, max_nodes=None).count() == 152
    assert R.expand_graph(seeds, edges).count() == 101


def test_terms_are_defined_in_quotes_and_in_small_letters_too(spark, joined):
    texts = ['"Lot 5" means a parcel', "lot 5 means a parcel", "Lot 5 means a parcel\nand more", "Lot 51 means a field", "A lot has meaning"]
    terms = S.defined_terms(spark.createDataFrame(list(enumerate(texts)), "fragment_id long, text string"))
    assert sorted(tuple(r) for r in terms.collect()) == [(0, "lot 5"), (1, "lot 5"), (2, "lot 5"), (3, "lot 51")]
    calls = spark.createDataFrame([(q, "Lot 5") for q in range(30)], "question_id long, term string")
    rows, most = joined(E.definitions(calls, terms))
    assert sorted(tuple(r) for r in rows if r["question_id"] == 3) == [(3, 0, 3.0), (3, 1, 3.0), (3, 2, 3.0), (3, 3, 2.0)] and most <= 120


def test_a_graph_within_documents(spark):
    from cadastra.operators import factgraph as G

    g = G.condition_graph(spark.createDataFrame([(d, d * 10, "[1] by Section 4") for d in (1, 2, 3)], "document_id long, fragment_id long, text string"))
    part = G.within(g, spark.createDataFrame([(2,)], "document_id long"))
    assert [r["document_id"] for r in part.facts.collect()] == [2] and [r["fragment_id"] for r in part.sources.collect()] == [20]
    assert {r["document_id"] for r in part.participants.collect()} == {2} and part.edges.count() == 1


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_equal_texts_are_read_once(spark, monkeypatch, broadcast):
    """Frequent, rare and null texts give all their rows, whichever way what was read meets them."""
    from cadastra.operators import sharing

    monkeypatch.setattr(sharing, "BROADCAST_TEXTS", broadcast)
    monkeypatch.setattr(sharing, "FREQUENT", 4)
    sizes = []

    def read(rows):
        sizes.append(rows.count())
        return rows.select("*", F.explode(F.split(F.coalesce("text", F.lit("none at all")), " ")).alias("word"))

    text = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 0, "a b").otherwise(F.concat(F.lit("c "), (F.col("id") % 30).cast("string")))
    rows = spark.range(300).select("id", text.alias("text"))
    got = sharing.read_once(rows, "text", read)
    assert got.columns == ["id", "text", "word"] and sizes == [14]
    assert sorted(got.collect(), key=str) == sorted(read(rows).collect(), key=str)


def test_few_equal_texts_are_read_where_they_are(spark):
    from cadastra.operators.sharing import read_once

    rows = spark.range(10).select("id", F.col("id").cast("string").alias("text"))
    assert read_once(rows, "text", lambda r: r.withColumn("n", F.length("text"))).agg(F.sum("n")).first()[0] == 10


def test_page_risk_counts_ranges_before_pages(spark, joined):
    fragments = spark.createDataFrame([(1, i, "uncertain", 0, "clause", False, 1, 20) for i in range(1, 101)], "document_id long, fragment_id long, parse_status string, parent_fragment_id long, fragment_type string, duplicate boolean, page_start int, page_end int")
    refs = fragments.selectExpr("fragment_id", "'unresolved' as status")
    blocks = spark.createDataFrame([], "document_id long, page int, block_type string, is_boilerplate boolean, accounted boolean, fallback boolean")
    rows, most = joined(T.page_risk(fragments, refs, blocks, spark.createDataFrame([], "document_id long, page int")))
    assert {r["page"]: r["score"] for r in rows} == {p: 400 for p in range(1, 21)} and most <= 100


def test_ancestors_of_some_fragments(spark):
    f = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 1), (4, 2)], "fragment_id long, parent_fragment_id long")
    some = spark.createDataFrame([(0,), (2,), (3,)], "fragment_id long")
    assert {r[0]: r[1] for r in T.ancestor_chain(f, some).collect()} == {2: [0, 1], 3: [0, 1]}
