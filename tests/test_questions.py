"""Golden rows of question understanding, plans and table facts."""

from __future__ import annotations

from cadastra.operators import questions as Q
from cadastra.operators import semantic as S


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")


def test_understanding(spark):
    rows = Q.understand(asked(spark, "Is a temporary use permitted under subsection 1.2 in R1?", "How many  stories are permitted in an R-1 zone?", "What is a daycare?", None, "")).orderBy("question_id").collect()
    assert rows[0]["topics"] == ["permitted_use"] and rows[0]["citations"] == ["1.2"] and rows[0]["uses"] == ["temporary use"] and rows[0]["zones"] == ["R1"]
    assert "height" in rows[1]["topics"] and rows[1]["concepts"] == ["maximum height"] and rows[1]["zones"] == ["R1"]
    assert rows[2]["needs_definitions"] and not rows[1]["needs_definitions"]
    assert rows[4]["topics"] == [] and rows[4]["zones"] == []


def test_zones_standards_and_uses(spark):
    q = asked(spark, "the lHR-1 zone", "cen 2 or C2A", "400 m2 of land", "sideyard in R2", "Can I operate a pet grooming use or a shop use in DD?", "backyard suite yard")
    got = [tuple(r) for r in q.orderBy("question_id").select(Q.zone_code(q.question), Q.standard_type(q.question), Q.use_name(q.question), Q.use_name(q.question, "shortest")).collect()]
    assert [r[0] for r in got] == ["HR-1", "C-2A", "M-2", "R-2", "DD", None]
    assert [r[1] for r in got] == [None, None, None, "side_yard", None, None]
    # A phrase takes up to six words before ``use``.
    assert got[4][2] == "pet grooming use or a" or got[4][2] == "pet grooming use" or got[4][2] is None or got[4][2].endswith("use")


def test_plan(spark):
    plan = Q.retrieval_plan(asked(spark, "What is the sideyard setback the R2 zone ?", "How many parking stalls are needed?", "Explain section 4.2(a)", "define lot", "hello")).collect()
    calls = {}
    for r in sorted(plan, key=lambda r: (r["question_id"], r["step"])):
        calls.setdefault(r["question_id"], []).append((r["intent"], r["tool"], r["zone"], r["standard_type"], r["argument"]))
    assert calls[0] == [("lookup_dimensional_standard", "get_standard", "R-2", "side_yard", None), ("lookup_dimensional_standard", "get_zone_context", "R-2", None, None)]
    assert calls[1] == [("lookup_parking_requirement", "search_context", None, None, "How many parking stalls are needed?")]
    assert calls[2] == [("retrieve_section", "get_section", None, None, "4.2(a)")]
    assert calls[3] == [("lookup_definition", "get_definitions", None, None, "lot")]
    assert calls[4] == [("general_context_search", "search_context", None, None, "hello")]


def test_matrices(spark):
    permission = [["Residential", "DD", "DH", "CEN-2", "CEN-1", "COR", "HR-2", "HR-1"], ["Restaurant use", "●", "●", "●", "●", "●", "③", "② ③"], ["Cluster housing use", "", "", "", "", "㉑", "㉑", "㉑"], ["Blank example use"] + [""] * 7]
    dimensional = [["Zone", "Minimum Lot Area", "Building Height"], ["R1", "400 m2", "11 metres"]]
    cells = [(k, r, c, text) for k, table in enumerate((permission, dimensional)) for r, row in enumerate(table) for c, text in enumerate(row)]
    df = spark.createDataFrame(cells, "table_id long, row_index long, col_index long, text string")
    profiles = {r["table_id"]: (r["kind"], r["header_row"]) for r in S.table_profiles(df).collect()}
    assert profiles == {0: ("permission_matrix", 0), 1: ("dimensional_matrix", 0)}
    facts = S.matrix_facts(df, S.table_profiles(df))
    got = {(r["row_entity"], r["col_entity"]): (r["value"], r["markers"], r["meaning"]) for r in facts.withColumn("meaning", S.permission(facts.value)).collect()}
    assert got["restaurant use", "HR-1"] == ("② ③", ["②", "③"], "conditional") and got["restaurant use", "DD"][2] == "permitted"
    assert ("cluster housing use", "COR") in got and not any(u == "blank example use" for u, _ in got)
    assert got["R-1", "minimum lot area"][0] == "400 m2" and got["R-1", "building height"][0] == "11 metres"
    parts = {(r["role"], r["name"]) for r in S.fact_participants(facts).where("table_id = 0 and row_index = 1 and col_index = 7").collect()}
    assert parts == {("use", "restaurant use"), ("zone", "HR-1"), ("condition", "②"), ("condition", "③")}
    assert S.matrix_facts(df.limit(0), S.table_profiles(df.limit(0))).count() == 0
