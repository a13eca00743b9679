"""Golden rows of single operators, on inline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import blocks as B
from cadastra.operators import ledger as L
from cadastra.operators import semantic as S
from cadastra.operators import structure as T
from cadastra.sources import files


def one(spark, column_of, text):
    return spark.createDataFrame([(text,)], "t string").select(column_of(F.col("t")).alias("v")).first()["v"]


def test_block_types(spark):
    cases = {
        "": "unknown", "Lot coverage ..... 12": "heading", "45 m2": "paragraph", "a | b": "table_region", "(a) the use": "list_item",
        "Part 1 - General": "heading", "GENERAL PROVISIONS": "heading", "* item of a list": "list_item", "this is running prose, with a full stop.": "paragraph",
    }
    for text, kind in cases.items():
        assert one(spark, B.classify_block, text) == kind, text


def test_citations(spark):
    cases = {"Part IV: x": None, "Part 4: x": ("part", "Part 4", 1), "schedule b": ("schedule", "Schedule B", 1), "12": ("section", "12", 2), "1.2.3.4 t": ("subsection", "1.2.3.4", 5), "(iv) x y": ("subclause", "(iv)", 6), "(a) x": ("clause", "(a)", 5), "1/2 of it": None, "plain": None}
    for text, want in cases.items():
        got = one(spark, B.citation, text)
        assert (got and (got["type"], got["label"], got["level"])) == want, text


def test_references_take_ranges(spark):
    f = spark.createDataFrame([(1, 10, "Sections 44 to 47 inclusive and Schedule c, subject to 5.1"), (1, 11, None)], "document_id long, fragment_id long, text string")
    got = {(r["raw"], r["target"]) for r in T.detect_references(f).collect()}
    assert ("Sections 44 to 47 inclusive", "44 to 47") in got and ("Schedule c", "Schedule C") in got and ("subject to 5.1", "5.1") in got
    labels = spark.createDataFrame([(1, 44, "44", 1)], "document_id long, fragment_id long, citation_label string, reading_order long")
    hit = {r["target"]: r["target_fragment_id"] for r in T.resolve_references(T.detect_references(f), labels).collect()}
    assert hit["44 to 47"] == 44 and hit["5.1"] is None


def test_zones(spark):
    assert one(spark, S.extract_zones, "lHR-1 and HR 2 at 400 m2 in DD") == ["DD", "HR-1", "HR-2"]
    assert one(spark, S.extract_standards, "the minimum lot area and parking spaces, no parking") == ["minimum lot area", "parking spaces"]
    assert one(spark, S.extract_condition_refs, "\u25cf \u2461 [3]") == ["[3]", "\u2461"]


def test_cycle(spark):
    f = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "fragment_id long, parent_fragment_id long")
    assert {r[0] for r in T.cycles(f).collect()} == {1, 2, 3}


def test_requirement_values(spark):
    for text, want in {"12 m": True, "12 square feet": True, "45 ft, except on corner lots": True, "45 ft from the line": False, "twelve m": False}.items():
        assert one(spark, B.requirement_value, text) is want, text


def test_profile_keeps_old_values(spark):
    users = spark.createDataFrame([(1, "a@x", "A"), (2, "b@x", "B")], "user_id long, email string, name string")
    feed = spark.createDataFrame([(1, "updated", 1, None, "AA"), (2, "deleted", 2, None, None), (3, "updated", 3, "c", None), (4, "created", 4, "d@x", None)], "user_id long, kind string, ts long, email string, name string")
    got = {r["user_id"]: (r["email"], r["name"]) for r in L.profile_changes(users, feed).collect()}
    assert got == {1: ("a@x", "AA"), 4: ("d@x", None)}


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"ID":"1"},"geometry":{"type":"Point"}},{"properties":{"ID":"1"},"geometry":{"type":"Point"}},{"properties":{},"geometry":{"type":"Point"}},{"properties":{"ID":"2"},"geometry":null}]}')
    good, bad = files.clean_features(files.read_geojson(spark, str(tmp_path / "a.geojson")), "ID")
    assert [r["feature_key"] for r in good.collect()] == ["1"]
    assert sorted(r["warning"] for r in bad.collect()) == ["duplicate key", "no geometry", "no key"]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Part 1")
    (tmp_path / "b.bin").write_text("x")
    got = files.ingest_files(spark, str(tmp_path)).collect()
    assert [(r["text"], r["mime_type"]) for r in got] == [("Part 1", "text/plain")]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "document_id int, v string")
    files.replace_partitions(rows, str(tmp_path / "t"))
    files.replace_partitions(rows.where("document_id = 1").withColumn("v", F.lit("z")), str(tmp_path / "t"))
    assert {(r["document_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "z"), (2, "y")}


def test_any_citation_is_a_citation(spark):
    lines = ["Part IV: x", "Part 4: x", "schedule b", "12", "1.2.3.4 t", "(iv) x y", "(a) x", "1/2 of it", "1.5/2", "plain", "(1.2) x", "(1.2)", "3(a)(i) x", "3(a)", "12a", "12) b", "(abcd) x", "(ab) x", "", " 7  x", "Partly 4", "part of it", "appendix C - d", "1.2.3.4.5.6.7.8 x"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    got = df.select("t", B.citation(df.t).isNotNull().alias("a"), B.has_citation(df.t).alias("b")).collect()
    assert [(r["t"], r["a"]) for r in got] == [(r["t"], r["b"]) for r in got]


def test_block_types_by_branch(spark):
    """One block for each branch of the cascade, in its order, with and without a place on the page."""
    cases = [
        ("  \n ", None, None, "unknown"), ("Front yards ..... 12", None, None, "heading"), ("12 metres", 0.0, 5.0, "paragraph"), ("xiv", 0.0, 5.0, "header"), ("- 7", 0.0, 5.0, "list_item"), ("17", 95.0, 99.0, "footer"), ("17", 50.0, 60.0, "heading"),
        ("use\tstalls", 50.0, 60.0, "table_region"), ("Use\nminimum\n12 m2", None, None, "table_region"), ("[3]applies to corner lots only", None, None, "footnote"), ("4 spaces are needed for each unit", None, None, "footnote"), ("(iv) any lobby", None, None, "list_item"),
        ("12.1 Side yards", None, None, "heading"), ("12.1 " + "Side yards of a house " * 9, None, None, "list_item"), ("Side Yards", None, None, "heading"), ("the  minimum", None, None, "table_region"), ("RULES FOR ALL ZONES: PART ONE", None, None, "heading"),
        ("this runs on at the top of a page.", 1.0, 5.0, "header"), ("this runs on at the end of a page.", 95.0, 99.0, "footer"), ("this runs on, in the middle of it.", 40.0, 50.0, "paragraph"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, y0 double, y1 double, kind string")
    got = df.select("i", "kind", B.classify_block(F.col("t"), F.col("y0"), F.col("y1"), F.lit(100.0)).alias("found")).collect()
    assert [(cases[r["i"]][0], r["found"]) for r in got if r["found"] != r["kind"]] == []


def test_table_like_lines(spark):
    cases = {
        "Zone\nminimum\n12 m": True, "Zone\n12 m\n14%": False, "Zone\n12 m": False, "a b\nc d": False, "short one\nshort two\nshort  three": True, "12 m\n14 m": False, "1.2 Yards\n3.4 Sheds\n5.6 Walls\n12%\n14%": False,
        "1.1 A rule stands here\nand this prose goes on for nine words or so\nand on": False, "PAGE Zone\nminimum\n12 m": True, None: None, "": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", B.table_like(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_definitions_of_fragments(spark):
    rows = [(1, "Lot Line means a line.\nIt may bend."), (2, '"Lot" means a parcel'), (3, "lot means a parcel"), (4, "  Daycare (home) means care"), (5, "Lot\nmeans more"), (6, None), (7, "Yard means "), (8, "Every lot is a means of use")]
    df = spark.createDataFrame([(1, *r) for r in rows], "document_id long, fragment_id long, text string")
    got = {r["fragment_id"]: (r["term"], r["meaning"]) for r in S.definition_facts(df).collect()}
    assert got == {1: ("lot line", "a line."), 4: ("daycare (home)", "care"), 5: ("lot", "more"), 8: ("every lot is a", "of use")}
