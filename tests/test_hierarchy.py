"""Golden trees: each rule of attachment, in documents of a few blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadastra.operators import blocks as B
from cadastra.operators.hierarchy import REGIONAL, Rules, hierarchy_full

SCHEMA = "document_id long, page_number long, reading_order long, raw_text string, block_type string, is_boilerplate boolean"
H, L, P, N, T = "heading", "list_item", "paragraph", "footnote", "table_region"

#: name: (rules, blocks as (type, text), fragments as (label, type, parent, path, status, confidence))
TREES = {
    "sections and prose": (
        Rules(),
        [(H, "Part 2 Zones"), (H, "2.1 Purpose"), (P, "What the zones are for."), (L, "(a) to keep order;"), (P, "Prose leaves the clause.")],
        [
            ("Part 2", "part", None, "Part 2", "parsed", 0.95),
            ("2.1", "subsection", 0, "Part 2 > 2.1", "parsed", 0.9),
            (None, "prose", 1, None, "parsed", 0.8),
            ("(a)", "clause", 1, "Part 2 > 2.1 > (a)", "parsed", 0.85),
            (None, "prose", 1, None, "parsed", 0.8),
        ],
    ),
    "alone": (Rules(), [(P, "nothing above this sentence.")], [(None, "prose", None, None, "uncertain", 0.5)]),
    "clauses without a section": (Rules(), [(L, "(a) one of them."), (L, "(b) the other.")], [("(a)", "clause", None, None, "uncertain", 0.6), ("(b)", "clause", None, None, "uncertain", 0.6)]),
    "notes and tables": (
        Rules(),
        [(H, "7 Parking"), (N, "1 space for each unit of the building"), (T, "a | b"), ("footer", "page 7"), (P, "Spaces are paved.")],
        [("7", "section", None, "7", "parsed", 0.9), (None, "footnote", 0, None, "parsed", 0.75), (None, "prose", 0, None, "parsed", 0.8)],
    ),
    "same path twice": (
        Rules(),
        [(H, "26 Parking"), (L, "(g) first"), (L, "(g) second")],
        [("26", "section", None, "26", "parsed", 0.9), ("(g)", "clause", 0, None, "uncertain", 0.6), ("(g)", "clause", 0, None, "uncertain", 0.6)],
    ),
    "bullets": (
        Rules(),
        [(H, "3 Signs"), (L, "* lit signs"), (L, "- flat signs"), (P, "No others.")],
        [("3", "section", None, "3", "parsed", 0.9), (None, "list_item", 0, None, "uncertain", 0.7), (None, "list_item", 1, None, "uncertain", 0.7), (None, "prose", 0, None, "parsed", 0.8)],
    ),
    "roman items without promotion": (
        Rules(),
        [(H, "10 Homes"), (H, "(a) FOR R-2 USES"), (L, "(i) width"), (L, "(ii) depth")],
        [("10", "section", None, "10", "parsed", 0.9), ("(a)", "clause", 0, "10 > (a)", "parsed", 0.85), ("(i)", "clause", 0, "10 > (i)", "parsed", 0.85), ("(ii)", "subclause", 2, "10 > (i) > (ii)", "parsed", 0.85)],
    ),
    "roman items under a heading": (
        REGIONAL,
        [(L, "10(3) More than one home may stand on a lot."), (H, "(a) FOR R-2 USES"), (L, "(i) the first measure of all;"), (L, "(v) the last one.")],
        [
            ("10(3)", "subsection", None, "10(3)", "parsed", 0.9),
            ("(a)", "clause", 0, "10(3) > (a)", "parsed", 0.85),
            ("(i)", "subclause", 1, "10(3) > (a) > (i)", "parsed", 0.85),
            ("(v)", "subclause", 1, "10(3) > (a) > (v)", "parsed", 0.85),
        ],
    ),
    "roman item after a full sentence": (
        REGIONAL,
        [(L, "(h) Plane 8 means the plane between C and S."), (L, "(i) Plane 9 means the plane between E and U.")],
        [("(h)", "clause", None, None, "uncertain", 0.6), ("(i)", "clause", None, None, "uncertain", 0.6)],
    ),
    "roman items of a definition": (
        REGIONAL,
        [(P, '"Open land" means:'), (L, "(i) owned by all;"), (L, "(ii) burial grounds;")],
        [(None, "prose", None, None, "uncertain", 0.5), ("(i)", "clause", 0, None, "uncertain", 0.6), ("(ii)", "clause", 0, None, "uncertain", 0.6)],
    ),
    "list of definitions": (
        Rules(),
        [(P, "Before all."), (H, "DEFINITIONS"), (L, "In this by-law:"), (P, '"Shed" means a small building that is:'), (L, "(a) not lived in;"), (H, "LAND USE"), (P, "' Brook' means running water."), (L, "\"Barn\" - see Shed"), (H, "9 Rules"), (P, "Yard means open land.")],
        [
            (None, "prose", None, None, "uncertain", 0.5),
            (None, "heading", None, None, "uncertain", 0.55),
            (None, "list_item", 1, None, "parsed", 0.7),
            (None, "prose", 2, None, "parsed", 0.8),
            ("(a)", "clause", 3, None, "uncertain", 0.6),
            (None, "heading", None, None, "uncertain", 0.55),
            (None, "prose", 2, None, "parsed", 0.8),
            (None, "list_item", 2, None, "parsed", 0.7),
            ("9", "section", None, "9", "parsed", 0.9),
            (None, "prose", None, None, "uncertain", 0.5),
        ],
    ),
    "words that define": (REGIONAL, [(H, "Definitions"), (L, "In this bylaw:"), (P, '"Rear Yard" shall mean a yard at the back.')], [(None, "heading", None, None, "uncertain", 0.55), (None, "list_item", 0, None, "parsed", 0.7), (None, "prose", 1, None, "parsed", 0.8)]),
    "section under a heading": (Rules(), [(H, "GENERAL RULES"), (H, "5.2 Fences"), (H, "6 Walls")], [(None, "heading", None, None, "uncertain", 0.55), ("5.2", "subsection", 0, "5.2", "parsed", 0.9), ("6", "section", None, "6", "parsed", 0.9)]),
    "headings part clauses of one section": (
        Rules(),
        [(H, "Schedule B Uses"), (H, "8 Permitted uses"), (H, "HOMES"), (L, "(a) one unit"), (H, "SHOPS"), (L, "(a) one shop"), (L, "(b) two shops")],
        [
            ("Schedule B", "schedule", None, "Schedule B", "parsed", 0.95),
            ("8", "section", 0, "Schedule B > 8", "parsed", 0.9),
            (None, "heading", 0, None, "uncertain", 0.55),
            ("(a)", "clause", 2, "Schedule B > 8 > [HOMES] > (a)", "parsed", 0.85),
            (None, "heading", 0, None, "uncertain", 0.55),
            ("(a)", "clause", 4, "Schedule B > 8 > [SHOPS] > (a)", "parsed", 0.85),
            ("(b)", "clause", 4, "Schedule B > 8 > [SHOPS] > (b)", "parsed", 0.85),
        ],
    ),
    "values": (
        Rules(),
        [(H, "4 Heights"), (P, "The height of a wall is"), (P, "12 m"), (H, "4.1 Angles"), (P, "45 ft, except on corner lots"), (H, "45 Angle")],
        [("4", "section", None, "4", "parsed", 0.9), (None, "prose", 0, None, "parsed", 0.8), (None, "prose", 1, None, "parsed", 0.8), ("4.1", "subsection", 0, "4 > 4.1", "parsed", 0.9), (None, "prose", 3, None, "parsed", 0.8), (None, "heading", None, None, "uncertain", 0.55)],
    ),
    "a number before running text": (Rules(), [(P, "12 of the houses near the old harbour were built of wood"), (P, "14 minimum yard of any kind"), (P, "15 Front Yards")], [(None, "prose", None, None, "uncertain", 0.5), ("14", "section", None, "14", "parsed", 0.9), ("15", "section", None, "15", "parsed", 0.9)]),
    "split definitions": (Rules(), [(P, 'Terms\n"Wall" means a wall.\n\n"Wall Line" means a line.')], [(None, "prose", None, None, "uncertain", 0.5), (None, "prose", None, None, "uncertain", 0.5)]),
    "split schedules": (Rules(), [(H, "Schedule B\nHomes.\nSchedule C\nShops.")], [("Schedule B", "schedule", None, "Schedule B", "parsed", 0.95), ("Schedule C", "schedule", None, "Schedule C", "parsed", 0.95)]),
    "split compound labels": (REGIONAL, [(H, "48DB(1)\nShops.\n48DB(2)\nHomes above them.")], [("48DB(1)", "subsection", None, "48DB(1)", "parsed", 0.9), ("48DB(2)", "subsection", None, "48DB(2)", "parsed", 0.9)]),
    "wrapped line": (Rules(), [(L, "(a)\nas set out in Policies\n1.7 and 2.5")], [("(a)", "clause", None, None, "uncertain", 0.6)]),
    "table of contents": (Rules(), [(P, "ZM-21\nAccess to water ....... 143\nZM-22\nFront yards ..... 144\nAMENDMENTS ..... 146")], [(None, "heading", None, None, "uncertain", 0.55)] * 3),
}


@pytest.fixture(scope="module")
def trees(spark):
    """All documents of a set of rules in one run."""
    found = {}
    for rules in (Rules(), REGIONAL):
        names = [n for n, t in TREES.items() if t[0] == rules]
        rows = [(i, 1, k, text, kind, False) for i, n in enumerate(names) for k, (kind, text) in enumerate(TREES[n][1])]
        rows += [(i, 1, 99, "running head", P, True) for i in range(len(names))]
        for r in hierarchy_full(spark.createDataFrame(rows, SCHEMA), rules).orderBy("document_id", "fragment_index").collect():
            found.setdefault(names[r["document_id"]], []).append((r["citation_label"], r["fragment_type"], r["parent_index"], r["citation_path"], r["parse_status"], r["confidence"]))
    return found


@pytest.mark.parametrize("name", TREES)
def test_tree(trees, name):
    assert trees[name] == TREES[name][2]


def test_long_document_nulls_and_empty(spark):
    n = 100_000
    blocks = spark.range(n).select(
        F.lit(1).cast("long").alias("document_id"), (F.col("id") / 50).cast("long").alias("page_number"), F.col("id").alias("reading_order"),
        F.when(F.col("id") % 1000 == 0, F.concat(((F.col("id") / 1000).cast("int") + 1).cast("string"), F.lit(" Section"))).otherwise(F.concat(F.lit("("), F.substring(F.lit("abcdefgh"), (F.col("id") % 8 + 1).cast("int"), F.lit(1)), F.lit(") item "), F.col("id").cast("string"))).alias("raw_text"),
        F.when(F.col("id") % 1000 == 0, "heading").otherwise("list_item").alias("block_type"), F.lit(False).alias("is_boilerplate"),
    )
    odd = spark.createDataFrame([(None, 1, 1, "x", P, False), (2, None, None, None, None, None), (2, 1, 5, "a b c is.", None, None), (2, 1, 5, "a b c is.", None, None)], SCHEMA)
    got = hierarchy_full(blocks.unionByName(odd))
    by = {r[0]: (r[1], r[2]) for r in got.groupBy("document_id").agg(F.count(F.lit(1)), F.max("fragment_index")).collect()}
    assert by == {1: (n, n - 1), 2: (2, 1)}
    assert got.where("document_id = 1 and parent_index is null").count() == n // 1000
    assert hierarchy_full(odd.limit(0)).count() == 0


def test_compound_labels(spark):
    cases = {
        "48DB(1) Shops": ("subsection", "48DB(1)", 3, "Shops"), "10(3)(a) Walls": ("clause", "10(3)(a)", 4, "Walls"), "10(3)(iv)": ("subclause", "10(3)(iv)", 4, ""), "43 I Notwithstanding": ("section", "43I", 2, "Notwithstanding"),
        "43 AB of it": ("section", "43AB", 2, "of it"), "34R Where": ("section", "34R", 2, "Where"), "10(3)A Rear": ("subsection", "10(3)A", 4, "Rear"), "7 A building": ("section", "7", 2, "A building"), "12 Rules": ("section", "12", 2, "Rules"), "3.2(1) Yards": ("section", "3.2(1)", 2, "Yards"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", B.citation(F.col("t"), compound=True).alias("c"), B.has_citation(F.col("t"), compound=True).alias("has"))
    for r in df.collect():
        assert (r["c"]["type"], r["c"]["label"], r["c"]["level"], r["c"]["title"]) == cases[r["t"]] and r["has"], r["t"]


def test_entries_of_contents(spark):
    cases = {"A ... 1\nB ... 2": ["A ... 1", "B ... 2"], "ZM-1\nA ... 1\nB ... 2": ["ZM-1\nA ... 1", "B ... 2"], "ZM-1\nA ... 1": [], "A ... 1\nZM-1": [], "A ... 1\nplain\nB ... 2": [], "A ... 1": []}
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", B.toc_segments(F.col("t")).alias("s")).collect()}
    assert got == cases
