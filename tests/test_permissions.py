"""Rows of tables of permitted uses, on golden rows."""

from __future__ import annotations

from cadastra.operators import evidence as E

_CELLS = [
    (1, 0, 0, "Use"), (1, 0, 1, "DD"), (1, 0, 2, "CEN-2 ZONE"), (1, 0, 3, "HR1"), (1, 1, 0, "Red  Shop use"), (1, 1, 1, " ② "), (1, 1, 2, ""), (1, 1, 3, "①③"), (1, 1, 4, "●"), (1, 2, 0, "Red shop"),
    (2, 0, 0, "Use"), (2, 0, 1, "DD"), (2, 1, 0, "Red shop"), (2, 1, 1, "①"),
    (3, 0, 0, "Use"), (3, 0, 1, "DD"), (3, 1, 0, "Red shop"), (3, 1, 1, "P"),
]
_NOTES = [(7, 9, 50, "② use is permitted on corners."), (7, 8, 50, "② Use is permitted above."), (7, 1, 44, "② Use is permitted too early."), (7, 5, 45, "See ③ Use is permitted below."), (8, 2, 46, "① Use is permitted elsewhere."), (7, 3, 56, "① applies")]


def test_rows_have_caption_legend_and_the_notes_to_their_markers(spark):
    cells = spark.createDataFrame(_CELLS, "table_id long, row_index long, col_index int, text string")
    tables = spark.createDataFrame([(1, 7, "Table 1A: permitted uses by Zone"), (2, 8, "TABLE 1B Permitted uses by zone"), (3, 7, "Table 4: Permitted uses by zone")], "table_id long, document_id long, caption string")
    notes = spark.createDataFrame(_NOTES, "document_id long, fragment_id long, page_start int, text string")
    calls = spark.createDataFrame([(1, "red   SHOP", None), (2, "Red shop", "cen2"), (3, "red shop", "HR-1"), (4, "", None), (5, "red shop", "ER-3")], "question_id long, use string, zone string")
    a, b = "Table 1A: permitted uses by Zone. ", "TABLE 1B Permitted uses by zone. "
    found = {(r["question_id"], r["table_id"], r["row_index"]): r["text"] for r in E.permission_rows(calls, cells, tables, notes).collect()}
    assert found == {
        (1, 1, 1): f"{a}Red  Shop use: DD=②; HR1=①③; column 4=●. {E.LEGEND} Applicable footnotes: ② Use is permitted above. See ③ Use is permitted below.",
        (1, 1, 2): f"{a}Red shop: . {E.LEGEND}",
        (1, 2, 1): f"{b}Red shop: DD=①. {E.LEGEND} Applicable footnotes: ① Use is permitted elsewhere.",
        (2, 1, 1): f"{a}Red  Shop use: . {E.LEGEND}",
        (3, 1, 1): f"{a}Red  Shop use: HR1=①③. {E.LEGEND} Applicable footnotes: See ③ Use is permitted below.",
    }
