"""The lookup of standards moves the lines that can count, and gives what it gave when it moved all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadastra.operators import standards as S
from cadastra.plans.base import Tables

SECTION = "document_id long, zone string"
BLOCK = "document_id long, page_number long, reading_order long, fragment_id long, parent_fragment_id long, text string"


def as_fragments(blocks):
    return blocks.select("document_id", "fragment_id", "parent_fragment_id", F.col("page_number").alias("page_start"), "reading_order", "text")


def test_only_lines_with_a_heading_meet_the_zones(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(S, "written", lambda df: kept.append(df.count()) or df.localCheckpoint())
    plain = [(d, p, 100 * p, 1000 * d + p, None, "The front yard in HB-7 is 3 metres") for d in (1, 2, 3) for p in range(1, 40)]
    heads = [(1, 3, 300, 1503, None, "r-1  ZO-NE"), (1, 9, 900, 1509, None, "C-2 Zone"), (2, 5, 500, 2505, None, "Built form and\nsiting requirements within the R-1 area"), (3, 7, 700, 3507, None, "see r1"), (3, 8, 800, 3508, None, "and R-1 again"), (3, 2, 200, 3502, None, None)]
    blocks = spark.createDataFrame(plain + heads, BLOCK)
    zones = spark.createDataFrame([(d, z) for d in (1, 2, 3) for z in ("R-1", "HB-7", "X-9")], SECTION)
    found = {(r["document_id"], r["zone"]): tuple(r)[2:] for r in S.zone_sections(zones, blocks, as_fragments(blocks)).collect()}
    assert found[1, "R-1"] == (1, [3], 3, 8) and found[2, "R-1"] == (2, [5], 5, 20) and found[3, "R-1"] == (4, [7, 8], 7, 22)
    assert found[1, "HB-7"] == (4, [1, 2, 3], 1, 8) and len(found) == 6
    assert kept == [3]


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_rules_children_and_the_blocks_near_them(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "BROADCAST_ASKERS", broadcast)
    lines = [(1, 1, 5, 50, None, "R-1 ZONE"), (1, 1, 7, 51, None, "Front-yard rules of R1"), (1, 1, 15, 52, 51, "a depth of 3 metres"), (1, 1, 16, 53, 51, "nothing"), (1, 1, 40, 54, None, "An office use needs one parking space"), (2, 1, 40, 55, None, "An office use needs one parking space")]
    blocks = spark.createDataFrame(lines, BLOCK)
    tables = spark.createDataFrame([(1, 9, 1, "Front yard | 4"), (1, 9, 1, "Front yard | 5"), (2, 8, 1, "Side yard")], "document_id long, table_id long, page_start long, text string")
    calls = spark.createDataFrame([(1, 1, "R-1", "front_yard", None, None), (2, 1, None, "parking", "Office use", None), (3, 1, None, None, None, None)], "question_id long, document_id long, zone string, standard_type string, use_type string, area_context string")
    got = [tuple(r[c] for c in ("question_id", "rank", "stage", "source_table_id", "source_fragment_id", "base_score", "text")) for r in S.get_standard(calls, blocks, tables, as_fragments(blocks)).orderBy("question_id", "rank").collect()]
    assert got == [
        (1, 1, "table", 9, None, 7.0, "R-1 ZONE R-1 ZONE Front-yard rules of R1 Front yard | 5"),
        (1, 2, "near", None, 51, 4.22, "Front-yard rules of R1 a depth of 3 metres"),
        (1, 3, "rule", None, 51, 3.5, "Front-yard rules of R1"),
        (1, 4, "child", None, 52, 3.45, "a depth of 3 metres"),
        (2, 1, "parking", None, 40, 7.0, "An office use needs one parking space"),
    ]


def test_tables_of_lines_that_are_there_derive_no_lines(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    lines = t.d_zoning.where("document_id < 0").localCheckpoint()
    assert t.derived("d_zoning_tables", d_zoning=lines).inputFiles() == [] and t.d_zoning_tables.inputFiles()
