"""What operator 8 catches of all labelled rows, whatever their text looks like."""

from __future__ import annotations

from cadastra.llm import queries

SF = "/root/testdata/sf0.01"


def test_all_labelled_rows(spark):
    out = queries.op8_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").toPandas()
    clean = out[(out.quality == 1) & (out.toxic == 0)]
    caught = {q: 1 - out[w].kept.mean() for q, w in (("junk", out.quality == 0), ("toxic", out.toxic == 1))}
    print("rejected:", caught, "clean", 1 - clean.kept.mean())
    # Toxic words of a language show once five labelled texts hold them: here those of English only.
    assert caught["junk"] > 0.95 and caught["toxic"] > 0.7 and clean.kept.mean() > 0.97
