"""The dictionary of operator 4 counts all documents."""

from __future__ import annotations

from cadastra.llm import secrets


def test_all_texts_count_once(spark):
    rows = [(f"common filler{i}",) for i in range(5000)] + [(f"rareword text {i}",) for i in range(10)] + [("copied only",)] * 3000 + [(None,), ("",)]
    got = secrets.common_words(spark.createDataFrame(rows, "text string"))
    assert {"common", "filler", "rareword", "text"} <= got  # a sample of 2,000 holds rareword by luck only
    assert "copied" not in got  # one text, however many copies
