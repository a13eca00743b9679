"""Benchmark decontamination: test sets in turn, short and repeated items, passes, long texts."""

from __future__ import annotations

from cadastra.llm.decontaminate import contamination

ONE = "the quick brown fox jumps over the lazy dog near the old river bank"
TWO = "a completely different sentence about trains and their long winding tracks"


def found(docs, bench, **options):
    return {r["doc_id"]: list(r["item_ids"]) for r in contamination(docs, bench, **options).collect()}


def test_test_sets_in_turn(spark):
    docs = spark.createDataFrame([(1, f"x {ONE} y"), (2, f"z {TWO}")], "doc_id long, text string").coalesce(1)
    first = spark.createDataFrame([(7, ONE)], "item_id long, text string")
    second = spark.createDataFrame([(7, TWO)], "item_id long, text string")
    for _ in range(8):
        assert found(docs, first) == {1: [7], 2: []}
        assert found(docs, second) == {1: [], 2: [7]}


def test_short_items_are_exact_phrases(spark):
    docs = spark.createDataFrame([(1, "say Open, sesame! now"), (2, "open the sesame"), (3, "sesame"), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "open sesame"), (2, "sesame"), (3, "..."), (4, None)], "item_id long, text string")
    assert found(docs, bench) == {1: [1, 2], 2: [2], 3: [2], 4: [], 5: []}


def test_passes_and_repeated_items(spark):
    items = [(i, f"{ONE} {i}") for i in range(6)] + [(9, TWO), (9, TWO), (10, TWO)]
    docs = spark.createDataFrame([(1, ONE), (2, TWO), (2, TWO), (3, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted((r["doc_id"], sorted(zip(r["item_ids"], r["item_distances"]))) for r in contamination(docs, bench).collect())
    many = sorted((r["doc_id"], sorted(zip(r["item_ids"], r["item_distances"]))) for r in contamination(docs, bench, pass_words=30).collect())
    assert once == many
    assert [d for d, _ in once] == [1, 2, 2, 3]
    assert [i for i, _ in once[1][1]] == [9, 9, 10]


def test_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(150_000)) + f" {ONE} end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = contamination(docs, spark.createDataFrame([(3, ONE)], "item_id long, text string")).first()
    assert (list(got["item_ids"]), list(got["item_distances"]), list(got["item_ends"])) == ([3], [0], [150_014])
