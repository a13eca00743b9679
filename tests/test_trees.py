"""Trees that are deep, broken or circular."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import structure as T


def test_deep_broken_and_circular(spark):
    chain = [(i, i - 1 if i else None) for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 33) for i in range(33)] + [(200, 100), (201, 200)]
    lost = [(300, 999), (301, 300)]
    rows = [(1, i, p, f"L{i}" if i != 5 else None) for i, p in chain + ring + lost]
    f = spark.createDataFrame(rows, "document_id long, fragment_id long, parent_fragment_id long, citation_label string")
    paths = {r["fragment_id"]: r["citation_path"] for r in T.citation_paths(f).collect()}
    assert paths[39] == " > ".join(f"L{i}" for i in range(40) if i != 5) and paths[0] == "L0"
    assert all(paths[i] is None for i in (100, 132, 200, 201, 300, 301)) and len(paths) == len(rows)
    up = {r["fragment_id"]: r["ancestors"] for r in T.ancestor_chain(f).collect()}
    assert up == {i: list(range(i)) for i in range(1, 40)}
    assert {r[0] for r in T.cycles(f).collect()} == {100 + i for i in range(33)}
    assert T.citation_paths(f.limit(0)).count() == 0 and T.cycles(f.limit(0)).count() == 0


def test_outline_of_many_levels(spark):
    levels = [1, 3, 9, 12, 9, 2, 15, 1, 4]
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "document_id long, idx long, level int")
    got = {r["idx"]: r["parent_idx"] for r in T.hierarchy_parent(f).collect()}
    want = {i: max((j for j in range(i) if levels[j] < v), default=None) for i, v in enumerate(levels)}
    assert got == want


def test_rows_under_one_parent_stay_spread(spark):
    """No task gets all that hangs on one fragment, whether it is a root or further down."""
    rows = [(0, None), (1, 0)] + [(i, i % 2) for i in range(2, 4002)]
    f = spark.createDataFrame(rows, "fragment_id long, parent_fragment_id long")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        climbed = T._climb(f, F.array("fragment_id"))
        spread = [r["n"] for r in climbed.where("fragment_id > 1").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        held = {r["fragment_id"]: list(r["held"]) for r in climbed.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert held == {0: [0], 1: [0, 1], **{i: [0, 1, i] if i % 2 else [0, i] for i in range(2, 4002)}}
    assert sum(spread) == 4000 and max(spread) < 1500


def test_paths_meet_their_parent_once_and_duplicates_are_moved_once(spark, monkeypatch):
    rows = [(0, None, "R"), (1, 0, None), (2, 0, "A"), (3, None, None)] + [(i, i % 4, f"L{i % 600}") for i in range(10, 1410)] + [(5000 + i, 4999, "X") for i in range(40)]
    f = spark.createDataFrame([(7, *r, "parsed", 0.9) for r in rows], "document_id long, fragment_id long, parent_fragment_id long, citation_label string, parse_status string, confidence double")
    above = {0: ["R"], 1: ["R"], 2: ["R", "A"], 3: []}
    want = {i: " > ".join([*above[p], *([label] if label else [])]) or None if p in above else None for i, p, label in rows[4:]} | {0: "R", 1: "R", 2: "R > A", 3: None}
    many = {p for p in want.values() if p and list(want.values()).count(p) > 1}
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for up, seen in ((20_000, 50), (3, 2)):  # frequent parents and paths, and none
            monkeypatch.setattr(T, "FREQUENT_UP", up)
            monkeypatch.setattr(T, "SEEN", seen)
            monkeypatch.setattr(T, "SAMPLED", 2)
            paths = T.citation_paths(f)
            assert {r["fragment_id"]: r["citation_path"] for r in paths.collect()} == want
            down = T.downgrade_duplicate_paths(paths)
            assert down._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1  # they were moved to be counted, and again
            got = {r["fragment_id"]: (r["citation_path"], r["duplicate_citation_path"], r["parse_status"], r["confidence"]) for r in down.collect()}
            assert got == {i: (None, p, "uncertain", 0.6) if p in many else (p, None, "parsed", 0.9) for i, p in want.items()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_parents_walk_in_search_of_cycles(spark, monkeypatch):
    sizes, put = [], T.written
    monkeypatch.setattr(T, "written", lambda df: (sizes.append((made := put(df)).count()), made)[1])
    rows = [(i, (i + 1) % 5) for i in range(5)] + [(100 + i, i % 5) for i in range(400)]
    f = spark.createDataFrame(rows, "fragment_id long, parent_fragment_id long")
    assert {r[0] for r in T.cycles(f).collect()} == set(range(5))
    assert sizes and max(sizes) == 5  # all 405 walked


def test_open_references_count_like_those_of_each_fragment(spark, monkeypatch):
    texts = ["Subject to section 1.1 and section 9.9", "See section 8 and Schedule B", "none", None]
    rows = [(d, 100 * d + i, f"{i}.1", i, 1 + i % 3, 1 + i % 3 + i % 2, texts[i % 4]) for d in (1, 2) for i in range(60)]
    f = spark.createDataFrame(rows, "document_id long, fragment_id long, citation_label string, reading_order long, page_start long, page_end long, text string")
    read, detect = [], T.detect_references
    refs = T.resolve_references(detect(f), f)
    monkeypatch.setattr(T, "detect_references", lambda df: (read.append(df.count()), detect(df))[1])
    opened = T.open_references(f, f)
    fragments = f.selectExpr("*", "cast(null as long) as parent_fragment_id", "'prose' as fragment_type", "'parsed' as parse_status", "false as duplicate")
    blocks = spark.createDataFrame([], "document_id long, page long, block_type string, is_boilerplate boolean, accounted boolean, fallback boolean")
    tables = spark.createDataFrame([], "document_id long, page long")
    rows = [sorted(map(str, T.page_risk(fragments, r, blocks, tables).collect())) for r in (refs, opened)]
    assert rows[0] == rows[1] and any("unresolved" in r for r in rows[0]) and read == [8]  # all 120 were resolved
