"""The coarse index: recall against the exact search, odd rows, full lists."""

from __future__ import annotations

import numpy as np

from cadastra.operators import vectorindex as V
from cadastra.registry import QUERIES

SF = "/root/testdata/sf0.01"


def _exact(ids, x, asked, k=8):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit[asked] @ unit.T, 9)
    return {ids[a]: set(ids[np.lexsort((ids, -row))[:k]]) for a, row in zip(np.nonzero(asked)[0], score, strict=True)}


def _recall(want, rows):
    found = {}
    for r in rows:
        found.setdefault(r["question_id"], set()).add(r["source_fragment_id"])
    return sum(len(want[q] & found.get(q, set())) for q in want) / sum(map(len, want.values()))


def test_recall_of_the_query(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids = e["vec_id"].to_numpy()
    want = _exact(ids, np.stack(e["embedding"].to_numpy()).astype(float), ids % 20 == 0)
    assert _recall(want, QUERIES["vector_index"](spark, SF).collect()) >= 0.9


def test_clusters_take_few_probes_and_full_lists_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(V, "PART", 64)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 16))
    # A third of all rows around one centre.
    which = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 20, 3000))
    x = centre[which] + 0.05 * rng.normal(size=(3000, 16))
    ids = np.arange(3000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, 2.0]), (3004, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<double>")
    coarse = V.fit(df, "vec_id", "e", 20, sample=1000)
    assert coarse.probes <= 6
    index = V.assign_lists(df, "vec_id", "e", coarse.centres)
    assert index.count() == 3002
    got = V.index_candidates(V.assign_lists(df.where("vec_id % 20 = 0 or vec_id = 3003"), "vec_id", "e", coarse.centres, coarse.probes, "question_id"), index).collect()
    assert _recall(_exact(ids, x, ids % 20 == 0), got) >= 0.9
    # Another dimension meets its like.
    assert [r["source_fragment_id"] for r in got if r["question_id"] == 3003] == [3003, 3004]
    assert {r["question_id"] for r in got} == set(range(0, 3000, 20)) | {3003}


def test_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id bigint, e array<double>")
    coarse = V.fit(df, "vec_id", "e", 20)
    index = V.assign_lists(df, "vec_id", "e", coarse.centres)
    assert V.index_candidates(V.assign_lists(df, "vec_id", "e", coarse.centres, 3, "question_id"), index).count() == 0
