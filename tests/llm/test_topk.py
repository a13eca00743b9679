"""Top-k products against all products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra.llm.topk import _search, top_k_products


def brute(rows, asks, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * float(x)) for x in v]
            if sum(x * x for x in w) < 2**62:
                good[i] = min((len(w), sum(x * x for x in w), np.array(w, "<i4").tobytes(), w), good.get(i, (10**9,)))
    out = []
    for i in sorted(good):
        if asks(i):
            q = good[i][3]
            found = sorted((-sum(a * b for a, b in zip(q, v[3], strict=True)), j) for j, v in good.items() if j != i and len(v[3]) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return out


def vectors():
    rng = np.random.default_rng(3)
    lengths = rng.choice([0.01, 1, 3, 50], 500)
    spread = np.geomspace(1, 0.01, 12)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=12) * spread * lengths[i])]) for i in range(500)]
    same = rows[40][1]
    rows += [(1000 + i, same) for i in range(60)]  # ties
    rows += [(2000 + i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(40)]
    rows += [(3000, [1.0, 2.0]), (3020, [2.0, 1.0]), (3040, [7.0]), (20, same), (20, same), (None, same), (4000, None), (4020, []), (4040, [None] * 12), (4060, [float("nan")] * 12), (4080, [float("inf")] * 12), (4100, [1e30] * 12), (4120, [0.0] * 12)]
    return rows


@pytest.mark.parametrize(("k", "block_numbers"), [(10, 600), (3, 1 << 18)])
def test_top_k(spark, k, block_numbers):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", None) for r in rows], "vec_id long, embedding array<float>, rank string, score string")
    got = [tuple(r) for r in top_k_products(df, F.col("vec_id") % 20 == 0, k=k, block_numbers=block_numbers).orderBy("query_id", "rank").collect()]
    assert got == brute(rows, lambda i: i % 20 == 0, k)
    if k == 3:
        assert top_k_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
        assert top_k_products(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_search_prunes_nothing_that_counts(seed):
    """The bounds against all products, with and without a rotation and first scores, vectors of very unlike lengths and large numbers."""
    rng = np.random.default_rng(seed)
    top = [5, 1000, 2**30][seed % 3]
    x = rng.integers(-top, top, (3000, 8)) // rng.choice([1, 1, 50], (3000, 1))
    x = x[np.argsort(-(x.astype(object) ** 2).sum(1), kind="stable")]
    q, ids, q_ids = x[::40][:50].copy(), np.arange(len(x)), np.arange(0, 2000, 40)
    _, energy, rows = np.linalg.svd(x.T.astype(float) @ x)
    best = _search(q, q_ids, np.full(len(q), np.iinfo(np.int64).min), x, ids, 7, (rows.T, 3, 6) if seed < 4 else None)
    scores = q @ x.T
    for n, own in enumerate(q_ids):
        want = sorted((-s, i) for i, s in enumerate(scores[n].tolist()) if i != own)[:7]
        mine = best.query == n
        assert sorted(zip((-best.score[mine]).tolist(), best.ids[mine].tolist(), strict=True)) == want
