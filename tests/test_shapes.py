"""Polygons and lines against an integration by slabs, and frontage along curves against dense sampling."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cadastra.operators.shapes import frontage_pieces, lot_frontage, overlay, shape_match


def crossings(rings, y):
    xs = []
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, np.roll(r, -1, axis=0), strict=True):
            if (y1 > y) != (y2 > y):
                xs.append((x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return sorted(xs)


def common(a, b):
    """Area in both: between the heights of all corners and crossings widths are linear, so the middle one is exact."""
    segments = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in (*a, *b)]
    s = np.vstack(segments)
    ys = set(s[:, 1])
    for i in range(len(s)):
        for j in range(i):
            d, e = s[i, 2:] - s[i, :2], s[j, 2:] - s[j, :2]
            cross = d[0] * e[1] - d[1] * e[0]
            if cross:
                w = s[j, :2] - s[i, :2]
                t = (w[0] * e[1] - w[1] * e[0]) / cross
                if 0 <= t <= 1:
                    ys.add(s[i, 1] + t * d[1])
    ys, total = sorted(ys), 0.0
    for low, high in zip(ys, ys[1:]):
        p, q = crossings(a, (low + high) / 2), crossings(b, (low + high) / 2)
        total += (high - low) * sum(max(0, min(p[i + 1], q[j + 1]) - max(p[i], q[j])) for i in range(0, len(p), 2) for j in range(0, len(q), 2))
    return total


SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
HOLE = np.array([(1, 1), (3, 1), (3, 3), (1, 3)], float)
ISLAND = np.array([(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5)], float)
ELL = np.array([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)], float)


@pytest.mark.parametrize(
    ("a", "b", "area", "inside"),
    [
        ([SQUARE], [SQUARE], 16, True), ([SQUARE], [SQUARE[::-1]], 16, True), ([HOLE], [SQUARE], 4, True), ([SQUARE], [HOLE], 4, False), ([HOLE], [SQUARE, HOLE], 0, False), ([SQUARE, HOLE], [SQUARE], 12, True),
        ([ISLAND], [SQUARE, HOLE, ISLAND], 1, True), ([SQUARE], [SQUARE, HOLE[::-1], ISLAND], 13, False), ([SQUARE + (4, 0)], [SQUARE], 0, False), ([SQUARE + (4, 4)], [SQUARE], 0, False), ([SQUARE + (2, 0)], [SQUARE], 8, False),
        ([ELL], [SQUARE + (0.5, 0.5)], 2.5 * 0.5 + 0.5 * 2, False), ([ELL + (0.5, 0.5)], [ELL], common([ELL + (0.5, 0.5)], [ELL]), False), ([np.array([(0, 0), (2, 0), (1, 2)], float), np.array([(3, 0), (4, 0), (4, 1)], float)], [SQUARE], 2.5, True),
    ],
)
def test_areas(a, b, area, inside):
    got = overlay("polygon", a, b)
    assert got[0] == pytest.approx(area, abs=1e-9) and got[1] == inside
    assert overlay("polygon", [r * 1e-4 + (-63.6, 44.6) for r in a], [r * 1e-4 + (-63.6, 44.6) for r in b])[0] == pytest.approx(area * 1e-8, abs=1e-15)


@pytest.mark.parametrize("seed", range(30))
def test_random_polygons(seed):
    rng = np.random.default_rng(seed)

    def star(n, x, y):
        angle = (np.arange(n) + rng.uniform(0, 0.8, n)) * 2 * math.pi / n
        size = rng.uniform(0.3, 2, n)
        return np.c_[x + np.cos(angle) * size, y + np.sin(angle) * size]

    a, b = [star(9, 0, 0)], [star(12, *rng.uniform(-1, 1, 2))]
    if seed % 3 == 0:
        b = [star(12, 0, 0) * 3, np.array([(0.02, 0.02), (0.1, 0.03), (0.05, 0.12)])]
    got, want = overlay("polygon", a, b), common(a, b)
    assert (got[0] if got else 0.0) == pytest.approx(want, abs=1e-9)
    assert (overlay("polygon", b, a) or (0.0,))[0] == pytest.approx(want, abs=1e-9)


def test_lines_and_points():
    line = [np.array([(-1, 2), (5, 2)], float)]
    assert overlay("line", line, [SQUARE]) == (4.0, False) and overlay("line", line, [SQUARE, HOLE])[0] == pytest.approx(2.0) and overlay("line", line, [SQUARE, HOLE, ISLAND])[0] == pytest.approx(3.0)
    assert overlay("line", [np.array([(1, 2), (3, 2)], float)], [SQUARE]) == (2.0, True)
    assert overlay("line", [np.array([(0, 0), (4, 0)], float)], [SQUARE]) == (4.0, False)  # on the border
    assert overlay("line", [np.array([(4, 4), (5, 5)], float)], [SQUARE]) == (0.0, False) and overlay("line", [np.array([(5, 5), (6, 5)], float)], [SQUARE]) is None
    assert overlay("point", [np.array([(2.0, 2.0)])], [SQUARE]) == (1.0, True) and overlay("point", [np.array([(4.0, 2.0)])], [SQUARE]) == (1.0, False)
    assert overlay("point", [np.array([(2.0, 2.0)])], [SQUARE, HOLE]) is None and overlay("polygon", [SQUARE + (9, 9)], [SQUARE]) is None


def test_match_over_cells_and_odd_rows(spark):
    pts = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    shape = "kind string, parts array<array<struct<x:double,y:double>>>"
    wide = SQUARE * 0.01
    locations = [(1, "polygon", [pts(wide)]), (2, "point", [pts([(0.02, 0.02)])]), (3, "line", [pts([(-1, 0.02), (1, 0.02)])]), (4, "polygon", None), (5, "polygon", []), (6, "polygon", [pts(wide[:2])]), (7, "point", [pts([(float("nan"), 1)])])]
    features = [(1, "polygon", [pts(wide), pts(HOLE * 0.01)]), (2, "polygon", [pts(wide + (0.02, 0))]), (3, "polygon", None)]
    a, b = spark.createDataFrame(locations, f"location_id long, {shape}"), spark.createDataFrame(features, f"feature_id long, {shape}")
    got = {(r["location_id"], r["feature_id"]): (round(r["overlap"], 12), r["contains_input"]) for r in shape_match(a, b).collect()}
    assert got == {(1, 1): (0.0012, False), (1, 2): (0.0008, False), (2, 2): (1.0, False), (3, 1): (0.02, False), (3, 2): (0.04, False)}
    assert shape_match(a.limit(0), b).count() == 0


def test_frontage_along_a_curve(spark):
    """A street that bends around a lot: frontage by a walk along the ring in steps of a millimetre or so."""
    scale = 111_320.0
    to_deg = lambda p: {"x": p[0] / (scale * math.cos(math.radians(45.0))), "y": 45.0 + p[1] / scale}
    ring = [(-20.0, -15.0), (20.0, -15.0), (24.0, 15.0), (-16.0, 15.0)]
    arc = [(30 * math.cos(a), 30 * math.sin(a)) for a in np.linspace(-2.4, 0.3, 40)]
    lots = spark.createDataFrame([(1, [to_deg(p) for p in ring]), (2, None), (3, [to_deg((x + 900, y)) for x, y in ring])], "feature_id long, ring array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([(1, [to_deg(p) for p in arc]), (2, [to_deg(arc[3]), to_deg(arc[9])]), (3, None)], "line_id long, points array<struct<x:double,y:double>>")
    mid = (max(x for x, _ in ring) + min(x for x, _ in ring)) / 2
    near, pieces = 0.0, {}
    seg = np.array([(*p, *q) for p, q in zip(arc, arc[1:])] + [(*arc[3], *arc[9])])
    for e, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1])):
        t = (np.arange(40_000) + 0.5) / 40_000
        x = np.array(p) + t[:, None] * (np.array(q) - np.array(p))
        d = seg[:, 2:] - seg[:, :2]
        w = x[:, None] - seg[None, :, :2]
        s = np.clip((w * d).sum(2) / (d * d).sum(1), 0, 1)
        share = (np.hypot(*np.moveaxis(w - s[..., None] * d, 2, 0)).min(1) <= 8.0).mean() * math.dist(p, q)
        near, pieces[e] = near + share, share
    rows = {r["feature_id"]: r for r in lot_frontage(lots, lines, buffer_m=8.0).collect()}
    assert mid == 2.0 and rows[1]["frontage_m"] == pytest.approx(near, abs=0.02) and rows[1]["area_m2"] == pytest.approx(1200, rel=1e-4) and rows[1]["depth_m"] == pytest.approx(rows[1]["area_m2"] / rows[1]["frontage_m"])
    assert rows[2]["frontage_m"] is None and rows[3]["frontage_m"] == 0.0 and rows[3]["depth_m"] is None and rows[3]["corner"] is False
    by_edge = {}
    for r in frontage_pieces(lots, lines, buffer_m=8.0).where("feature_id = 1").collect():
        by_edge[r["edge"]] = by_edge.get(r["edge"], 0.0) + r["length_m"]
    assert {e: round(v, 1) for e, v in by_edge.items()} == {e: round(v, 1) for e, v in pieces.items() if v}


def test_small_tables_are_cut_in_many_tasks(spark):
    """A handful of shapes meets in one task; the cutting of its pairs must not stay there."""
    ring = "array(array(struct(0.0D + id % 8 AS x, 0.0D AS y), struct(1.5D + id % 8 AS x, 0.0D AS y), struct(1.5D + id % 8 AS x, 1.0D AS y)))"
    rows = spark.range(0, 64, 1, 1).selectExpr("id", "'polygon' AS kind", f"{ring} AS parts")
    out = shape_match(rows.withColumnRenamed("id", "location_id"), rows.selectExpr("id AS feature_id", "parts"), cell=1.0)
    tasks = out.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < sum(t["count"] for t in tasks) / 2


def test_pairs_cut_together_are_as_alone():
    from cadastra.operators.shapes import _polygon_overlays

    rng = np.random.default_rng(5)
    star = lambda n: [np.c_[np.cos(a), np.sin(a)] * rng.uniform(0.3, 1, (n, 1)) + rng.uniform(-0.5, 0.5, 2) for a in [np.sort(rng.uniform(0, 2 * np.pi, n))]]
    pairs = [(star(3 + k % 11), [*star(4 + k % 7), SQUARE / 8]) for k in range(200)] + [([], [SQUARE]), ([SQUARE], [SQUARE[:2]]), ([SQUARE[:2]], [SQUARE]), ([SQUARE + (9, 9)], [SQUARE])]
    for got, (a, b) in zip(_polygon_overlays(pairs), pairs, strict=True):
        alone = overlay("polygon", a, b)
        assert (got is None) == (alone is None) and (got is None or (got[0] == pytest.approx(alone[0], abs=1e-12) and got[1] == alone[1]))
