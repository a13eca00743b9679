"""General geometry: points, lines and polygons against polygons, and what of a lot's boundary fronts a street.

A shape is (kind, parts): ``point``, ``line`` or ``polygon``, and an array of arrays of struct(x, y). The
parts of a polygon are its rings, outer ones, holes and islands alike: what lies in an odd number of them
is inside. Pairs meet on grid cells by their boxes and are made once; then shapes are cut exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.blocks import with_value
from cadastra.operators.geo import CELL, EARTH_M, _cells

#: Two points this near, as a share of the shapes' extent, are one.
TOLERANCE = 1e-11
#: Metres around a street's centre line within which a boundary fronts it.
BUFFER_M = 8.0
#: Pairs of edges that are compared at once.
AT_ONCE = 1 << 18


def shape_box(parts: Column) -> Column:
    """struct(x0, y0, x1, y1) of a shape's points."""
    points = F.flatten(parts)
    return F.struct(F.array_min(points["x"]).alias("x0"), F.array_min(points["y"]).alias("y0"), F.array_max(points["x"]).alias("x1"), F.array_max(points["y"]).alias("y1"))


def _segments(parts: list[np.ndarray], closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Segments (x1, y1, x2, y2) of all parts, and the part of each; segments without length go."""
    found, of = [np.zeros((0, 4))], [np.zeros(0, int)]
    for k, p in enumerate(parts):
        q = np.roll(p, -1, axis=0) if closed else p[1:]
        s = np.hstack([p if closed else p[:-1], q])
        s = s[(s[:, :2] != s[:, 2:]).any(1)]
        found.append(s)
        of.append(np.full(len(s), k))
    return np.vstack(found), np.concatenate(of)


def _inside(points: np.ndarray, of: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether points lie in an odd number of rings of the polygon ``of`` each among ``edges`` (polygons, edges, 4); edges that are not numbers do not count."""
    out = np.zeros(len(points), bool)
    step = max(1, AT_ONCE // max(edges.shape[1], 1))
    for at in range(0, len(points), step):
        x, y = points[at : at + step].T[:, :, None]
        x1, y1, x2, y2 = np.moveaxis(edges[of[at : at + step]], 2, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            spans = (y1 > y) != (y2 > y)
            out[at : at + step] = (spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum(1) % 2 == 1
    return out


def _turned(edges: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Edges (polygons, edges, 4) so that the inside lies to their left: outer rings counter-clockwise, holes clockwise."""
    out, all_ = edges.copy(), np.arange(len(edges))
    area = edges[..., 0] * edges[..., 3] - edges[..., 2] * edges[..., 1]
    for k in range(int(ring.max(initial=-1)) + 1):
        own = ring == k
        first = edges[all_, own.argmax(1)]
        hole = _inside((first[:, :2] + first[:, 2:]) / 2, all_, np.where(own[..., None], np.nan, edges))
        wrong = own & ((np.where(own, area, 0).sum(1) > 0) == hole)[:, None]
        out[wrong] = edges[wrong][:, [2, 3, 0, 1]]
    return out


def _cut(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments ``a`` (pairs, segments, 4) cut wherever those of ``b`` of the same pair meet them: the pieces, the
    pair of each, for each +1 / -1 where it runs along a segment of ``b`` in its direction / against it, else 0, and
    whether any two of a pair meet. Segments that are not numbers fill up and are passed over."""
    pieces, pairs, along, met = [np.zeros((0, 4))], [np.zeros(0, int)], [np.zeros(0, int)], np.zeros(len(a), bool)
    db = b[..., 2:] - b[..., :2]
    lb = np.hypot(db[..., 0], db[..., 1])
    ends = b.reshape(len(b), -1, 2)
    step = max(1, AT_ONCE // max(len(b) * b.shape[1], 1))
    near = near[:, None, None]
    for at in range(0, a.shape[1], step):
        s = a[:, at : at + step]
        d = s[..., 2:] - s[..., :2]
        dx, dy = d[..., 0, None], d[..., 1, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            length = np.hypot(dx, dy)
            cross = dx * db[:, None, :, 1] - dy * db[:, None, :, 0]
            to = b[:, None, :, :2] - s[:, :, None, :2]
            t = (to[..., 0] * db[:, None, :, 1] - to[..., 1] * db[:, None, :, 0]) / cross
            u = (to[..., 0] * dy - to[..., 1] * dx) / cross
            slack, slack_b = near / length, near / lb[:, None]
            hit = (np.abs(cross) > 1e-14 * length * lb[:, None]) & (t >= -slack) & (t <= 1 + slack) & (u >= -slack_b) & (u <= 1 + slack_b)
            # Ends of b that lie on a, which also covers segments that run along each other.
            v = ends[:, None] - s[:, :, None, :2]
            te = (v[..., 0] * dx + v[..., 1] * dy) / length**2
            on = (np.abs(v[..., 0] * dy - v[..., 1] * dx) / length <= near) & (te >= -slack) & (te <= 1 + slack)
            met |= hit.any((1, 2)) | on.any((1, 2))
            edge = np.zeros((*s.shape[:2], 1))
            cuts = np.sort(np.clip(np.concatenate([edge, edge + 1, np.where(hit, t, 1), np.where(on, te, 1)], 2), 0, 1), 2)
            kept = np.concatenate([edge == 0, np.diff(cuts, axis=2) > slack], 2)
        pair, seg, place = np.nonzero(kept)
        same = (pair[:-1] == pair[1:]) & (seg[:-1] == seg[1:])
        value = cuts[pair, seg, place]
        value[:-1][~same] = 1.0  # the last cut of each segment
        value[-1:] = 1.0
        spots = s[pair, seg, :2] + value[:, None] * d[pair, seg]
        mine, pair, seg = np.hstack([spots[:-1][same], spots[1:][same]]), pair[:-1][same], seg[:-1][same]
        way = np.zeros(len(mine), int)
        few = max(1, AT_ONCE // max(b.shape[1], 1))
        for k in range(0, len(mine), few):
            m, p, g = mine[k : k + few], pair[k : k + few], seg[k : k + few]
            w = ((m[:, :2] + m[:, 2:]) / 2)[:, None] - b[p, :, :2]
            with np.errstate(divide="ignore", invalid="ignore"):
                share = (w * db[p]).sum(2) / lb[p] ** 2
                apart = np.abs(w[..., 0] * db[p, :, 1] - w[..., 1] * db[p, :, 0]) / lb[p]
                runs = (apart <= 2 * near[p, 0]) & (share > 0) & (share < 1) & (np.abs(cross[p, g]) <= 1e-6 * length[p, g] * lb[p])
            which = runs.any(1).nonzero()[0]
            way[k + which] = np.sign((db[p[which], runs[which].argmax(1)] * d[p[which], g[which]]).sum(1)).astype(int)
        pieces.append(mine)
        pairs.append(pair)
        along.append(way)
    return np.vstack(pieces), np.concatenate(pairs), np.concatenate(along), met


def _areas(a: np.ndarray, ring_a: np.ndarray, b: np.ndarray, ring_b: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of polygons, as edges (pairs, edges, 4) with their rings: the common area, whether ``b`` holds ``a``, and whether they touch at all."""
    a, b = _turned(a, ring_a), _turned(b, ring_b)
    pa_, of_pair_a, along_a, met = _cut(a, b, near)
    pb, of_pair_b, along_b, _ = _cut(b, a, near)
    of_a = (along_a == 1) | ((along_a == 0) & _inside((pa_[:, :2] + pa_[:, 2:]) / 2, of_pair_a, b))
    of_b = (along_b == 0) & _inside((pb[:, :2] + pb[:, 2:]) / 2, of_pair_b, a)
    count = lambda pair, weights: np.bincount(pair, weights, len(a))
    swept = lambda p: p[:, 0] * p[:, 3] - p[:, 2] * p[:, 1]
    held_a, held_b = count(of_pair_a, of_a), count(of_pair_b, of_b)
    area = np.maximum((count(of_pair_a[of_a], swept(pa_[of_a])) + count(of_pair_b[of_b], swept(pb[of_b]))) / 2, 0.0)
    whole = np.nansum(a[..., 0] * a[..., 3] - a[..., 2] * a[..., 1], 1) / 2
    return area, (held_b == 0) & (count(of_pair_a, ~of_a) == 0) & (np.abs(area - whole) <= 1e-9 * whole), (held_a > 0) | (held_b > 0) | met


def overlay(kind: str, parts: list[np.ndarray], polygon: list[np.ndarray]) -> tuple[float, bool] | None:
    """(overlap, whether the polygon holds the shape), or null where they do not even touch. The overlap is an
    area, a length, or 1 for points."""
    parts, polygon = [p for p in parts if len(p)], [p for p in polygon if len(p) > 2]
    if not parts or not polygon:
        return None
    origin = polygon[0][0]
    parts, polygon = [p - origin for p in parts], [p - origin for p in polygon]
    edges, of = _segments(polygon, True)
    near = TOLERANCE * max(np.abs(np.vstack(parts)).max(), np.abs(edges).max(initial=0.0), 1e-300)
    if kind == "point":
        points = np.vstack(parts)
        d = edges[:, 2:] - edges[:, :2]
        w = points[:, None] - edges[None, :, :2]
        t = np.clip((w * d).sum(2) / (d * d).sum(1), 0, 1)
        border = (np.hypot(*np.moveaxis(w - t[..., None] * d, 2, 0)) <= near).any(1)
        inside = _inside(points, np.zeros(len(points), int), edges[None]) & ~border
        return (1.0, bool((inside | border).all() and inside.any())) if (inside | border).any() else None
    if kind == "line":
        own, _ = _segments(parts, False)
        pieces, pair, along, met = _cut(own[None], edges[None], np.array([near]))
        held = (along != 0) | _inside((pieces[:, :2] + pieces[:, 2:]) / 2, pair, edges[None])
        size = np.hypot(*(pieces[:, 2:] - pieces[:, :2]).T)
        if not held.any() and not met[0]:
            return None
        return float(size[held].sum()), bool(held.all() and (along == 0).any())
    own, mine = _segments([p for p in parts if len(p) > 2], True)
    if not len(own):
        return None
    area, holds, met = _areas(own[None], mine[None], edges[None], of[None], np.array([near]))
    return (float(area[0]), bool(holds[0])) if met[0] else None


def _parts(value: list[list[dict]]) -> list[np.ndarray]:
    out = [np.array([(p["x"], p["y"]) for p in ring if p and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2) for ring in value if ring]
    return [p[:-1] if len(p) > 3 and (p[0] == p[-1]).all() else p for p in out if len(p) and np.isfinite(p).all()]


def _filled(values: list[np.ndarray], empty: float) -> np.ndarray:
    """Arrays of different lengths as one, filled up with ``empty``."""
    size = np.array([len(v) for v in values])
    out = np.full((len(values), size.max(), *values[0].shape[1:]), empty, values[0].dtype)
    out[np.arange(size.max()) < size[:, None]] = np.concatenate(values)
    return out


def _polygon_overlays(pairs: list[tuple[list[np.ndarray], list[np.ndarray]]]) -> list[tuple[float, bool] | None]:
    """``overlay`` of many pairs of polygons: those of like size are cut together, some ``AT_ONCE`` pairs of edges at a time."""
    out: list[tuple[float, bool] | None] = [None] * len(pairs)
    ready = []
    for k, (parts, polygon) in enumerate(pairs):
        polygon = [p for p in polygon if len(p) > 2]
        if not polygon or not parts:
            continue
        origin = polygon[0][0]
        own, mine = _segments([p - origin for p in parts if len(p) > 2], True)
        edges, of = _segments([p - origin for p in polygon], True)
        if len(own):
            near = TOLERANCE * max(max(np.abs(p - origin).max() for p in parts), np.abs(edges).max(initial=0.0), 1e-300)
            ready.append((len(own), len(edges), k, own, mine, edges, of, near))
    ready.sort(key=lambda r: r[:3])
    at = 0
    while at < len(ready):
        upto, most = at + 1, ready[at][1]
        while upto < len(ready) and (upto + 1 - at) * ready[upto][0] * max(most, ready[upto][1]) <= AT_ONCE:
            most = max(most, ready[upto][1])
            upto += 1
        some = ready[at:upto]
        a, ring_a, b, ring_b = (_filled([r[c] for r in some], empty) for c, empty in ((3, np.nan), (4, -1), (5, np.nan), (6, -1)))
        for r, area, holds, met in zip(some, *_areas(a, ring_a, b, ring_b, np.array([r[7] for r in some])), strict=True):
            if met:
                out[r[2]] = (float(area), bool(holds))
        at = upto
    return out


def _overlays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.to_pylist()
        shapes = [(_parts(r["parts"]), _parts(r["polygon"])) for r in given]
        polygons = [k for k, r in enumerate(given) if r["kind"] not in ("point", "line")]
        found = dict(zip(polygons, _polygon_overlays([shapes[k] for k in polygons]), strict=True))
        found |= {k: overlay(r["kind"], *shapes[k]) for k, r in enumerate(given) if r["kind"] in ("point", "line")}
        rows = [(r["location_id"], r["feature_id"], *found[k]) for k, r in enumerate(given) if found[k]]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["location_id", "feature_id", "overlap", "contains_input"])


def shape_match(locations: DataFrame, features: DataFrame, cell: float = CELL) -> DataFrame:
    """(location_id, feature_id, overlap double, contains_input boolean): polygons that a location touches at least.

    ``locations``: location_id, kind, parts; ``features``: feature_id, parts of a polygon. The overlap is the
    common area of a polygon, the length of a line inside, 1 for points. A polygon holds what lies in it and
    not only on its border. Null or empty shapes, rings of fewer than three points and points that are not
    finite match nothing; a shape that covers many cells meets another once. Rows that repeat an id are shapes of their own.
    """
    a = locations.where("size(parts) > 0").select("location_id", "kind", "parts", shape_box(F.col("parts")).alias("a"))
    b = features.where("size(parts) > 0").select("feature_id", F.col("parts").alias("polygon"), shape_box(F.col("parts")).alias("b"))
    a, b = (d.where(F.col(f"{n}.x0").isNotNull() & (F.abs(f"{n}.x0") + F.abs(f"{n}.y0") + F.abs(f"{n}.x1") + F.abs(f"{n}.y1") < 1e6)) for d, n in ((a, "a"), (b, "b")))
    spread = lambda df, n: _cells(df, F.col(f"{n}.x0"), F.col(f"{n}.y0"), F.col(f"{n}.x1"), F.col(f"{n}.y1"), cell)
    low = lambda axis: F.greatest(F.floor(F.col(f"a.{axis}0") / cell), F.floor(F.col(f"b.{axis}0") / cell))
    meets = (F.col("a.x0") <= F.col("b.x1")) & (F.col("a.x1") >= F.col("b.x0")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("a.y1") >= F.col("b.y0"))
    pairs = spread(a, "a").join(spread(b, "b"), ["gx", "gy"]).where((F.col("gx") == low("x")) & (F.col("gy") == low("y")) & meets)
    # Small tables meet in few tasks; the cutting is dealt over all cores.
    dealt = pairs.select("location_id", "kind", "parts", "feature_id", "polygon").repartition(features.sparkSession.sparkContext.defaultParallelism * 4, "location_id", "feature_id")
    return dealt.mapInArrow(_overlays, "location_id long, feature_id long, overlap double, contains_input boolean")


def _span(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Where low <= a + b t <= high holds, as bounds of t; the lower one is above the upper where it never does."""
    flat = F.abs(b) < 1e-12
    holds = (a >= low) & (a <= high)
    one, two = (low - a) / F.when(~flat, b), (high - a) / F.when(~flat, b)
    return F.when(flat, F.when(holds, F.lit(-1e18)).otherwise(F.lit(1e18))).otherwise(F.least(one, two)), F.when(flat, F.when(holds, F.lit(1e18)).otherwise(F.lit(-1e18))).otherwise(F.greatest(one, two))


def frontage_pieces(parcels: DataFrame, lines: DataFrame, buffer_m: float = BUFFER_M, cell: float = CELL) -> DataFrame:
    """(feature_id, edge, length_m, bearing): the pieces of each lot's outer ring within ``buffer_m`` of a centre line.

    ``parcels``: feature_id, ring (array of struct x, y; degrees); ``lines``: line_id, points (likewise).
    Everything is measured in metres in a projection at the middle of the lot's box. Around a segment of a
    line the buffer is exact, ends included; its part of an edge is one interval, and the intervals of all
    segments that reach an edge are united by a window, so that no length counts twice.
    """
    box = shape_box(F.array("ring"))
    lots = parcels.where("size(ring) > 2").select("feature_id", "ring", box.alias("box")).where("box.x0 is not null")
    lon0, lat0 = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    n = F.size("ring")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("edge"), F.get("ring", i).alias("p"), F.get("ring", (i + 1) % n).alias("q")))
    east = lambda x: (x - F.col("lon0")) * EARTH_M * F.cos(F.radians("lat0"))
    north = lambda y: (y - F.col("lat0")) * EARTH_M
    edges = lots.select("feature_id", lon0.alias("lon0"), lat0.alias("lat0"), "box", F.explode(sides).alias("s"))
    pad = F.lit(buffer_m / EARTH_M) / F.cos(F.radians("lat0")) * 1.01
    ends = lambda f, axis: f(F.col(f"s.p.{axis}"), F.col(f"s.q.{axis}"))
    edges = edges.select(
        "feature_id", F.col("s.edge").alias("edge"), east(F.col("s.p.x")).alias("px"), north(F.col("s.p.y")).alias("py"), east(F.col("s.q.x")).alias("qx"), north(F.col("s.q.y")).alias("qy"), "lon0", "lat0",
        (ends(F.least, "x") - pad).alias("x0"), (ends(F.least, "y") - pad).alias("y0"), (ends(F.greatest, "x") + pad).alias("x1"), (ends(F.greatest, "y") + pad).alias("y1"),
    )
    steps = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))
    runs = lines.where("size(points) > 1").select(F.explode(steps).alias("l")).select(F.col("l.a.x").alias("ax"), F.col("l.a.y").alias("ay"), F.col("l.b.x").alias("bx"), F.col("l.b.y").alias("by"))
    left = _cells(edges, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)
    right = _cells(runs, F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"), cell)
    met = left.join(right, ["gx", "gy"]).where((F.col("x0") <= F.greatest("ax", "bx")) & (F.col("x1") >= F.least("ax", "bx")) & (F.col("y0") <= F.greatest("ay", "by")) & (F.col("y1") >= F.least("ay", "by")))
    m = met.select("feature_id", "edge", "px", "py", (F.col("qx") - F.col("px")).alias("dx"), (F.col("qy") - F.col("py")).alias("dy"), east(F.col("ax")).alias("ax"), north(F.col("ay")).alias("ay"), east(F.col("bx")).alias("bx"), north(F.col("by")).alias("by"))
    m = m.withColumn("size", F.hypot("dx", "dy")).withColumn("l", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).where("size > 0")
    m = m.withColumn("ux", F.when(F.col("l") > 0, (F.col("bx") - F.col("ax")) / F.col("l")).otherwise(1.0)).withColumn("uy", F.when(F.col("l") > 0, (F.col("by") - F.col("ay")) / F.col("l")).otherwise(0.0))
    c = F.col
    wx, wy = c("px") - c("ax"), c("py") - c("ay")
    r = F.lit(float(buffer_m))
    s0, s1 = _span(wx * c("ux") + wy * c("uy"), c("dx") * c("ux") + c("dy") * c("uy"), F.lit(0.0), c("l"))
    o0, o1 = _span(wy * c("ux") - wx * c("uy"), c("dy") * c("ux") - c("dx") * c("uy"), -r, r)
    spans = [(F.greatest(s0, o0), F.least(s1, o1))]
    for ex, ey in (("ax", "ay"), ("bx", "by")):  # the round ends
        vx, vy = c("px") - c(ex), c("py") - c(ey)
        half = (vx * c("dx") + vy * c("dy")) / (c("size") * c("size"))
        free = half * half - (vx * vx + vy * vy - r * r) / (c("size") * c("size"))
        root = F.sqrt(F.when(free >= 0, free))
        spans.append((-half - root, -half + root))
    kept = F.filter(F.array(*[F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in spans]), lambda v: v["lo"] <= v["hi"])
    hull = with_value(kept, lambda v: F.when(F.size(v) > 0, F.struct(F.greatest(F.array_min(v["lo"]), F.lit(0.0)).alias("t0"), F.least(F.array_max(v["hi"]), F.lit(1.0)).alias("t1"))))
    # Exploding, not filtering: a filter would be moved down and the whole geometry repeated in it.
    m = m.select("feature_id", "edge", "size", "dx", "dy", F.explode(F.filter(F.array(hull), lambda v: v["t0"] < v["t1"])).alias("v")).select("*", "v.t0", "v.t1")
    w = Window.partitionBy("feature_id", "edge").orderBy("t0", "t1")
    before = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = m.withColumn("fresh", F.when(before.isNull() | (F.col("t0") > before), 1).otherwise(0)).withColumn("piece", F.sum("fresh").over(w))
    bearing = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    pieces = marked.groupBy("feature_id", "edge", "piece").agg(((F.max("t1") - F.min("t0")) * F.first("size")).alias("length_m"), F.first(bearing).alias("bearing"))
    return pieces.select("feature_id", "edge", "length_m", "bearing")


def lot_frontage(parcels: DataFrame, lines: DataFrame, buffer_m: float = BUFFER_M) -> DataFrame:
    """(feature_id, area_m2, perimeter_m, frontage_m, depth_m, corner) of each lot's outer ring.

    Depth is area by frontage, null where the frontage is a metre or less. A corner lot has pieces of more
    than 1.1 buffers (and of a metre) whose bearings are more than 30 degrees apart. A lot without a ring of three points has nulls.
    """
    pieces = frontage_pieces(parcels, lines, buffer_m)
    fronts = pieces.groupBy("feature_id").agg(
        F.sum("length_m").alias("frontage_m"), F.array_sort(F.collect_set(F.when(F.col("length_m") >= max(1.0, 1.1 * buffer_m), F.round("bearing", 9)))).alias("bearings")
    )
    box = shape_box(F.array("ring"))
    lots = parcels.select("feature_id", F.when(F.size("ring") > 2, F.col("ring")).alias("ring")).withColumn("lat0", (box["y0"] + box["y1"]) / 2)
    n, x_m = F.size("ring"), F.cos(F.radians("lat0")) * EARTH_M
    first = F.get("ring", F.lit(0))
    at = lambda i: (
        (F.get("ring", i % n)["x"] - first["x"]) * x_m,
        (F.get("ring", i % n)["y"] - first["y"]) * EARTH_M,
    )
    steps = F.sequence(F.lit(0), n - 1)
    area = F.abs(F.aggregate(F.transform(steps, lambda i: at(i)[0] * at(i + 1)[1] - at(i + 1)[0] * at(i)[1]), F.lit(0.0), lambda s, v: s + v)) / 2
    around = F.aggregate(F.transform(steps, lambda i: F.hypot(at(i + 1)[0] - at(i)[0], at(i + 1)[1] - at(i)[1])), F.lit(0.0), lambda s, v: s + v)
    apart = F.exists("bearings", lambda x: F.exists("bearings", lambda y: F.least(F.abs(x - y), 180 - F.abs(x - y)) > 30))
    sized = lots.select("feature_id", F.when(n > 0, area).alias("area_m2"), F.when(n > 0, around).alias("perimeter_m")).join(fronts, "feature_id", "left")
    front = F.when(F.col("area_m2").isNotNull(), F.coalesce("frontage_m", F.lit(0.0)))
    return sized.select("feature_id", "area_m2", "perimeter_m", front.alias("frontage_m"), F.when(front > 1.0, F.col("area_m2") / front).alias("depth_m"), F.when(front.isNotNull(), F.coalesce(apart, F.lit(False))).alias("corner"))
