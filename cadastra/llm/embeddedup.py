"""Embedding near-dedup by int8 quantised tile products (operator 1).

Vectors are scaled to length 1 and quantised to int8 with one scale per vector. The rigorous
error of a quantised product follows from each vector's own quantisation error: with
x = x' + e and y = y' + f, |x.y - x'.y'| <= |e| + |f| + |e||f| by Cauchy-Schwarz. Only pairs
whose bound reaches the threshold are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.work import connected_components, staged

#: Vectors in a block; a tile compares two blocks.
BLOCK = 2048
#: Rows of a tile that are multiplied at once, so that a tile's products take 8 MB.
STRIP = 1024
#: Order of a tile's rows: both looks at a tile scale a pair's product in the same order, and so agree on what is open.
_ORDER = [("side", "ascending"), ("vec_id", "ascending")]


def _unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, unit) of vectors without null or non-finite components that are not all zero."""
    for batch in batches:
        lists = batch.column("x")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        begin = np.cumsum(size) - size
        for dim in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == dim)
            x = flat[begin[rows][:, None] + np.arange(dim)].astype(np.float64)
            largest = np.abs(x).max(1)
            rows, x, largest = (v[np.isfinite(largest) & (largest > 0)] for v in (rows, x, largest))
            x = x / largest[:, None]  # so that squares neither overflow nor vanish
            x = x / np.sqrt((x * x).sum(1))[:, None]
            units = pa.array([v.tobytes() for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("label").take(rows), pa.array(np.full(len(rows), dim, np.int32)), units], names=["vec_id", "label", "dim", "unit"])


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and bounds of the length of what is lost."""
    scale = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - whole * scale[:, None], axis=1) * (1 + 1e-12) + 1e-12
    return whole, scale, error


def _with_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = batch.take(np.flatnonzero(dims == dim))
            whole, scale, error = quantised(_matrix(part.column("unit"), np.float64))
            codes = pa.array([v.tobytes() for v in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "label", "dim", "copies")), codes, pa.array(scale), pa.array(error)], names=["vec_id", "label", "dim", "copies", "codes", "scale", "error"])


def _products(whole: np.ndarray, scale: np.ndarray, error: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b) of a tile that may reach the threshold, and whether they surely do, strip by strip."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    # Products of int8 are exact in float32 up to 2**24, that is for 1040 dimensions; wider vectors use float64.
    exact = np.float32 if whole.shape[1] <= 1040 else np.float64
    columns = whole[right].astype(exact).T
    for at in range(0, len(left), STRIP):
        rows = left[at : at + STRIP]
        near = (whole[rows].astype(exact) @ columns) * scale[rows][:, None].astype(exact) * scale[right].astype(exact)
        e, f = error[rows][:, None], error[right]
        apart = (1e-6 + e + f + e * f).astype(exact)  # float32 rounds the scaled product by less than 1e-6
        a, b = np.nonzero(near + apart >= exact(threshold))
        surely = (near - apart)[a, b] >= exact(threshold)
        a, b = rows[a], right[b]
        if same:
            once = a < b
            a, b, surely = a[once], b[once], surely[once]
        yield a, b, surely


def _linked(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector the number of linked copies, and the smallest id of its component."""
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    return links.astype(np.int64), ids[spanning_roots(len(ids), a, b, ids)]


def _tile(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        """Of one tile: links that the bounds prove, and which vectors have pairs that they leave open."""
        table = table.sort_by(_ORDER)
        side, ids, copies, scale, error = (table.column(c).to_numpy() for c in ("side", "vec_id", "copies", "scale", "error"))
        open_ = np.zeros(len(ids), bool)
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, surely in _products(_matrix(table.column("codes"), np.int8), scale, error, side, threshold):
            open_[a[~surely]] = open_[b[~surely]] = True
            found_a.append(a[surely])
            found_b.append(b[surely])
        links, root = _linked(ids, copies, np.concatenate(found_a), np.concatenate(found_b))
        used = np.flatnonzero((links > 0) | open_)
        return table.select(["label", "dim", "low", "high", "side", "vec_id", "copies"]).take(used).append_column("links", pa.array(links[used])).append_column("root", pa.array(root[used])).append_column("open", pa.array(open_[used]))

    return compare


def _exact_tile(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        """Links among the pairs of a tile that the bounds leave open, in double precision."""
        table = table.sort_by(_ORDER)
        side, ids, copies = (table.column(c).to_numpy() for c in ("side", "vec_id", "copies"))
        unit = _matrix(table.column("unit"), np.float64)
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, surely in _products(*quantised(unit), np.where((side == side.min()), 0, 1), threshold):
            a, b = a[~surely], b[~surely]
            for k in range(0, len(a), 1 << 16):
                x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                reached = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                found_a.append(x[reached])
                found_b.append(y[reached])
        links, root = _linked(ids, copies, np.concatenate(found_a), np.concatenate(found_b))
        used = np.flatnonzero(links > 0)
        return pa.table({"vec_id": ids[used], "links": links[used], "root": root[used]})

    return compare


def spanning_roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n nodes the node with the smallest id in its component, by repeated minima and jumps."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    low = rank.copy()
    while len(a):
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        np.minimum.at(low, order[before[a]], m)
        np.minimum.at(low, order[before[b]], m)
        low = low[order[low]]
        if (low == before).all():
            break
    return order[low]


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: its columns plus n_links long, component_id long, kept boolean.

    Two vectors link if their labels are equal and not null, they have the same length and their
    cosine in double precision is ``threshold`` or more. Vectors that are null, empty or zero, or
    hold null or non-finite components, and rows with a null id or label, link with nothing. An id
    should name one vector: rows that repeat an id count as one node with the vector that is
    smallest by label and bytes, and each of them gets that node's result. component_id is the smallest id
    reachable by links (its own if there are none), kept says whether that is the row's own id.
    Clashing columns are replaced; an empty table gives an empty table.

    Copies of a vector under a label are compared once, by their smallest id. Vectors of a label
    are dealt into even blocks of ``block`` by hash; a tile takes the int8 codes, scales and error
    bounds of two blocks to one task. Whole vectors follow only where the bounds leave a pair open.
    Tiles give back counts and spanning forests, never their pairs.
    """
    new = ("n_links", "component_id", "kept")
    kept = [c for c in vectors.columns if c.lower() not in new]
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(embedding).cast("array<double>").alias("x"),
    ).where("vec_id is not null and label is not null and size(x) > 0")
    units = rows.mapInArrow(_unit_vectors, "vec_id long, label string, dim int, unit binary")
    nodes = staged(units.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "unit")).alias("r")).select("vec_id", "r.label", "r.dim", "r.unit"), "vectors")
    classes = staged(nodes.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "vector-classes")

    # Written, so that Spark knows how small it is and joins without dealing the vectors by label.
    sizes = staged(classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "vector-blocks")
    codes = classes.mapInArrow(_with_codes, "vec_id long, label string, dim int, copies long, codes binary, scale double, error double")
    dealt = codes.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")))
    placed = dealt.withColumn("tile", F.explode(others)).select(
        "label", "dim", "tile.low", "tile.high", F.when(F.col("block") == F.col("tile.low"), 0).otherwise(1).alias("side"), "vec_id", "copies", "codes", "scale", "error"
    )
    tile = ["label", "dim", "low", "high"]
    bounded = staged(placed.groupBy(*tile).applyInArrow(_tile(threshold), "label string, dim int, low long, high long, side int, vec_id long, copies long, links long, root long, open boolean"), "vector-tiles")
    left = bounded.where("open").select(*tile, "side", "vec_id", "copies").join(classes.select("vec_id", "unit"), "vec_id")
    exact = left.groupBy(*tile).applyInArrow(_exact_tile(threshold), "vec_id long, links long, root long")
    links = staged(bounded.where("links > 0").select("vec_id", "links", "root").unionByName(exact), "vector-links")

    between = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    reps = classes.select("label", "dim", "unit", F.col("vec_id").alias("rep"), "copies")
    per_class = (
        reps.join(between.withColumnRenamed("vec_id", "rep"), "rep", "left")
        .join(components.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "dim", "unit", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    result = nodes.join(per_class, ["label", "dim", "unit"]).select(F.col("vec_id").alias("__id"), "n_links", "component_id")
    source = vectors.select(*[F.col(f"`{c}`") for c in kept])
    own = F.col(vec_id).cast("long")
    return (
        source.join(result, own == F.col("__id"), "left")
        .drop("__id")
        .withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        .withColumn("component_id", F.coalesce("component_id", own))
        .withColumn("kept", F.coalesce(F.col("component_id") == own, F.lit(True)))
    )
