"""Exact top-k inner products by norm-sorted blocks and SVD-rotated partial sums (operator 13).

Vectors are compared as whole numbers. They are dealt into slabs by length, longest first; the
longest block gives every query a first k-th score. After that a query meets only slabs whose longest
vector can still reach its k-th score (|q.x| <= |q||x|), and in a slab strip by strip of descending
length. An orthogonal rotation (singular vectors of all vectors) moves most of a product into the
first coordinates; what the rest can add is bounded by the lengths of the residuals (Cauchy-Schwarz).
Only pairs that both bounds leave open are multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.work import staged, unstage

#: Numbers in a block of vectors: 4,096 vectors of 64 components.
BLOCK_NUMBERS = 1 << 18
#: Queries of a tile, and candidates multiplied at once: 16 MB of products.
QUERIES, STRIP = 2048, 1024
#: Slabs by length; a slab of many vectors is dealt into blocks.
SLABS = 32
#: Dimensions with the most vectors that get a rotation of their own, and the largest one. Others are searched unrotated, with the same results.
ROTATED, ROTATED_DIM = 4, 1024
#: Pairs multiplied out at once.
PAIRS = 1 << 16
#: Share of a bound by which rounding may exceed it: far above the error of double precision at ROTATED_DIM.
SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


def _whole(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, dim, n2, whole) of vectors with all components finite; whole holds floor(scale * x) as 32-bit integers."""
        for batch in batches:
            lists = batch.column("x")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            for dim in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(flat[begin[rows][:, None] + np.arange(dim)].astype(np.float64) * scale)
                    good = (x * x).sum(1) < 2.0**62  # so that every product fits 64 bits; NaN and infinity fail too
                rows, x = rows[good], x[good].astype(np.int64)
                parts = pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), pa.array(np.full(len(rows), dim, np.int32)), pa.array((x * x).sum(1)), parts], names=["vec_id", "dim", "n2", "whole"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64)


def _gram(dims: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's sums of products of components, one row for each pair of components."""
        sums = {d: np.zeros((d, d)) for d in dims}
        for batch in batches:
            of = batch.column("dim").to_numpy()
            for d in set(dims) & set(of.tolist()):
                x = _matrix(batch.column("whole").take(np.flatnonzero(of == d))).astype(np.float64)
                sums[d] += x.T @ x
        for d, g in sums.items():
            if g.any():
                i, j = np.nonzero(np.ones((d, d), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(g.ravel())], names=["dim", "i", "j", "v"])

    return run


def rotations(nodes: DataFrame) -> dict[int, tuple[np.ndarray, int, int]]:
    """Per dimension the right singular vectors of all its vectors, and after how many coordinates products are
    looked at: where these hold 0.6 and 0.9 of the squared length. What comes to the driver is dim x dim
    numbers for ROTATED dimensions of up to ROTATED_DIM, however many vectors there are."""
    most = nodes.where(F.col("dim") <= ROTATED_DIM).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(ROTATED)
    dims = [r["dim"] for r in most.collect()]
    if not dims:
        return {}
    sums = nodes.select("dim", "whole").mapInArrow(_gram(dims), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    of, i, j, v = (sums.column(c).to_numpy() for c in ("dim", "i", "j", "v"))
    found = {}
    for d in dims:
        gram = np.zeros((d, d))
        gram[i[of == d], j[of == d]] = v[of == d]
        _, energy, rows = np.linalg.svd(gram)
        held = np.cumsum(energy) / max(energy.sum(), 1e-300)
        found[d] = (rows.T, int(np.searchsorted(held, 0.6)) + 1, int(np.searchsorted(held, 0.9)) + 1)
    return found


class _Best:
    """The k best (score, id) of every query so far, ties to the smaller id."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.floor, self.k = floor.copy(), k
        self.query, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        kept = order[np.arange(len(order)) - first < self.k]
        self.query, self.score, self.ids = (np.sort(query[np.arange(len(order)) - first < self.k]), score[kept], ids[kept])
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.floor)) >= self.k)
        last = np.searchsorted(self.query, full, "right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


def _search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, rotation: tuple[np.ndarray, int, int] | None) -> _Best:
    """The best of the candidates ``x`` (longest first) for each query that can reach its floor."""
    best, dim = _Best(floor, k), q.shape[1]
    turn, h, h2 = rotation or (None, (dim + 1) // 2, (dim + 1) // 2)
    yq, yx = (m.astype(np.float64) if turn is None else m.astype(np.float64) @ turn for m in (q, x))
    nq, nx = np.linalg.norm(yq, axis=1), np.linalg.norm(yx, axis=1)
    rest_q, rest_x, rest_q2, rest_x2 = (np.linalg.norm(m[:, at:], axis=1) for at in (h, h2) for m in (yq, yx))
    exact_in_double = bool(len(nx)) and nq.max(initial=0) * nx.max() < 2.0**52
    for at in range(0, len(x), STRIP):
        s = slice(at, at + STRIP)
        live = np.flatnonzero(nq * nx[s].max() * (1 + SLACK) >= best.floor)
        if not len(live):
            break  # all that follow are shorter
        slack = SLACK * nq[live][:, None] * nx[s]
        near = yq[live, :h] @ yx[s, :h].T
        a, b = np.nonzero(near + rest_q[live][:, None] * rest_x[s] + slack >= best.floor[live][:, None])
        if len(a) * 8 > near.size:
            products = (q[live].astype(np.float64) @ x[s].T.astype(np.float64)).astype(np.int64) if exact_in_double else q[live] @ x[s].T
            other = q_ids[live][:, None] != x_ids[s]
            products[~other] = _NONE
            low = best.floor[live]
            if products.shape[1] > k:
                low = np.maximum(low, np.partition(products, -k, axis=1)[:, -k])
            a, b = np.nonzero((products >= low[:, None]) & other)
            best.add(live[a], products[a, b], x_ids[s][b])
            continue
        for c in range(0, len(a), PAIRS):
            i, j = live[a[c : c + PAIRS]], b[c : c + PAIRS] + at
            closer = near[a[c : c + PAIRS], b[c : c + PAIRS]] + np.einsum("ij,ij->i", yq[i, h:h2], yx[j, h:h2])
            open_ = (closer + rest_q2[i] * rest_x2[j] + SLACK * nq[i] * nx[j] >= best.floor[i]) & (q_ids[i] != x_ids[j])
            i, j = i[open_], j[open_]
            score = np.einsum("ij,ij->i", q[i], x[j])
            reached = score >= best.floor[i]
            best.add(i[reached], score[reached], x_ids[j[reached]])
    return best


def _tile(k: int, turns: dict[int, tuple[np.ndarray, int, int]]) -> Callable[[pa.Table], pa.Table]:
    def compare(table: pa.Table) -> pa.Table:
        """Of one tile the k best candidates of each of its queries."""
        is_query = table.column("is_query").to_numpy()
        queries = table.filter(pa.array(is_query)).sort_by("vec_id")
        candidates = table.filter(pa.array(~is_query)).sort_by([("n2", "descending"), ("vec_id", "ascending")])
        ids = [t.column("vec_id").to_numpy() for t in (queries, candidates)]
        if not len(ids[0]) or not len(ids[1]):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, x = _matrix(queries.column("whole")), _matrix(candidates.column("whole"))
        best = _search(q, ids[0], queries.column("floor").to_numpy(), x, ids[1], k, turns.get(q.shape[1]))
        return pa.table({"query_id": ids[0][best.query], "vec_id": best.ids, "score": best.score})

    return compare


def top_k_products(vectors: DataFrame, query: Column, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id", embedding: str = "embedding", block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(query_id long, rank int from 1, vec_id long, score long): of each row that ``query`` picks, the k
    rows with the highest integer inner product of floor(scale * component), ties to the smaller vec_id.

    All rows but the query's own are candidates, of the query's number of components. Vectors that are
    null or empty or hold null or non-finite components, rows with a null id, and vectors whose squared
    length is 2**62 or more (their products would not fit 64 bits) take no part; a zero vector does, with
    products of 0. Rows that repeat an id count as one row, with the vector that is smallest by
    length and bytes. A query with fewer than k candidates returns all of them, one with none no row; a null condition picks
    nothing. Other columns are ignored; an empty table gives an empty table.

    Queries and candidates meet in tiles of bounded size, the stated query set against all rows in blocks;
    a tile gives back k rows a query at most. Equally long vectors fall into one slab and are dealt into
    blocks by hash.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"), query.alias("asks")).where("vec_id is not null and size(x) > 0")
    asks = staged(rows.where("asks").select("vec_id").distinct(), "topk-asks")
    whole = rows.select("vec_id", "x").mapInArrow(_whole(scale), "vec_id long, dim int, n2 long, whole binary")
    nodes = staged(whole.groupBy("vec_id").agg(F.min(F.struct("dim", "n2", "whole")).alias("r")).select("vec_id", "r.*"), "topk-vectors")
    turns = rotations(nodes)

    cuts = staged(nodes.groupBy("dim").agg(F.percentile_approx("n2", [i / SLABS for i in range(1, SLABS)], 10_000).alias("cuts")), "topk-cuts")
    in_slabs = nodes.join(cuts, "dim").withColumn("slab", F.size(F.filter("cuts", lambda c: c >= F.col("n2")))).drop("cuts")
    sizes = in_slabs.groupBy("dim", "slab").agg(F.max("n2").alias("longest"), F.count(F.lit(1)).alias("rows"))
    slabs = staged(sizes.select("dim", "slab", "longest", F.ceil(F.col("rows") * F.col("dim") / block_numbers).alias("blocks")), "topk-slabs")
    candidates = staged(in_slabs.join(slabs.drop("longest"), ["dim", "slab"]).select("vec_id", "dim", "slab", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), "n2", "whole"), "topk-candidates")

    own = nodes.join(asks, "vec_id", "left_semi")
    parts = staged(own.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")), "topk-parts")
    queries = staged(own.join(parts, "dim").select("vec_id", "dim", "n2", "whole", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part")), "topk-queries")

    def searched(asked: DataFrame) -> DataFrame:
        """``asked`` (columns of queries, floor, slab, block) against the blocks they name."""
        keys = ["dim", "slab", "block", "part"]
        tiles = asked.select(*keys).distinct()
        met = candidates.join(tiles, ["dim", "slab", "block"]).select(*keys, "vec_id", "n2", "whole", F.lit(_NONE).alias("floor"), F.lit(False).alias("is_query"))
        both = met.unionByName(asked.select(*keys, "vec_id", "n2", "whole", "floor", F.lit(True).alias("is_query")))
        return both.groupBy(*keys).applyInArrow(_tile(k, turns), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    heads = slabs.groupBy("dim").agg(F.min("slab").alias("slab"))
    first = staged(searched(queries.join(heads, "dim").select("*", F.lit(_NONE).alias("floor"), F.lit(0).cast("long").alias("block"))), "topk-first")
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reached"))
    # What a product can reach is compared in double precision, with room for its rounding.
    reach = F.sqrt(F.col("n2").cast("double")) * F.sqrt(F.col("longest").cast("double")) * (1 + SLACK)
    left = (
        queries.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
        .join(slabs, "dim")
        .where(F.col("reached").isNull() | (reach >= F.col("reached")))
        .withColumn("floor", F.coalesce("reached", F.lit(_NONE)))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    )
    left = left.join(heads.select("dim", F.col("slab").alias("head")), "dim").where("slab <> head or block <> 0")
    asked = staged(left.select("vec_id", "dim", "n2", "whole", "part", "floor", "slab", "block"), "topk-left")
    found = staged(first.unionByName(searched(asked)), "topk-found")
    for t in (asked, candidates, queries, first, nodes):
        unstage(t)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
