"""N-gram Jaccard self-join by vertical partitioning (operator 5).

The global n-gram order is the order of 64-bit hashes, cut into fragments. Fragment by fragment,
the join counts how many n-grams of each set no other surviving set has; as soon as these partial
counts pass what a linked set may miss, the set is done. Survivors are dealt into small blocks by
their smallest n-gram, and blocks that share one of the rarest n-grams of their sets (enough of
them that linked sets must meet) make a tile. The overlaps of a tile's pairs are counted for each
fragment in another task, without pairs that the fragment already rules out, and then summed per
pair. A tile gives back counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.embeddedup import spanning_roots
from cadastra.llm.textarrays import Words, mix, slices
from cadastra.llm.work import connected_components, staged, unstage

#: Upper ends of the fragments, as shares of the hash range. The first is just wide enough to end
#: most documents that share little.
FRAGMENTS = (0.22, 0.6, 1.0)
#: Sets in a block, their n-grams, and columns of a tile's matrices.
BLOCK, BLOCK_TOKENS, COLUMNS = 256, 1 << 18, 4096
#: Sets that share an n-gram with more blocks than this are dealt into blocks of BLOCK sets, whatever they hold.
HOT_BLOCKS = 64
#: Rows of tiles that a task works on at once.
BUCKET_ROWS = 4096
#: Classes up to this number are broadcast (40 MB) to pick their texts; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_U = np.uint64


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles: runs of ``size`` lower-cased (A-Z) words, or
    the whole sequence where a text has fewer; none without words."""
    words = Words(texts, lower=True)
    starts, per = words.gram_starts(size)
    grams = words.grams(starts, starts + size)
    ends = np.cumsum(per)
    short = words.grams(words.first[:-1], words.first[1:])
    return [np.unique(grams[e - p : e]) if p else (short[d : d + 1] if words.counts[d] else grams[:0]) for d, (p, e) in enumerate(zip(per.tolist(), ends.tolist(), strict=True))]


def set_sums(sets: list[np.ndarray]) -> np.ndarray:
    """Size and two 64-bit sums of each set: its fingerprint."""
    return np.array([[len(s), s.sum(dtype=_U), mix(s).sum(dtype=_U)] for s in sets], _U).reshape(-1, 3).view(np.int64)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sums = set_sums(shingle_sets(batch.column("text"), size))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(sums[:, i].copy()) for i in range(3))], names=["doc_id", "n", "s1", "s2"])

    return run


def _bounds(low: float, high: float) -> tuple[int, int]:
    """A fragment as a range of the upper 32 bits of a hash."""
    return int(low * 2**32), int(high * 2**32)


def _part(tokens: str, first: int, last: int) -> Column:
    """The tokens of an array that lie in a fragment."""
    return F.filter(tokens, lambda x: F.shiftrightunsigned(x, 32).between(first, last - 1))


def _tokens(size: int, low: float, high: float):
    """(doc_id, token) for the tokens of one fragment of the hash range, of texts whose set is the given one."""
    first, last = _bounds(low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), size)
                given = np.stack([batch.column(c).to_numpy() for c in ("n", "s1", "s2")], 1)
                mine = (set_sums(sets) == given).all(1)
                sets = [s[np.searchsorted(s, _U(first << 32)) : (np.searchsorted(s, _U(last << 32)) if last < 2**32 else len(s))] if ok else s[:0] for s, ok in zip(sets, mine, strict=True)]
                doc = np.repeat(batch.column("doc_id").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64))], names=["doc_id", "token"])

    return run


def _overlaps(lists: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common tokens of each list of ``left`` with each of ``right``, as sums of matrix products."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    token = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    _, column, often = np.unique(token, return_inverse=True, return_counts=True)
    keep = often[column] > 1  # others add to no overlap
    owner, column = owner[keep], (np.cumsum(often > 1) - 1)[column[keep]]
    total = np.zeros((len(left), len(right)), np.int32)
    width = int((often > 1).sum())
    order = np.argsort(column, kind="stable") if width > COLUMNS else slice(None)
    owner, column = owner[order], column[order]
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS)) if width > COLUMNS else (0, len(column))
        part = np.zeros((len(lists), min(COLUMNS, width - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += (part[left] @ part[right].T).astype(np.int32)
    return total


def _tiles_of(table: pa.Table) -> Iterator[np.ndarray]:
    """Row numbers of each tile of a bucket, its rows in the order of sides and ids where it has these."""
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    keys = [table.column(c).to_numpy() for c in ("doc_id", "side") if c in table.column_names]
    order = np.lexsort((*keys, hi, lo))
    cuts = np.flatnonzero((np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)) + 1
    return np.split(order, cuts) if len(order) else []


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, (right if len(right) else left), not len(right)


def _partial(num: int, den: int):
    """Overlaps in one fragment of the pairs of each tile that may still link."""

    def count(table: pa.Table) -> pa.Table:
        ids, n, copies, held, side, lo, hi = (table.column(c).to_numpy() for c in ("doc_id", "n", "copies", "held", "side", "lo", "hi"))
        lists = table.column("tokens").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        out: list[tuple] = []
        for rows in _tiles_of(table):
            left, right, _ = _sides(side[rows])
            if len(rows) < 2:
                continue
            part = _overlaps([flat[at[r] : at[r + 1]] for r in rows], left, right)
            rest = held[rows] - (at[rows + 1] - at[rows])
            most = part + np.minimum(rest[left][:, None], rest[right])
            part[(num + den) * most < num * (n[rows][left][:, None] + n[rows][right])] = 0
            if part.any():
                out.append((lo[rows[0]], hi[rows[0]], ids[rows], n[rows], copies[rows], side[rows], pa.compress(part.tobytes(), codec="zstd", asbytes=True)))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = ["lo", "hi", "ids", "n", "copies", "sides", "overlaps"]
        bucket = pa.array(np.full(len(out), table.column("bucket")[0].as_py()), pa.int64())
        return pa.table([bucket, *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=["bucket", *names])

    return count


def _summed(num: int, den: int):
    """Links of each tile from the sums of its fragments: per set the number of linked documents, and a forest that spans them."""

    def add(table: pa.Table) -> pa.Table:
        found = []
        for rows in _tiles_of(table):
            ids, n, copies, side = (np.array(table.column(c)[int(rows[0])].as_py()) for c in ("ids", "n", "copies", "sides"))
            left, right, same = _sides(side)
            shape = (len(left), len(right))
            overlap = np.zeros(shape, np.int64)
            for r in rows:
                packed = table.column("overlaps")[int(r)].as_py()
                overlap += np.frombuffer(pa.decompress(packed, decompressed_size=4 * shape[0] * shape[1], codec="zstd", asbytes=True), np.int32).reshape(shape)
            a, b = np.nonzero((overlap > 0) & (den * overlap >= num * (n[left][:, None] + n[right] - overlap)))
            a, b = left[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            root = spanning_roots(len(ids), a, b, ids)
            used = np.flatnonzero(links > 0)
            found.append((ids[used], links[used].astype(np.int64), ids[root[used]]))
        columns = [np.concatenate([f[i] for f in found] + [np.zeros(0, np.int64)]) for i in range(3)]
        return pa.table(columns, names=["doc_id", "links", "root"])

    return add


def jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 4, den: int = 5, block: int = BLOCK, hot_blocks: int = HOT_BLOCKS, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The columns of ``docs`` without ``text`` plus n_shingles long, n_links long, component_id long.

    A document's set holds its distinct shingles of ``size`` words (A-Z lower-cased runs of
    characters other than space and \\t to \\r); with fewer words, the whole sequence as one. Two
    documents link when den * intersection >= num * union. n_links counts the other documents
    linked directly, copies too; component_id is the smallest id reachable by links, its own
    included. Null texts and texts without words have an empty set and link with nothing; nor do
    rows with a null id, whose component is null. Ids should be unique: rows that repeat an id
    count as one document, with the set that is smallest by size and hashes, and all get its result.
    Clashing columns are replaced; an empty table stays empty.

    Documents with equal sets are one class, compared once. ``block``, ``hot_blocks`` and
    ``bucket_rows`` only change how the work is dealt, not the result.
    """
    new = ("n_shingles", "n_links", "component_id")
    others = [c for c in docs.columns if c.lower() not in new and c != text]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with_text = source.where("doc_id is not null and text is not null")

    def missing(n: Column) -> Column:
        """How many of its n shingles a set may miss in one that it links with."""
        return F.floor(n * (den - num) / F.lit(den))

    made = with_text.mapInArrow(_sets(size), "doc_id long, n long, s1 long, s2 long").where("n > 0")
    sets = staged(made.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("s")).select("doc_id", "s.n", "s.s1", "s.s2"), "sets")
    classes = staged(sets.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "classes")

    def texts_of(left: DataFrame) -> DataFrame:
        ids = left.select("doc_id", "n", "s1", "s2")
        return with_text.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id")

    left = classes.withColumn("alone", F.lit(0).cast("long"))
    low = 0.0
    texts = texts_of(left)
    for step, high in enumerate(FRAGMENTS):
        tokens = texts.mapInArrow(_tokens(size, low, high), "doc_id long, token long")
        once = tokens.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
        alone = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("more"))
        found = left.join(alone, "doc_id", "left").withColumn("alone", F.col("alone") + F.coalesce("more", F.lit(0)))
        left = staged(found.where(F.col("alone") <= missing(F.col("n"))).drop("more"), f"survivors-{step}")
        texts = staged(texts_of(left), f"survivor-texts-{step}")
        low = high

    tokens = texts.mapInArrow(_tokens(size, 0.0, 1.0), "doc_id long, token long")
    shared = staged(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared-tokens")
    ordered = tokens.join(shared, "token").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("c", "token"))).alias("t"))
    ready = ordered.join(left.select("doc_id", "n", "copies"), "doc_id").withColumn("tokens", F.transform("t", lambda x: x["token"]))
    # n - missing(n) of a set's n-grams are in each partner; the rarest that exceed that number minus one must meet.
    prefix = (missing(F.col("n")) - F.col("n") + F.size("tokens") + 1).cast("int")
    parts = F.array(*[_part("tokens", *_bounds(a, b)) for a, b in zip((0.0, *FRAGMENTS), FRAGMENTS, strict=False)])
    grade = F.floor(F.log("n") / (math.log(den / num) * 1.000001)) if num < den else F.col("n")
    ready = ready.withColumn("prefix", prefix).where("prefix > 0")
    ready = staged(
        ready.select("doc_id", "n", "copies", F.size("tokens").cast("long").alias("held"), grade.cast("long").alias("grade"), F.array_min("tokens").alias("anchor"), F.slice("tokens", F.lit(1), F.col("prefix")).alias("rare"), parts.alias("parts")),
        "token-sets",
    )
    unstage(shared)

    def numbers(of: DataFrame, *by: str) -> DataFrame:
        """How many blocks the sets of each group take."""
        return of.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("held") / BLOCK_TOKENS)).alias("blocks"))

    def dealt(of: DataFrame, *by: str) -> DataFrame:
        """``of`` with the block of each set: linked sets mostly share their smallest n-gram, large groups are cut evenly."""
        counts = staged(numbers(of, *by), "block-numbers")
        return of.join(counts, list(by)).withColumn("block", F.xxhash64(*by, F.pmod(F.xxhash64("doc_id"), F.col("blocks")))).drop("blocks")

    placed = staged(dealt(ready.select("doc_id", "held", "grade", "anchor"), "anchor", "grade").select("doc_id", "held", "grade", "block"), "places")

    def postings(places: DataFrame) -> DataFrame:
        return ready.select("doc_id", F.explode("rare").alias("token")).join(places.select("doc_id", "grade", "block"), "doc_id")

    blocks_of = postings(placed).groupBy("token", "block").agg(F.count(F.lit(1)).alias("m")).groupBy("token").agg(F.count(F.lit(1)).alias("blocks"), F.sum("m").alias("m"))
    met = staged(blocks_of.where("m > 1").select("token", (F.col("blocks") > hot_blocks).alias("hot")), "rare-tokens")
    hot = met.where("hot").select("token")
    is_hot = not hot.isEmpty()
    if is_hot:
        ids = staged(ready.select("doc_id", F.explode("rare").alias("token")).join(hot, "token", "left_semi").select("doc_id").distinct(), "hot-sets")
        even = dealt(placed.join(ids, "doc_id", "left_semi").drop("block").withColumn("kind", F.lit("hot")), "kind", "grade")
        placed = staged(placed.join(ids, "doc_id", "left_anti").unionByName(even.drop("kind")), "places")

    posted = staged(postings(placed).join(met, "token"), "postings")
    held_in = posted.groupBy("token", "hot", "block", "grade").agg(F.count(F.lit(1)).alias("m")).select("token", "hot", F.col("block").alias("other"), F.col("grade").alias("other_grade"), "m")
    near = (F.abs(F.col("grade") - F.col("other_grade")) <= (1 if num < den else 0)) & ((F.col("block") != F.col("other")) | (F.col("m") > 1))
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    side = F.when(F.col("block") == F.least("block", "other"), 0).otherwise(1).alias("side")
    tiles = posted.where("not hot").join(held_in.drop("hot"), "token").where(near).select("doc_id", lo, hi, side).distinct()
    if is_hot:
        holders = posted.where("hot").select("token", "block", "grade").distinct()
        pairs = holders.join(held_in.where("hot").drop("hot"), "token").where(near).select("block", lo, hi, side).distinct()
        tiles = tiles.unionByName(pairs.join(placed.select("doc_id", "block"), "block").select("doc_id", "lo", "hi", "side")).distinct()
    tiles = staged(tiles, "tiles")
    buckets = max(1, -(-tiles.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("lo", "hi"), F.lit(buckets)).alias("bucket")
    flat = tiles.join(ready, "doc_id").select(bucket, "lo", "hi", "side", "doc_id", "n", "copies", "held", F.posexplode("parts").alias("fragment", "tokens"))
    kinds = "bucket long, lo long, hi long, ids array<long>, n array<long>, copies array<long>, sides array<int>, overlaps binary"
    partial = flat.groupBy("bucket", "fragment").applyInArrow(_partial(num, den), kinds)
    links = staged(partial.groupBy("bucket").applyInArrow(_summed(num, den), "doc_id long, links long, root long"), "jaccard-links")

    between = links.groupBy("doc_id").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.join(between, "doc_id", "left")
        .join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("n", "s1", "s2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "doc_id").alias("component_id"))
    )
    result = sets.join(per_class, ["n", "s1", "s2"]).select(F.col("doc_id").alias("__id"), F.col("n").alias("n_shingles"), "n_links", "component_id")
    own = F.col(doc_id).cast("long")
    zero = F.lit(0).cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in others])
    return (
        rows.join(result, own == F.col("__id"), "left")
        .drop("__id")
        .withColumn("n_shingles", F.coalesce("n_shingles", zero))
        .withColumn("n_links", F.coalesce("n_links", zero))
        .withColumn("component_id", F.coalesce("component_id", own))
    )
