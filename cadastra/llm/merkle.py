"""Merkle dataset manifest by a nested-struct rollup (operator 11).

Every row is a leaf. The leaves of a group, in their order, are the lowest nodes of a tree; every
eight consecutive nodes become their parent until one is left. A node's rank in its group, written in
base eight, names its place: grouping away the last digit nests the children of a node into its
struct. That happens within blocks of a bounded number of nodes. The hashes of the blocks are the
lowest nodes of the next round. Proofs come down the same way: a block's nested structs meet the path
above the block in one group, and a transform and an explode give each leaf its siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.work import ranked, staged

#: Levels in a block: it holds 8**LEVELS nodes at most.
LEVELS = 3
BITS, FANOUT = 3, 8


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf holds it: ``-`` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def _rolled(nodes: DataFrame, level: int) -> DataFrame:
    """(grp, n, block, hash, kids): ``nodes`` (grp, n, rank, hash, item) in nested structs, one row a block.

    ``n`` is the number of lowest nodes of the whole tree, which tells where it ends. One exchange
    deals the blocks; every grouping after it keeps that.
    """
    digits = [F.shiftright("rank", BITS * i).bitwiseAND(FANOUT - 1).alias(f"d{i}") for i in range(LEVELS)]
    rows = nodes.select("grp", "n", F.shiftright("rank", BITS * LEVELS).alias("block"), *digits, "hash", "item").repartition("grp", "block")
    below = "item"
    for i in range(LEVELS):
        above = [f"d{k}" for k in range(LEVELS - 1, i, -1)]
        kids = F.sort_array(F.collect_list(F.struct(f"d{i}", "hash", below))).alias("kids")
        grouped = rows.groupBy("grp", "n", "block", *above).agg(kids)
        hashes = F.concat_ws("", "kids.hash").cast("binary")
        # With one node left the tree has ended below this level, and the node stays what it is.
        rows = grouped.withColumn("hash", F.when(F.col("n") > FANOUT ** (level + i), F.sha2(hashes, 256)).otherwise(F.col("kids")[0]["hash"]))
        below = "kids"
    return rows


def _paths(kids: Column, depth: int) -> Column:
    """Of nested structs of ``depth`` levels an array of (hash, item, path); path holds the left and right siblings, lowest level first."""
    hashes = kids["hash"]

    def siblings(i: Column) -> Column:
        return F.array(F.struct(F.slice(hashes, 1, i).alias("left"), F.slice(hashes, i + 2, FANOUT).alias("right")))

    if depth == 1:
        return F.transform(kids, lambda k, i: F.struct(k["hash"].alias("hash"), k["item"].alias("item"), siblings(i).alias("path")))
    return F.flatten(
        F.transform(kids, lambda k, i: F.transform(_paths(k["kids"], depth - 1), lambda x: F.struct(x["hash"].alias("hash"), x["item"].alias("item"), F.concat(x["path"], siblings(i)).alias("path"))))
    )


def _height(n: Column) -> Column:
    """Levels of a tree over ``n`` nodes: how many powers of eight are below n."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**i).cast("long") for i in range(21)]), lambda p: p < n))


def _proofs(rolled: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, n, hash, item, path, top) of every node of the blocks; ``above`` has (grp, block, path, top) of the blocks themselves."""
    nested = rolled.select("grp", "block", "n", "kids", F.lit(None).cast(above.schema["path"].dataType).alias("up"), F.lit(None).cast(above.schema["top"].dataType).alias("top"))
    paths = above.select("grp", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(rolled.schema["kids"].dataType).alias("kids"), F.col("path").alias("up"), "top")
    met = nested.unionByName(paths).groupBy("grp", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "up", "top")])
    each = met.select("grp", "n", "up", "top", F.explode(_paths(F.col("kids"), LEVELS)).alias("x"))
    return each.select("grp", "n", "x.hash", "x.item", F.concat("x.path", "up").alias("path"), "top")


def _tree(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks over ``nodes`` (grp, n, rank, hash, item), and the roots (grp, n, hash)."""
    rounds: list[DataFrame] = []
    while True:
        rounds.append(staged(_rolled(nodes, LEVELS * len(rounds)), name))
        nodes = rounds[-1].select("grp", "n", F.col("block").alias("rank"), "hash", F.struct(F.col("block").alias("rank")).alias("item"))
        if nodes.where("rank > 0").isEmpty():
            return rounds, nodes.select("grp", "n", "hash")


def _down(rounds: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """Proofs of the lowest nodes of a tree; ``above`` as in _proofs for the topmost blocks."""
    for k in range(len(rounds) - 1, 0, -1):
        found = _proofs(rounds[k], above)
        above = staged(found.select("grp", F.col("item.rank").alias("block"), "path", "top"), name)
    return _proofs(rounds[0], above)


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), order: str = "doc_id", group: str = "lang", tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``order`` and ``group`` as they are, leaf, subroot, root, proof, folded_root, verified.

    A leaf is the hash of ``fields``, each ``-`` if null, else its UTF-8 length, ``:`` and itself. The
    leaves of a group ascend by ``order`` (null first) and then by leaf, so that rows that repeat an id
    have a defined place; rows that are equal in all fields are as many equal leaves. A null group is a
    group of its own. Subroots ascend by group, null first, in the order of UTF-8 bytes, and give root in
    the same way. ``proof`` holds per level, lowest first, the siblings left and right of the node; the
    levels above the subroot follow those below it.

    ``tampered`` is a leaf hash (see leaf_hash) computed from what a checker has of a row; null means the
    row as it is. folded_root folds it with the row's own proof, verified says whether it is root.

    Texts are read once and not moved: only ids, groups and hashes are exchanged. Ranks come from a range
    partitioning and counts per part; no step holds more than a block of 512 nodes together, whatever the
    size of a group. Columns of ``docs`` beyond those named are ignored; an empty table gives an empty table.
    """
    told = leaf_hash(*[F.col(f"`{c}`") for c in fields])
    rows = staged(docs.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("place"), told.alias("hash"), (F.lit(None).cast("string") if tampered is None else tampered).alias("checked")), "merkle-leaves")
    nodes = ranked(rows, ["grp"], ["place", "hash"], "merkle-ranks").select("grp", "n", "rank", "hash", F.struct("place", "checked").alias("item"))
    rounds, subroots = _tree(nodes, "merkle-blocks")

    one = F.lit(None).cast("string")
    groups = ranked(staged(subroots.select(one.alias("whole"), F.col("grp"), F.col("n").alias("size"), "hash"), "merkle-subroots"), ["whole"], ["grp"], "merkle-groups")
    tops, root = _tree(groups.select(F.col("whole").alias("grp"), "n", "rank", "hash", F.struct(F.col("grp").alias("name"), "size", F.col("hash").alias("subroot")).alias("item")), "merkle-top")
    nothing = F.array().cast("array<struct<left:array<string>,right:array<string>>>")
    of_groups = _down(tops, root.select("grp", F.lit(0).cast("long").alias("block"), nothing.alias("path"), F.col("hash").alias("top")), "merkle-paths")
    # A path has as many levels as the blocks of all rounds; those above the tree's end have no siblings and are cut off.
    above = staged(
        of_groups.select(F.col("item.name").alias("grp"), F.lit(0).cast("long").alias("block"), nothing.alias("path"), F.struct(F.slice("path", F.lit(1), _height(F.col("n"))).alias("path"), F.col("item.subroot").alias("subroot"), F.col("top").alias("root")).alias("top")),
        "merkle-tops",
    )
    proofs = _down(rounds, above, "merkle-paths")
    path = F.concat(F.slice("path", F.lit(1), _height(F.col("n"))), F.col("top.path"))
    folded = F.aggregate("proof", F.coalesce("item.checked", "hash"), lambda h, p: F.sha2(F.concat(F.concat_ws("", p["left"]), h, F.concat_ws("", p["right"])).cast("binary"), 256))
    out = proofs.withColumn("proof", path).withColumn("folded_root", folded)
    return out.select(
        F.col("item.place").alias(order), F.col("grp").alias(group), F.col("hash").alias("leaf"), F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), "proof", "folded_root", (F.col("folded_root") == F.col("top.root")).alias("verified")
    )


def proof_text(proof: Column) -> Column:
    """All siblings of a proof one after the other, level by level, left to right."""
    return F.concat_ws("", F.flatten(F.transform(proof, lambda p: F.concat(p["left"], p["right"]))))
