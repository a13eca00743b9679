"""The manifest against trees built one by one."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from cadastra.llm.merkle import field, leaf_hash, merkle_manifest, proof_text

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(hashes):
    """Root, and per leaf its (left, right) siblings from the bottom up."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, i in enumerate(at):
            run = hashes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
            at[k] = i // 8
        hashes = [H(*hashes[r : r + 8]) for r in range(0, len(hashes), 8)]
    return hashes[0], paths


def wanted(rows, broken):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in langs:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in by[name]])
    root, tops = tree([trees[name][0] for name in langs])
    out = []
    for name, top in zip(langs, tops, strict=True):
        for r, path in zip(by[name], trees[name][1], strict=True):
            folded = H("broken") if broken(r) else leaf(r)
            for left, right in path + top:
                folded = H(*left, folded, *right)
            out.append((repr(r[0]), leaf(r), trees[name][0], root, "".join("".join(a + b) for a, b in path + top), folded, folded == root))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = merkle_manifest(df, FIELDS, tampered=F.when(F.col("n_chars") == 3, F.sha2(F.lit("broken").cast("binary"), 256)))
    found = sorted((repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["text"], r["folded_root"], r["verified"]) for r in got.withColumn("text", proof_text(F.col("proof"))).collect())
    assert found == wanted(rows, lambda r: r[3] == 3)
    return found


def test_sizes_around_runs_and_blocks(spark):
    sizes = [1, 7, 8, 9, 64, 65, 512, 513]
    assert len(check(spark, [(i * 3, "s", f"n{n}", i % 5, f"t{i}") for n in sizes for i in range(n)])) == sum(sizes)


def test_one_group(spark):
    check(spark, [(i, "s", "en", i % 5, f"t{i}") for i in range(9)])


def test_groups_nulls_and_repeats(spark):
    """A null group, groups of one, ids and rows that repeat, nulls in every column, and names beyond ASCII."""
    rows = [(i, "s", ["en", "de", None, "Z", "é", "zh", "a", "", "q", "r"][i % 10], i % 4, f"text {i}") for i in range(730)]
    rows += [(None, None, None, None, None), (None, "x", "en", 1, ""), (3, "s", "en", 3, "another"), (3, "s", "en", 3, "another"), (9, "s", "lone", None, "Größe 中 😀")]
    found = check(spark, rows)
    assert {r[6] for r in found} == {True, False}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle_manifest(df, FIELDS).count() == 0


def test_very_long_text(spark):
    text = "ä" * 3_000_000
    row = spark.createDataFrame([(1, "s", "en", 3_000_000, text, 1, "")], SCHEMA).select(leaf_hash(*[F.col(c) for c in FIELDS]).alias("h"), field(F.lit(None)).alias("nothing")).first()
    assert (row["h"], row["nothing"]) == (leaf((1, "s", "en", 3_000_000, text)), "-")
