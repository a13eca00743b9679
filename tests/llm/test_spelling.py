"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadastra.llm.spelling import spelling_groups, word_counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def variants(seed, alphabet, lengths, base, edits):
    rng = random.Random(seed)
    counts = {}
    for _ in range(base):
        w = "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        counts[w] = rng.choice([5, 500, 40_000])
        for _ in range(edits):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + rng.choice(alphabet) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k + 1 :]])
            counts.setdefault(w, rng.choice([2, 3, 45, 450]))
    return counts


@pytest.mark.parametrize(
    ("seed", "alphabet", "lengths", "dealing"),
    [(1, "abc", range(6, 12), {}), (2, "ab", range(0, 5), {}), (3, "aàÿ×z😀", [3, 7, 8], {"part_letters": 60}), (4, "ab", range(5, 9), {"part_letters": 40, "bin_rows": 20}), (5, "abcdefgh", [1, 2, 90], {"bin_rows": 4})],
)
def test_groups(spark, seed, alphabet, lengths, dealing):
    counts = variants(seed, alphabet, list(lengths), 60, 6)
    rows = [(w, n - 1, "x") for w, n in counts.items()] + [(w, 1, "x") for w in counts] + [(None, 4, "x"), ("zzzz", None, "x")]
    df = spark.createDataFrame(rows, "word string, n int, form string")
    got = sorted((tuple(r) for r in spelling_groups(df, **dealing).collect()), key=lambda r: r[0])
    assert got == brute(counts)
    assert len({r[2] for r in got}) < len(got) and max(r[4] for r in got) > 1


def test_long_words_and_empty_table(spark):
    long = "ab" * 20_000
    rows = [(long, 1), (long[:-1], 50), (long[:100] + "x" + long[101:], 10), ("other", 5)]
    df = spark.createDataFrame(rows, "word string, n long")
    assert {len(r["word"]): (r["n_near"], r["form_n"]) for r in spelling_groups(df).where("word <> 'other'").collect() if r["n"] != 10} == {40_000: (2, 50), 39_999: (1, None)}
    assert spelling_groups(df.limit(0)).count() == 0


def test_word_counts(spark):
    texts = [(1, "Straße straße  STRASSE Über-übers x1y Ärger", "a"), (2, None, "a"), (3, "", "a"), (None, "Straße wörter", "a")] + [(i, "Gebäude gebäude und wörter " * (i % 3), "a") for i in range(4, 200)]
    df = spark.createDataFrame(texts, "doc_id long, text string, n string")
    want = Counter()
    for i, t, _ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    got = {r["word"]: r["n"] for r in word_counts(df, min_length=5, min_count=2, spoil=31).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 2}
    assert any(w not in ("gebäude", "wörter", "straße") for w in got)
    assert word_counts(df.limit(0)).count() == 0
    assert word_counts(df, min_length=1, min_count=1).agg(F.sum("n")).first()[0] == sum(want.values())
