"""The open model of operator 8 against its formula, and against what a fixed table cannot hold."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from cadastra.llm import quality


def _formula(texts):
    counts = {4: Counter()}
    for t in texts:
        s = [0] * 3 + [ord(c) + 1 for c in t] + [0]
        counts[4].update(zip(s, s[1:], s[2:], s[3:], strict=False))
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    same = {o: Counter() for o in counts}
    freed = {o: Counter() for o in counts}

    def discount(order, n):
        k = Counter(counts[order].values())
        if not (k[1] and k[2] and k[3]):
            return [0.5, 1.0, 1.5][min(n, 3) - 1]
        y, i = k[1] / (k[1] + 2 * k[2]), min(n, 3)
        return max(0, min(i, i - (i + 1) * y * k[i + 1] / k[i]))

    for o, grams in counts.items():
        d = {i: discount(o, i) for i in (1, 2, 3)}
        for g, n in grams.items():
            same[o][g[:-1]] += n
            freed[o][g[:-1]] += d[min(n, 3)]

    def prob(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        o, low = len(gram), prob(gram[1:])
        total = same[o][gram[:-1]]
        if not total:
            return low
        n = counts[o][gram]
        return ((n - discount(o, n) if n else 0) + freed[o][gram[:-1]] * low) / total

    return prob


def test_open_model_is_the_formula(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 40)  # several blocks
    monkeypatch.setattr(quality, "PACK_BYTES", 20)
    texts = ["the cat sat.", "The dog sat down!", "a cat, a dog", "é1 2\n3 日本 \U0001f600"] * 3 + ["zq"]
    asked = [*texts, "", None, "The cat\U0001f600", "日本 é1", "unseen ßœ", "\x00"]
    prob = _formula(texts)
    counts = quality.count_open(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").where("text <> ''"))
    docs = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    got = {r["id"]: r["perplexity"] for r in quality.open_perplexity(docs, counts).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        if not t:
            assert got[i] is None
            continue
        s = [0] * 3 + [ord(c) + 1 for c in t] + [0]
        grams = list(zip(s, s[1:], s[2:], s[3:], strict=False))
        assert got[i] == pytest.approx(math.exp(-sum(math.log(prob(g)) for g in grams) / len(grams)), rel=1e-5)


def test_what_is_counted_grows_and_tells_letters_apart(spark):
    r = random.Random(5)
    texts = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2000)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert quality.count_open(docs)[4].count() > 64**3  # more than a table over 64 classes could tell apart
    # Capitals, digits and letters beyond ASCII are not one symbol.
    rows = [(i, f"{'ABBA' * 9} 1881 " + "éèéè" * 9, "x") for i in range(60)]
    odd = spark.createDataFrame([*rows, (99, f"{'QXXQ' * 9} 7227 " + "œøœø" * 9, "x")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality.score_quality(odd, odd.where("doc_id < 60").select("doc_id")).collect()}
    assert all(got[i] for i in range(60)) and not got[99]
