"""Benchmark decontamination by pigeonhole edit matching (operator 7).

With an error budget of e word edits, a test item cut into e + 1 pieces keeps at least one piece
unchanged in any text within the budget. Pieces are looked up at every word of every document;
hits are verified with Myers' bit-parallel distance over words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.rows import with_columns_by_slice
from cadastra.llm.textarrays import plain_words
from cadastra.llm.work import staged

#: Words of test items that one pass over the documents holds in memory; larger benchmarks take more passes.
PASS_WORDS = 2_000_000
FILTER_BITS = 22
_U = np.uint64


def myers_end(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any stretch of the text, and where that ends (first of ties)."""
    m = len(pattern)
    last, full = 1 << (m - 1), (1 << m) - 1
    has: dict[int, int] = {}
    for i, w in enumerate(pattern):
        has[w] = has.get(w, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = has.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        vertical = eq | down
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Pieces:
    """The pieces of all test items: sorted hashes per piece length, with item and place."""

    def __init__(self, ids: list[int], texts: list[str], error_rate: float):
        words = plain_words(pa.array(texts, pa.large_string()))
        self.ids, self.items, self.budgets = ids, [], []
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for item in range(len(ids)):
            lo, m = int(words.first[item]), int(words.counts[item])
            self.items.append(words.hashes[lo : lo + m].tolist())
            budget = int(error_rate * m)
            self.budgets.append(budget)
            if not m:
                continue
            cuts = [m * i // (budget + 1) for i in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                h = int(words.grams(np.array([lo + a]), np.array([lo + b]))[0])
                rows.setdefault(b - a, []).append((h, item, a))
        self.by_length = {}
        for length, found in rows.items():
            found.sort()
            h = np.array([r[0] for r in found], _U)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[h >> _U(64 - FILTER_BITS)] = True
            self.by_length[length] = (h, np.array([r[1] for r in found]), np.array([r[2] for r in found]), bits)

    def matches(self, texts: pa.Array) -> list[dict[int, tuple[int, int]]]:
        """For each text: item index -> (distance, end word of the match in the text)."""
        words = plain_words(texts)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(texts))]
        tried: set[tuple[int, int, int]] = set()
        for length, (hashes, items, places, bits) in self.by_length.items():
            starts, per = words.gram_starts(length)
            if not len(starts):
                continue
            g = words.grams(starts, starts + length)
            maybe = np.flatnonzero(bits[g >> _U(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(hashes, g[maybe], "left"), np.searchsorted(hashes, g[maybe], "right")
            docs = np.repeat(np.arange(len(texts)), per)[maybe]
            for d, at, a, b in zip(docs.tolist(), starts[maybe].tolist(), lo.tolist(), hi.tolist(), strict=True):
                for r in range(a, b):
                    item = int(items[r])
                    begin = at - int(places[r]) - int(words.first[d])
                    if (d, item, begin) in tried or out[d].get(item, (1, 0))[0] == 0:
                        continue
                    tried.add((d, item, begin))
                    e, m = self.budgets[item], len(self.items[item])
                    frm, to = max(begin - e, 0), min(begin + m + e, int(words.counts[d]))
                    first = int(words.first[d])
                    distance, end = myers_end(self.items[item], words.hashes[first + frm : first + to].tolist())
                    if distance <= e and (item not in out[d] or (distance, frm + end) < out[d][item]):
                        out[d][item] = (distance, frm + end)
        return out


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, pass_words: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of about ``pass_words`` words."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // pass_words)
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in got], [r["text"] for r in got]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = 0.2, pass_words: int = PASS_WORDS) -> DataFrame:
    """All columns of ``docs`` plus item_ids array<long>, item_distances array<int>, item_ends array<int>.

    An item of m words matches a document that holds a stretch within floor(error_rate * m) word
    edits of it. Words are lower-cased runs of letters and digits (and characters beyond ASCII).
    For each matched item: its id, the smallest distance found and the word (from 0) after the
    stretch. Items of so few words that no edit is allowed match as exact phrases; items without
    words never match; null and empty texts match nothing. Whole texts are searched, so hits may
    be anywhere and of any number; repeated items or rows give repeated results. An empty
    benchmark leaves empty arrays. Clashing columns of ``docs`` are replaced.

    Items are searched in passes of about ``pass_words`` words, the most that the driver and a
    worker hold at once; each pass but the first reads the table that the one before it wrote.
    """
    spark = docs.sparkSession
    new = {"item_ids": "array<long>", "item_distances": "array<int>", "item_ends": "array<int>"}
    out = docs.drop(*[c for c in docs.columns if c.lower() in new])
    for c, t in new.items():
        out = out.withColumn(c, F.expr(f"cast(array() as {t})"))
    for i, (ids, texts) in enumerate(_item_blocks(benchmark, item_id, item_text, pass_words)):
        if i:
            out = staged(out, "decontamination-pass")
        # The key tells test sets apart in workers that serve several of them in turn.
        key = hashlib.sha256(repr((ids, texts, error_rate)).encode("utf-8", "surrogatepass")).hexdigest()
        shared = spark.sparkContext.broadcast((ids, texts))
        found = {f"__{c}": t for c, t in new.items()}

        def make(batch: pa.RecordBatch, shared=shared, key=key) -> dict[str, object]:
            pieces = _pieces(key, shared, error_rate)
            hits = [sorted((pieces.ids[k], *v) for k, v in doc.items()) for doc in pieces.matches(batch.column(text))]
            return {f"__{c}": [[h[j] for h in doc] for doc in hits] for j, c in enumerate(new)}

        out = with_columns_by_slice(out, found, make, text)
        for c in new:
            out = out.withColumn(c, F.concat(c, f"__{c}")).drop(f"__{c}")
    return out


_built: dict[str, Pieces] = {}


def _pieces(key: str, shared, error_rate: float) -> Pieces:
    """The pieces of the test items with the digest ``key``, built once per worker process."""
    if key not in _built:
        _built.clear()
        _built[key] = Pieces(*shared.value, error_rate)
    return _built[key]
