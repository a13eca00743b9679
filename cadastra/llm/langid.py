"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.rows import with_columns_by_slice
from cadastra.llm.textarrays import slices, utf8

BITS, DIM, ORDERS = 14, 16, (1, 2, 3, 4)
SIZE = 1 << BITS
#: Range of the hashes that pick texts, far above any number of texts.
RANGE = 1 << 53
_LETTERS = np.arange(256, dtype=np.uint32)
_LETTERS[: 0x80] = 0x20
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def subword_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket at each byte (SIZE where the n-gram leaves its text), and text offsets.

    N-grams run over the bytes of the lower-cased text; ASCII bytes other than letters count as a space.
    """
    raw, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    code = chars = _LETTERS[raw]
    for n, multiplier in zip(ORDERS, _MULTIPLIERS, strict=True):
        if n > 1:
            code = (code << np.uint32(8)) | np.concatenate([chars[n - 1 :], np.zeros(min(n - 1, len(chars)), np.uint32)])
        bucket = ((code * multiplier) >> np.uint32(32 - BITS)).astype(np.int32)
        for back in range(1, n):
            at = offsets[1:] - back
            bucket[at[at >= offsets[:-1]]] = SIZE
        yield bucket, offsets


def averaged(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over all n-grams of each text; zeros for an empty text. table: SIZE rows."""
    columns = [np.append(table[:, c], np.float32(0)) for c in range(table.shape[1])]
    total = np.zeros((len(texts), len(columns)))
    count = np.zeros(len(texts))
    for n, (bucket, offsets) in zip(ORDERS, subword_buckets(texts), strict=True):
        length = np.diff(offsets)
        full = np.flatnonzero(length)
        if not len(full):
            continue
        count += np.maximum(length - n + 1, 0)
        for c, column in enumerate(columns):
            total[full, c] += np.add.reduceat(column[bucket], offsets[full], dtype=np.float64)
    return total / np.maximum(count, 1)[:, None]


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            per_doc = [np.zeros(SIZE + 1, np.int64) for _ in range(batch.num_rows)]
            for bucket, offsets in subword_buckets(batch.column("text")):
                for d, counts in enumerate(per_doc):
                    counts += np.bincount(bucket[offsets[d] : offsets[d + 1]], minlength=SIZE + 1)
            where = [np.flatnonzero(c[:SIZE]).astype(np.int32) for c in per_doc]
            weight = [(c[w] / max(c[:SIZE].sum(), 1)).astype(np.float32) for c, w in zip(per_doc, where, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("pick"), pa.array(where, pa.list_(pa.int32())), pa.array(weight, pa.list_(pa.float32()))],
                names=["lang", "pick", "buckets", "weights"],
            )


def _split_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as slices of one array."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def picked_below(share: float, n: int) -> int:
    """Hashes below this are picked, of RANGE hashes: ``share`` of ``n`` texts, and never nothing."""
    return max(1, int(RANGE * min(1.0, share / n)))


def train_language_id(labelled: DataFrame, sample_docs: int = 3000, epochs: int = 8, seed: int = 7) -> dict | None:
    """Fit on a bounded sample of (text, lang), ``sample_docs`` whole texts over all languages.

    Each language gives an equal share, picked by a hash of the text, copies of a text once; every
    fifth picked text is left out of the fit and sets the softmax temperature and the rejection threshold (the lowest
    score from which 99 % of the left-out texts are right). Rows with null text or lang are not
    used; None if no row remains.
    """
    usable = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = sample_docs / len(sizes)
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.col("h"), F.lit(RANGE)) < picked_below(share, n)))
    once = usable.where(keep).groupBy("lang", "h").agg(F.first("text").alias("text"))
    picked = once.select("text", "lang", F.pmod(F.shiftright("h", 24), F.lit(5)).alias("pick"))
    rows = picked.mapInArrow(_sparse_rows, "lang string, pick long, buckets array<int>, weights array<float>").toArrow()
    langs = sorted(sizes)
    y = np.array([langs.index(v) for v in rows.column("lang").to_pylist()], np.int64)
    pick = rows.column("pick").to_numpy()
    where, weight = _split_lists(rows.column("buckets")), _split_lists(rows.column("weights"))
    rng = np.random.default_rng(seed)
    order = np.lexsort((pick, y))  # what the fit sees does not depend on the order of partitions
    embed = rng.normal(0, 0.1, (SIZE, DIM)).astype(np.float32)
    linear, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    train = order[pick[order] != 0]
    held = order[pick[order] == 0]

    def dense(rows_: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows_), SIZE), np.float32)
        for i, r in enumerate(rows_):
            x[i, where[r]] = weight[r]
        return x

    for epoch in range(epochs):
        rate = 40.0 * (1 - epoch / epochs)
        shuffled = rng.permutation(train)
        for at in range(0, len(shuffled), 32):
            part = shuffled[at : at + 32]
            x = dense(part)
            hidden = x @ embed
            p = _softmax(hidden @ linear + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            grad = x.T @ (p @ linear.T)
            linear -= 0.05 * rate * hidden.T @ p
            bias -= 0.01 * rate * p.sum(0)
            embed -= rate * grad
    model = {"langs": langs, "embed": embed, "linear": linear, "bias": bias, "temperature": 1.0, "threshold": 0.0}
    if len(held) and len(langs) > 1:
        logits = np.concatenate([dense(held[i : i + 64]) @ embed for i in range(0, len(held), 64)]) @ linear + bias
        grid = np.exp(np.linspace(-3, 3, 61))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        model["temperature"] = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / model["temperature"])
        score, right = p.max(1), p.argmax(1) == y[held]
        down = np.argsort(-score, kind="stable")
        good = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
        model["threshold"] = float(score[down[np.flatnonzero(good >= 0.99).max()]]) if (good >= 0.99).any() else 1.0
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def language_id(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred string, score double and lang_rejected boolean.

    lang_pred is a learned value, or ``und`` with score 0 where the text is null or has no letter
    (or nothing was learned). score is the calibrated probability; lang_rejected says that it lies
    under the model's threshold. Whole texts are used; ties go to the first language by name;
    columns of ``docs`` that clash with the new names are replaced. Empty tables stay empty.
    """
    has = F.coalesce(docs[f"`{text}`"].rlike(r"\p{L}"), F.lit(False))
    marked = docs.withColumn("__has_letter", has)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x DIM floats at most

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        m = shared.value
        letter = batch.column("__has_letter").to_numpy(zero_copy_only=False)
        if m is None:
            n = batch.num_rows
            return {"lang_pred": ["und"] * n, "score": np.zeros(n), "lang_rejected": np.ones(n, bool)}
        direct = len(m["langs"]) <= DIM
        mean = averaged(batch.column(text), (m["embed"] @ m["linear"]) if direct else m["embed"])
        p = _softmax(((mean if direct else mean @ m["linear"]) + m["bias"]) / m["temperature"])
        best = p.argmax(1)
        score = np.where(letter, p.max(1), 0.0)
        return {"lang_pred": [m["langs"][b] if ok else "und" for b, ok in zip(best, letter, strict=True)], "score": score, "lang_rejected": ~letter | (score < m["threshold"])}

    return with_columns_by_slice(marked, {"lang_pred": "string", "score": "double", "lang_rejected": "boolean"}, make, text, drop=("__has_letter",))


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
