"""Spelling variants by a bit-sliced position index (operator 12).

A block of the vocabulary is held as bitsets: for each (position, letter) the set of words with that
letter there. A word runs over its letters once; shifted positions give, for all words of the block at
once, the set that agrees so far (no error) and those that have used up one error: a replaced letter,
a letter more, a letter less. A batch of words of one length runs together, as a matrix of bitsets.

Two words at one edit share their first or their last half, halves of the shorter word. So words are
dealt by (length of the shorter, half): a block holds whole keys, and a pair found by both halves
counts for the first. A key of many words is dealt into even parts, compared part by part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.work import staged, unstage

#: The letters of a run, and those that lose their case.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Different words that a task counts before it gives them on.
HELD = 200_000
#: Words of a block, and words that run over it together.
BLOCK, BATCH = 4096, 256
#: Rows of a bin, and letters of a key beyond which it is dealt into parts of as many.
BIN, PART_LETTERS = 16_384, 1 << 16


def lowered(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def spoilt(doc_id: int | None, word: str, every: int) -> str:
    """``word`` without one code point where ``every`` divides the CRC-32 of ``<doc_id>:<word>``; 0 or a null id spoils nothing."""
    if every and doc_id is not None and word:
        h = zlib.crc32(f"{doc_id}:{word}".encode())
        if h % every == 0:
            return word[: h % len(word)] + word[h % len(word) + 1 :]
    return word


def _counts(every: int, min_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def given(counts: Counter) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                runs = Counter(RUN.findall(t)) if len(t := text.as_py() or "") < 1 << 20 else Counter(m.group() for m in RUN.finditer(t))
                for raw, n in runs.items():
                    word = spoilt(doc_id, lowered(raw), every)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) > HELD:
                    yield given(counts)
        if counts:
            yield given(counts)

    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, spoil: int = 0) -> DataFrame:
    """(word string, n long): the letter runs of all whole texts, A-Z in lower case, with at least ``min_length``
    code points and ``min_count`` occurrences. A null or empty text has none. With ``spoil`` every so manyth
    (document, run) loses one code point before it counts (see spoilt), as a test of the grouping."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    counts = rows.mapInArrow(_counts(spoil, min_length), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _set(bits: np.ndarray, row: np.ndarray, bit: np.ndarray) -> None:
    np.bitwise_or.at(bits.view(np.uint8).reshape(len(bits), -1), (row, bit >> 3), (1 << (bit & 7)).astype(np.uint8))


class PositionIndex:
    """The words of a block, most frequent first, as bitsets: bit w of a set is word w.

    ``keys`` tell which words may meet; ``sides`` (0 or 1), where given, let only words of unlike sides meet.
    """

    def __init__(self, words: list[str], keys: np.ndarray, sides: np.ndarray | None) -> None:
        self.length = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        wide = (len(words) + 63) // 64
        letters, letter = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), return_inverse=True)
        of = np.repeat(np.arange(len(words)), self.length)
        position = np.arange(len(of)) - self.begin[of]
        code = position * len(letters) + letter
        held, same = np.unique(code, return_inverse=True)
        self.sets = np.zeros((len(held) + 1, wide), np.uint64)  # the last set is empty
        _set(self.sets, same, of)

        def shifted(by: int) -> np.ndarray:
            wanted = code + by * len(letters)
            at = np.minimum(np.searchsorted(held, wanted), max(len(held) - 1, 0))
            return np.where((held[at] == wanted) & (position + by >= 0), at, len(held)) if len(held) else wanted

        self.here, self.after, self.before = same, shifted(1), shifted(-1)
        self.keys = np.unique(keys, return_inverse=True)[1]
        self.of_key = np.zeros((self.keys.max() + 1, wide), np.uint64)
        _set(self.of_key, self.keys, np.arange(len(words)))
        lengths, self.length_row = np.unique(self.length, return_inverse=True)
        self.lengths = lengths.tolist()
        self.of_length = np.zeros((len(lengths) + 1, wide), np.uint64)
        _set(self.of_length, self.length_row, np.arange(len(words)))
        self.sides, self.of_side = sides, np.zeros((2, wide), np.uint64)
        if sides is not None:
            _set(self.of_side, sides, np.arange(len(words)))

    def _long(self, length: int) -> np.ndarray:
        return self.of_length[self.lengths.index(length) if length in self.lengths else -1]

    def near(self, rows: np.ndarray, short: int, suffix: bool) -> tuple[np.ndarray, np.ndarray]:
        """For words ``rows`` of one length: how many words of their key are at one edit, and the first of them.

        ``short`` is the length of the shorter word of a pair. With ``suffix``, words that also share the
        first half are left out: they met under it.
        """
        m = int(self.length[rows[0]])
        at = self.begin[rows][:, None] + np.arange(m)
        none = self.of_key[self.keys[rows]]
        if self.sides is not None:
            none = none & self.of_side[1 - self.sides[rows]]
        replaced, more, less, both = np.zeros_like(none), np.zeros_like(none), np.zeros_like(none), none
        for i in range(m):
            here = self.sets[self.here[at[:, i]]]
            if m == short:
                more = (more | none) & self.sets[self.after[at[:, i]]]
                replaced = (replaced & here) | (none & ~here)
            else:
                less = (less & self.sets[self.before[at[:, i]]]) | none
            none = none & here
            if i + 1 == short // 2:
                both = none
        found = (replaced & self._long(m)) | ((more | none) & self._long(m + 1)) if m == short else less & self._long(m - 1)
        if suffix:
            found = found & ~both
        count = np.bitwise_count(found).sum(1).astype(np.int64)
        word = (found != 0).argmax(1)
        first = found[np.arange(len(rows)), word]
        return count, word * 64 + np.bitwise_count((first & (~first + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def _blocks(short: np.ndarray, key: np.ndarray) -> Iterator[slice]:
    """Runs of whole keys of BLOCK rows and as many positions as BLOCK words of 64 letters, at least one key each."""
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    begin = last = 0
    for end in ends.tolist():
        if last > begin and (end - begin > BLOCK or (end - begin) * int(short[end - 1]) > BLOCK * 64):
            yield slice(begin, last)
            begin = last
        last = end
    if last > begin:
        yield slice(begin, last)


def _compare(table: pa.Table) -> pa.Table:
    """Of a bin, or of two parts of a key: per word the number of near words, and the most frequent one."""
    table = table.sort_by([("short", "ascending"), ("suffix", "ascending"), ("piece", "ascending")])
    short, suffix, n, side = (table.column(c).to_numpy(zero_copy_only=False) for c in ("short", "suffix", "n", "side"))
    words, pieces = table.column("word").to_pylist(), table.column("piece").to_pylist()
    fresh = [k == 0 or short[k] != short[k - 1] or suffix[k] != suffix[k - 1] or pieces[k] != pieces[k - 1] for k in range(len(words))]
    key = np.cumsum(fresh) - 1
    split = bool(table.column("low")[0].as_py() != table.column("high")[0].as_py()) if len(words) else False
    out: list[tuple[str, int, int, str]] = []
    for block in _blocks(short, key):
        order = sorted(range(block.start, block.stop), key=lambda k: (-n[k], words[k]))
        if len(order) < 2:
            continue
        at = np.array(order)
        index = PositionIndex([words[k] for k in order], key[at], side[at].astype(np.int64) if split else None)
        kinds = np.stack([index.length, short[at], suffix[at]])
        groups, kind = np.unique(kinds, axis=1, return_inverse=True)
        by_kind = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[by_kind], np.arange(groups.shape[1] + 1))
        for g, (length, low, last) in enumerate(groups.T.tolist()):
            if length not in (low, low + 1):
                continue
            members = by_kind[bounds[g] : bounds[g + 1]]
            for k in range(0, len(members), BATCH):
                rows = members[k : k + BATCH]
                count, first = index.near(rows, low, bool(last))
                for r in np.flatnonzero(count).tolist():
                    best = order[first[r]]
                    out.append((words[order[rows[r]]], int(count[r]), int(n[best]), words[best]))
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, bin_rows: int = BIN, part_letters: int = PART_LETTERS) -> DataFrame:
    """(word, n_near long, best_n long, best string) of the words of ``words`` (word, n; distinct) that have a near word."""
    size = F.length("word")
    keys = F.array(*[F.struct((size - less).alias("short"), F.lit(suffix).alias("suffix")) for less in (0, 1) for suffix in (False, True)])
    rows = words.select("word", "n", F.explode(F.filter(keys, lambda k: k["short"] >= 0)).alias("key")).select("word", "n", "key.*")
    half = F.shiftright("short", 1)
    rows = rows.withColumn("piece", F.when(F.col("suffix"), F.right(F.col("word"), half)).otherwise(F.left(F.col("word"), half)))
    key = ["short", "suffix", "piece"]
    hot = rows.groupBy(*key).agg(F.sum(F.length("word") + 1).alias("letters")).where(F.col("letters") > part_letters)
    hot = staged(hot.select(*key, F.ceil(F.col("letters") / part_letters).alias("parts")), "spelling-hot")
    bins = max(1, -(-4 * words.count() // bin_rows))
    at = F.xxhash64(*key)
    part = F.pmod(F.xxhash64("word"), F.col("parts"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least(o, part).alias("low"), F.greatest(o, part).alias("high")))
    alone = F.array(F.struct(F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high")))
    placed = (
        rows.join(hot, key, "left")
        .withColumn("bin", F.when(F.col("parts").isNull(), F.pmod(at, F.lit(bins))).otherwise(at))
        .withColumn("tile", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(others)))
        .select("bin", "tile.low", "tile.high", *key, "word", "n", F.when(F.col("parts").isNull() | (part == F.col("tile.low")), 0).otherwise(1).alias("side"))
    )
    found = placed.groupBy("bin", "low", "high").applyInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best", "best_n")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.best_n", "b.best")


def spelling_groups(words: DataFrame, factor: int = 10, bin_rows: int = BIN, part_letters: int = PART_LETTERS) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long), one row per word of ``words`` (word string, n long).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. n_near counts
    a word's near words. Its form is the near word of largest n (ties: the smallest in code-point order) if
    that n is at least ``factor`` (2 or more) times its own, else null; root follows forms to the last one and is the word
    itself where there is none.

    Rows that repeat a word add up their n; null words and words without an n are left out; an empty
    word is a word; other columns are ignored; an empty table gives an empty table. Words may be of any length.
    Pairs are never written: a task gives back a count and one best word for each word and key. Forms have
    at least ``factor`` times the n of their word, so that roots take few rounds of pointer doubling.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its word")
    own = staged(words.where("word is not null and n is not null").groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n")), "spelling-words")
    near = near_words(own, bin_rows, part_letters)
    known = own.join(near, "word", "left").withColumn("form", F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")))
    known = staged(known.select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = staged(known.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = staged(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        unstage(roots)
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
