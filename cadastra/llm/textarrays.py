"""Words and word n-grams of Arrow text batches as numpy arrays over the UTF-8 bytes.

Everything is computed for a slice of documents at once, so that no step runs once per word
in Python. Hashes are polynomials modulo 2**64 with a mixed byte table and a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once: the arrays for a slice take some forty times as much.
SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_GRAM2 = 0xA0761D6478BD642F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise on uint64."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12, 2 * len(have) if have is not None else 0)
        factors = np.full(size, base, _U)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = mix(np.arange(256, dtype=_U))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and len(texts) + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text each (a longer text is a part of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()  # else a worker keeps its largest batches' memory


class Words:
    """Words (runs of bytes other than space and \\t-\\r) of a slice of documents.

    raw, offsets: the bytes; starts, ends: byte range of each word; first: index of each
    document's first word, with one more entry at the end; hashes: uint64 per word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.raw, self.offsets = utf8(texts)
        n = len(self.raw)
        solid = ~_SPACE[self.raw]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | cut[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        lengths = self.ends - self.starts
        if len(lengths):
            chars = self.raw[solid]
            at = np.cumsum(lengths) - lengths
            pos = np.arange(len(chars)) - np.repeat(at, lengths)
            terms = (_LOWER if lower else _BYTES)[chars] * powers(_BASE, int(lengths.max()))[pos]
            self.hashes = mix(np.add.reduceat(terms, at) + lengths.astype(_U))
        else:
            self.hashes = np.zeros(0, _U)
        self._sums: dict[int, np.ndarray] = {}

    def grams(self, begin: np.ndarray, end: np.ndarray, seed: int = 0, second: bool = False) -> np.ndarray:
        """Hash of the word sequence [begin, end) for each pair of word indexes; ``second`` takes an independent one."""
        base = _GRAM2 if second else _GRAM
        if base not in self._sums:
            terms = (mix(self.hashes) if second else self.hashes) * powers(base, len(self.hashes))
            self._sums[base] = np.concatenate([np.zeros(1, _U), np.cumsum(terms)])
        sums, inv = self._sums[base], powers(pow(base, -1, 1 << 64), len(self.hashes) + 1)
        return mix((sums[end] - sums[begin]) * inv[begin] + (end - begin).astype(_U) * _U(0x2545F4914F6CDD1D) + _U(seed))

    def gram_starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word of every k-gram that lies in one document, and how many each document has."""
        per = np.maximum(self.counts - k + 1, 0)
        return spans(self.first[:-1], per), per


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each range in turn."""
    at = np.cumsum(length) - length
    return np.arange(int(length.sum())) - np.repeat(at, length) + np.repeat(begin, length)


_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x80:] = np.arange(0x80, 256)
for _chars in (b"abcdefghijklmnopqrstuvwxyz", b"0123456789"):
    _PLAIN[list(_chars)] = list(_chars)


def plain_words(texts: pa.Array) -> Words:
    """Words of lower-cased texts; every ASCII character but letters and digits parts words."""
    raw, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    data = pa.py_buffer(_PLAIN[raw].tobytes())
    return Words(pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i8").tobytes()), data]))
