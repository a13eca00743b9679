"""BPE encoding and decoding with a published byte-level vocabulary (operator 9).

Merging works on a pair occurrence index: all distinct pre-tokens of a batch lie in one symbol
array with links to neighbours; each adjacent pair maps to all its positions, and active ranks
are taken in ascending order from a heap. Merging a pair at a position updates the lists of the
pairs to its left and right only. Pre-tokens already seen by the worker come from a bounded
cache, so text is never encoded word by word twice.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the format: the published pre-token pattern of the byte-level tokenizer, with
#: white space, letters and numbers filled in.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers below U+0250, for texts that have no character above: the standard library's
#: matcher is twice as fast as one that knows Unicode properties.
LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "S": SPACES}
#: Pre-tokens whose ids a worker remembers (some 30 MB); a full memory is emptied.
CACHE_ENTRIES = 120_000
NO_RANK = 1 << 40
_BEYOND_LATIN = re.compile("[^\\x00-\u024f]")


def byte_symbols() -> dict[int, str]:
    """The printable symbol that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    table.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)})
    return table


def _filled(classes: dict[str, str]) -> str:
    pattern = PATTERN
    for name, chars in classes.items():
        pattern = pattern.replace("{" + name + "}", chars)
    return pattern


class Vocabulary:
    """Merges, ids and token bytes of a tokenizers JSON file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, ids = spec["model"], dict(spec["model"]["vocab"])
        back = {s: b for b, s in byte_symbols().items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = np.zeros(256, np.int64)
        for b, s in byte_symbols().items():
            self.byte_id[b] = ids[s]
        self.merges: dict[int, int] = {}  # left id << 32 | right id: rank
        self.pair_of_rank: list[tuple[int, int, int]] = []
        self.byte_rank = np.full((256, 256), NO_RANK)
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left] << 32 | ids[right]] = rank
            self.pair_of_rank.append((ids[left], ids[right], ids[left + right]))
            if len(left) == len(right) == 1:
                self.byte_rank[back[left], back[right]] = rank
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in ids.items()}
        self.token_bytes.update({i: s.encode() for s, i in self.added.items()})
        self.find_latin = re.compile(_filled(LATIN)).findall
        self.find_any = regex.compile(_filled({"L": r"\p{L}", "N": r"\p{N}", "S": SPACES})).findall
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None


def merge_pretokens(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Packed token ids of each pre-token (none is empty), by the pair occurrence index over all of them."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    nexts, befores = np.arange(1, n + 1), np.arange(-1, n - 1)
    nexts[begins + lengths - 1] = -1
    befores[begins] = -1
    ranks = np.full(n, NO_RANK)
    ranks[:-1] = vocab.byte_rank[raw[:-1], raw[1:]]
    ranks[nexts < 0] = NO_RANK
    paired = np.flatnonzero(ranks < NO_RANK)
    paired = paired[np.argsort(ranks[paired], kind="stable")]
    active, at = np.unique(ranks[paired], return_index=True)
    where = dict(zip(active.tolist(), map(np.ndarray.tolist, np.split(paired, at[1:])), strict=True)) if len(active) else {}
    heap = active.tolist()
    ids, right, left = vocab.byte_id[raw].tolist(), nexts.tolist(), befores.tolist()
    merges, pairs = vocab.merges, vocab.pair_of_rank
    while heap:
        rank = heapq.heappop(heap)
        a, b, new = pairs[rank]
        positions = where.pop(rank)
        if a == b:
            positions.sort()  # of overlapping pairs the leftmost merges first
        for i in positions:
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
                m = merges.get(new << 32 | ids[after])
                if m is not None:
                    if m in where:
                        where[m].append(i)
                    else:
                        where[m] = [i]
                        heapq.heappush(heap, m)
            before = left[i]
            if before >= 0:
                m = merges.get(ids[before] << 32 | new)
                if m is not None:
                    if m in where:
                        where[m].append(before)
                    else:
                        where[m] = [before]
                        heapq.heappush(heap, m)
    kept = np.array(ids)
    tokens = np.add.reduceat(kept >= 0, begins)
    flat = kept[kept >= 0].astype("<u4").tobytes()
    ends = (4 * np.cumsum(tokens)).tolist()
    return [flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes and decodes texts; keeps the ids of seen pre-tokens as packed little-endian words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.cache = vocab, {}
        size = max(vocab.token_bytes) + 1
        self.table = [vocab.token_bytes.get(i, b"") for i in range(size)]

    def pretokens(self, text: str) -> list[str]:
        find = self.vocab.find_any if _BEYOND_LATIN.search(text) else self.vocab.find_latin
        if self.vocab.split_added is None or not self.vocab.split_added.search(text):
            return find(text)
        out, at = [], 0
        for m in self.vocab.split_added.finditer(text):
            out += find(text[at : m.start()])
            out.append(("added", m.group()))
            at = m.end()
        return out + find(text[at:])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cut = [self.pretokens(t) for t in texts]
        new = [w for w in set().union(*cut) if w not in self.cache]
        plain = [w for w in new if isinstance(w, str)]
        for w, row in zip(plain, merge_pretokens([w.encode() for w in plain], self.vocab), strict=True):
            self.cache[w] = row
        for w in new:
            if not isinstance(w, str):
                self.cache[w] = np.array([self.vocab.added[w[1]]], "<u4").tobytes()
        get = self.cache.__getitem__
        return [b"".join(map(get, row)) for row in cut]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def encoder_for(tokenizer_json: str) -> Encoder:
    """One encoder per worker process and vocabulary; later tasks of the worker reuse its cache."""
    return Encoder(Vocabulary(tokenizer_json))


def bpe_encode_decode(docs: DataFrame, tokenizer_json: str, text: str = "text", keep_ids: bool = True, keep_decoded: bool = True) -> DataFrame:
    """All columns of ``docs`` (without those that clash with the new ones) plus n_tokens long,
    ids array<int>, ids_sha256, decoded string and decoded_sha256.

    ``tokenizer_json`` is the content of the vocabulary file; it has a fixed size and goes to the
    tasks with the function. Null text counts as empty: no ids, decoded is empty. Long texts are
    encoded whole; repeated rows give repeated results; an empty table gives an empty table.
    ``keep_ids`` / ``keep_decoded`` False leave out the long columns.
    """
    new = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
    if not keep_ids:
        new.pop("ids")
    if not keep_decoded:
        new.pop("decoded")
    spark_types = {"n_tokens": "long", "ids": "array<int>"}
    kept = [c for c in docs.columns if c.lower() not in new]
    source = docs.select(*[docs[f"`{c}`"] for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"{c} {spark_types.get(c, 'string')}" for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cadastra.llm.textarrays import slices

        encoder = encoder_for(tokenizer_json)
        for whole in batches:
            for batch in slices(whole, text):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                packed = encoder.encode_all(texts)
                decoded = [encoder.decode(p) for p in packed]
                made = {
                    "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                    "ids": pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())) if keep_ids else None,
                    "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    "decoded": pa.array(decoded, pa.string()) if keep_decoded else None,
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                }
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [made[c] for c in new], names=[*kept, *new])

    return source.mapInArrow(run, schema)
