"""Line dedup through sharded minimal perfect hashes (operator 6).

Distinct line hashes are counted once and dealt into shards. Each shard becomes one row: a
minimal perfect hash (levels of bits), a fingerprint array and a count array. Documents are
dealt into buckets; each bucket asks each line hash once, so a line that a third of all
documents hold costs one probe per bucket. Probes stream past their shard's arrays; only
frequent hashes return to the bucket, and the documents then drop their lines in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.textarrays import mix, slices
from cadastra.llm.work import staged

SHARD_KEYS, BUCKET_DOCS, BUCKET_BYTES = 2048, 512, 8 << 20
ARRAYS = ("mph", "prints", "counts", "firsts")
NO_ID = 2**63 - 1
_SPACE = b" \t\n\r\x0b\x0c"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def line_keys(text: str, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and the 16-byte hash of each line's key (None: the key is too short)."""
    lines = text.encode().split(b"\n")
    keys = [line.strip(_SPACE).translate(_LOWER) for line in lines]
    digest = xxhash.xxh3_128_digest
    if min_chars <= 1:
        return lines, [digest(k) if k or min_chars <= 0 else None for k in keys]
    return lines, [digest(k) if len(k.decode()) >= min_chars else None for k in keys]


def build_mph(keys: np.ndarray) -> bytes:
    """Minimal perfect hash of distinct uint64 keys: per level its size and bits; keys that share a
    slot go on to the next level, which is twice as roomy as its keys. Raises for keys that repeat,
    which would share every slot."""
    if len(np.unique(keys)) < len(keys):
        raise ValueError("keys of a minimal perfect hash must be distinct")
    out, level = [], 0
    while len(keys):
        size = 2 * len(keys) + 64
        slot = (mix(keys + _U(level)) % _U(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        out.append(np.array([size], "<i8").tobytes() + np.packbits(alone).tobytes())
        keys = keys[~alone[slot]]
        level += 1
    return b"".join(out)


class Mph:
    """Looks keys up in what build_mph made."""

    def __init__(self, data: bytes):
        self.levels, at, before = [], 0, 0
        while at < len(data):
            size = int(np.frombuffer(data, "<i8", 1, at)[0])
            bits = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at + 8))[:size]
            self.levels.append((size, bits.astype(bool), before + np.cumsum(bits) - bits))
            before += int(bits.sum())
            at += 8 + (size + 7) // 8

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key; -1 for some keys that were not built in (others get any position)."""
        found, left = np.full(len(keys), -1), np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            slot = (mix(keys[left] + _U(level)) % _U(size)).astype(np.int64)
            hit = bits[slot]
            found[left[hit]] = rank[slot[hit]]
            left = left[~hit]
            if not len(left):
                break
        return found


def shard_keys(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of 128-bit hashes."""
    return mix(h1 + _U(seed)) ^ h2


def _shard_row(table: pa.Table) -> pa.Table:
    h1 = table.column("h1").to_numpy().view(_U)
    h2 = table.column("h2").to_numpy().view(_U)
    seed = 0
    while len(np.unique(shard_keys(h1, h2, seed))) < len(h1):  # two of the 128-bit hashes in one 64-bit key
        seed += 1
    keys = shard_keys(h1, h2, seed)
    mph = np.array([seed], "<i8").tobytes() + build_mph(keys)
    at = Mph(mph[8:]).index(keys)
    prints, counts = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[at] = (h2 >> _U(32)).astype(np.uint32)
    counts[at] = np.minimum(table.column("n").to_numpy(), 2**32 - 1)
    firsts = np.zeros(len(keys), "<i8")
    firsts[at] = table.column("first").to_numpy()
    data = {"mph": mph, "prints": prints.tobytes(), "counts": counts.tobytes(), "firsts": firsts.tobytes()}
    return pa.table({"shard": table.column("shard")[:1]} | {k: pa.array([v]) for k, v in data.items()})


def line_frequencies(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(bucket, line, first): of the bucket's lines that at least ``min_docs`` rows hold, the 16-byte
    hash and the smallest id that holds it.

    ``docs`` has columns ``__bucket``, ``__id`` and ``text``.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                seen: dict[tuple[int, bytes], tuple[int, int]] = {}
                for b, d, t in zip(*(batch.column(c).to_pylist() for c in ("__bucket", "__id", text)), strict=True):
                    d = NO_ID if d is None else d
                    for h in set(line_keys(t or "", min_chars)[1]):
                        if h is not None:
                            n, first = seen.get((b, h), (0, d))
                            seen[b, h] = (n + 1, min(first, d))
                h = np.frombuffer(b"".join(k[1] for k in seen), ">i8").astype("<i8").reshape(-1, 2)
                values = np.array(list(seen.values()), np.int64).reshape(-1, 2)
                columns = [np.array([k[0] for k in seen], np.int64), h[:, 0], h[:, 1], values[:, 0], values[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["bucket", "h1", "h2", "n", "first"])

    lines = staged(docs.select("__bucket", "__id", F.col(f"`{text}`").alias(text)).mapInArrow(ask, "bucket long, h1 long, h2 long, n long, first long"), "lines")
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    counts = lines.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    arrays = counts.select(shard, "h1", "h2", "n", "first").groupBy("shard").applyInArrow(_shard_row, "shard long, " + ", ".join(f"{c} binary" for c in ARRAYS))
    asked = lines.select("bucket", "h1", "h2").distinct().select(shard, "bucket", "h1", "h2")
    none = F.lit(None)
    stream = arrays.select("shard", F.lit(0).alias("kind"), none.cast("long").alias("bucket"), none.cast("long").alias("h1"), none.cast("long").alias("h2"), *ARRAYS).unionByName(
        asked.select("shard", F.lit(1).alias("kind"), "bucket", "h1", "h2", *[none.cast("binary").alias(c) for c in ARRAYS])
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mph, seed, prints, counts_, firsts = None, None, 0, None, None, None
        for batch in batches:
            shard_, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            for lo in np.flatnonzero(np.append(True, (np.diff(shard_) != 0) | (np.diff(kind) != 0))) if batch.num_rows else []:
                rest = np.flatnonzero((shard_[lo:] != shard_[lo]) | (kind[lo:] != kind[lo]))
                part = batch.slice(lo, int(rest[0]) if len(rest) else batch.num_rows - lo)
                if kind[lo] == 0:
                    at = shard_[lo]
                    data = part.column("mph")[0].as_py()
                    seed, mph = int(np.frombuffer(data, "<i8", 1)[0]), Mph(data[8:])
                    prints = np.frombuffer(part.column("prints")[0].as_py(), "<u4")
                    counts_ = np.frombuffer(part.column("counts")[0].as_py(), "<u4")
                    firsts = np.frombuffer(part.column("firsts")[0].as_py(), "<i8")
                    continue
                assert at == shard_[lo]
                h1, h2 = part.column("h1").to_numpy().view(_U), part.column("h2").to_numpy().view(_U)
                where = mph.index(shard_keys(h1, h2, seed))
                hit = (where >= 0) & (prints[where] == (h2 >> _U(32)).astype(np.uint32)) & (counts_[where] >= min_docs)
                yield part.select(["bucket", "h1", "h2"]).append_column("first", pa.array(firsts[where])).filter(pa.array(hit))

    found = stream.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(probe, "bucket long, h1 long, h2 long, first long")
    return found.select("bucket", F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in ("h1", "h2")]).alias("line"), "first")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, digest: bool = False) -> DataFrame:
    """All columns of ``docs`` plus n_lines long, n_dropped long and kept_text string
    (with ``digest`` kept_sha256 instead of the text).

    A line's key is the line without white space at its ends, A-Z lower-cased. All lines whose key
    has at least ``min_chars`` code points and occurs in at least ``min_docs`` rows are dropped, in
    every row (with ``keep_first`` in every row but those with the smallest id that holds it); the others
    stay, joined by a line feed. Each row counts as one document, repeated
    rows and ids too. Null or empty text is one empty line and gives an empty text. Clashing
    column names of ``docs`` are replaced; an empty table gives an empty table.
    """
    given = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_dropped", "kept_sha256" if digest else "kept_text")]
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    buckets = max(1, -(-size[0] // BUCKET_DOCS), -(-(size[1] or 0) // BUCKET_BYTES))
    dealt = docs.select(*[docs[f"`{f.name}`"] for f in given], F.pmod(F.xxhash64(doc_id, F.length(text)), F.lit(buckets)).alias("__bucket"), F.col(doc_id).cast("long").alias("__id"))
    frequent = line_frequencies(dealt, text, min_docs, min_chars)
    result = "kept_sha256" if digest else "kept_text"
    names = [f.name for f in given]

    def drop_lines(rows: pa.Table, found: pa.Table) -> pa.Table:
        """The documents of a bucket without the frequent lines that the bucket's probes found."""
        drop = dict(zip(found.column("line").to_pylist(), found.column("first").to_pylist(), strict=True))
        out = []
        for whole in rows.to_batches():
            for batch in slices(whole, text):
                n_lines, n_dropped, kept = [], [], []
                for d, t in zip(batch.column("__id").to_pylist(), batch.column(text).to_pylist(), strict=True):
                    lines, keys = line_keys(t or "", min_chars)
                    own = d if keep_first else None
                    left = [line for line, k in zip(lines, keys, strict=True) if k not in drop or (own is not None and drop[k] == own)]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(left))
                    body = b"\n".join(left)
                    kept.append(hashlib.sha256(body).hexdigest() if digest else body.decode())
                made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
                out.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "n_lines", "n_dropped", result]))
        return pa.Table.from_batches(out)

    types = {"n_lines": "long", "n_dropped": "long", result: "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given] + [f"`{c}` {t}" for c, t in types.items()])
    return dealt.groupBy("__bucket").cogroup(frequent.groupBy("bucket")).applyInArrow(drop_lines, schema)
