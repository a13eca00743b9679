"""Substring dedup by a compacted de Bruijn graph of token k-mers (operator 2).

Nodes are word k-mers picked as window minima, so every window of ``window`` words holds one and
two occurrences of a window hold the same one. Edges are the longer k-mers from one picked k-mer
to the next in a document (or to its end). A node whose occurrences all lie on the same two edges
does not branch: whatever holds it holds the whole path through it. Joins bring to each shared
occurrence what its node knows, with the coordinates (document, word) of the node's first source;
runs of nonbranching occurrences with one source and one distance to it compact to paths. A path
counts if a second hash over its edges equals the one found at its source's coordinates. Windows
on such paths are settled by that; windows that hold a branching node are compared one by one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.textarrays import Words, mix, slices
from cadastra.llm.work import staged, unstage

K = 12
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


class Anchors:
    """The picked k-mers of a slice of documents.

    at: start word of each; doc: its document; node, context: hashes of the k-mer and of its two
    edges; check: another hash of both edges; place: start word within the document and that of
    the next anchor (0: none), in 32 bits each; windows: start word of every window; least: index
    of each window's own anchor.
    """

    def __init__(self, words: Words, window: int):
        k = min(K, window)
        starts, _ = words.gram_starts(k)
        self.windows, _ = words.gram_starts(window)
        if not len(self.windows):
            self.at = self.doc = self.least = self.place = np.zeros(0, np.int64)
            self.node = self.context = self.check = np.zeros(0, _U)
            return
        node = words.grams(starts, starts + k)
        low = np.full(len(words.hashes), _NONE)
        # The hash decides, and the first of equal ones: a rule that only looks at the window's words.
        low[starts] = (node & _U(0xFFFFFFFF00000000)) | starts.astype(_U)
        span, size = window - k + 1, 1
        while size * 2 <= span:
            low[: len(low) - size] = np.minimum(low[: len(low) - size], low[size:])
            size *= 2
        least = np.minimum(low[self.windows], low[self.windows + span - size]) & _U(0xFFFFFFFF)
        self.at = np.unique(least).astype(np.int64)
        self.least = np.searchsorted(self.at, least.astype(np.int64))
        self.doc = np.searchsorted(words.first, self.at, "right") - 1
        self.node = words.grams(self.at, self.at + k)
        head = np.append(True, self.doc[1:] != self.doc[:-1])
        tail = np.append(head[1:], True)
        before = np.where(head, words.first[self.doc], np.append(0, self.at[:-1]))
        after = np.where(tail, words.first[self.doc + 1], np.append(self.at[1:] + k, 0))
        edge_in = words.grams(before, self.at) + head.astype(_U)
        edge_out = words.grams(self.at + k, after) + tail.astype(_U)
        self.context = mix(edge_in * _U(0x9E3779B97F4A7C15) ^ mix(edge_out))
        self.check = words.grams(before, after, second=True)
        start = self.at - words.first[self.doc]
        self.place = start << 32 | np.where(tail, 0, np.append(start[1:], 0))
        self.inner = window - k  # an anchor from p to p + inner lies in the window at p


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                a = Anchors(Words(batch.column("text")), window)
                doc, row = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (a.node.view(np.int64), a.context.view(np.int64), a.check.view(np.int64), a.place, doc[a.doc], row[a.doc])],
                    names=["node", "context", "check", "place", "doc_id", "row"],
                )

    return run


#: What a run of anchors is: a path with a source before it, the source of a path itself, or branching nodes.
COPY, SOURCE, BRANCH = 1, 2, 3


def compacted_paths(occurrences: DataFrame) -> DataFrame:
    """(doc_id, row, runs array<struct<begin int, last int, kind int>>) of occurrences whose node more than one document holds.

    ``occurrences`` has node, context, check, place, doc_id and row. A run is a path or a row of
    branching nodes; begin and last are the start words of its first and last anchor.
    """
    shared = occurrences.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("node")
    held = staged(occurrences.join(shared, "node", "left_semi"), "shared-occurrences")
    # The source comes with the hash that was found at its coordinates.
    facts = held.groupBy("node").agg(F.min(F.struct("doc_id", "place", "check")).alias("source"), (F.min("context") == F.max("context")).alias("through"))
    known = held.join(facts.where("through").select("node", "source"), "node", "left").select(
        "doc_id", "row", "check", F.shiftright("place", 32).alias("at"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("next"), F.col("source.doc_id").alias("source_id"), F.col("source.place").alias("source_place"), F.col("source.check").alias("source_check")
    )
    same = F.coalesce(F.col("check") == F.col("source_check"), F.lit(False))
    kind = F.when(~same, BRANCH).when(F.col("source_id") < F.col("doc_id"), COPY).otherwise(SOURCE)
    path = F.when(kind != BRANCH, F.struct("source_id", (F.col("at") - F.shiftright("source_place", 32)).alias("apart")))
    verified = known.select("doc_id", "row", "at", "next", kind.alias("kind"), path.alias("path"))
    order = Window.partitionBy("doc_id", "row").orderBy("at")
    goes_on = (F.lag("next").over(order) == F.col("at")) & (F.lag("kind").over(order) == F.col("kind")) & F.lag("path").over(order).eqNullSafe(F.col("path"))
    begun = verified.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("new").over(order)).groupBy("doc_id", "row", "run").agg(F.min("at").cast("int").alias("begin"), F.max("at").cast("int").alias("last"), F.first("kind").alias("kind"))
    paths = staged(runs.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("begin", "last", "kind"))).alias("runs")), "paths")
    unstage(held)
    return paths


def kept_text(text: bytes, window_starts: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the rest joined by one space."""
    words = text.split()
    if not len(window_starts):
        return len(words), 0, b" ".join(words)
    change = np.bincount(window_starts, minlength=len(words) + 1) - np.bincount(window_starts + window, minlength=len(words) + 1)
    keep = np.cumsum(change)[: len(words)] == 0
    return len(words), int(len(words) - keep.sum()), b" ".join(itertools.compress(words, keep.tolist()))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, digest: bool = False) -> DataFrame:
    """The columns of ``docs`` without ``text``, plus n_words long, n_removed long and kept_text
    (with ``digest`` kept_sha256).

    Words are runs of characters other than space and \\t to \\r. A word is removed if it lies in
    ``window`` consecutive words of its document whose sequence also starts in a document with a
    smaller id. Windows are judged on the input. Null and empty texts have no words. Rows with a
    null id are kept whole and are no source; rows with equal ids are no source for each other.
    Documents under ``window`` words stay whole. Clashing columns are replaced; an empty table
    gives an empty table.
    """
    result = "kept_sha256" if digest else "kept_text"
    others = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", result) and c != text]
    keyed = docs.select(*[F.col(f"`{c}`") for c in others], F.col(doc_id).cast("long").alias("__id"), F.coalesce(text, F.lit("")).alias("__text"))
    keyed = keyed.withColumn("__row", F.xxhash64("__id", "__text"))

    source = keyed.where("__id is not null").select(F.col("__text").alias("text"), F.col("__id").alias("doc_id"), F.col("__row").alias("row"))
    occurrences = staged(source.mapInArrow(_occurrences(window), "node long, context long, check long, place long, doc_id long, row long"), "occurrences")
    paths = compacted_paths(occurrences)
    unstage(occurrences)
    met = keyed.join(paths.toDF("__id", "__row", "__runs"), ["__id", "__row"], "left")

    carried = [f for f in keyed.schema.fields if f.name != "__text"]
    found = ("__out", "__text", "__settled", "__at", "__h1", "__h2")
    made = "n_words long, n_removed long, __out string, __text string, __settled array<int>, __at array<int>, __h1 array<long>, __h2 array<long>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried]) + ", " + made

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                yield _settle(batch)

    def _settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        words = Words(batch.column("__text"))
        a = Anchors(words, window)
        covered, verify = np.zeros(0, np.int64), np.zeros(0, np.int64)
        runs = batch.column("__runs")
        sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        if sizes.sum():
            flat = runs.flatten()
            begin, last, kind = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "last", "kind"))
            shift = np.repeat(words.first[:-1], sizes)
            place = np.searchsorted(begin + shift, a.at, "right") - 1
            status = np.where((place >= 0) & (a.at <= (last + shift)[place]), kind[place], 0)
            branches = np.append(0, np.cumsum(status == BRANCH))
            lo, hi = np.searchsorted(a.at, a.windows), np.searchsorted(a.at, a.windows + a.inner, "right")
            plain = branches[lo] == branches[hi]
            covered = a.windows[plain & (status[a.least] == COPY)]
            verify = a.windows[~plain & (status[a.least] != 0)]
        h1 = words.grams(verify, verify + window).view(np.int64)
        h2 = words.grams(verify, verify + window, second=True).view(np.int64)
        cut_c, cut_v = np.searchsorted(covered, words.first), np.searchsorted(verify, words.first)
        rows: list[tuple] = []
        raw = words.raw.tobytes()
        for d in range(n):
            first_word = words.first[d]
            c, v = covered[cut_c[d] : cut_c[d + 1]] - first_word, slice(cut_v[d], cut_v[d + 1])
            body = raw[words.offsets[d] : words.offsets[d + 1]]
            if v.start == v.stop:
                count, removed, out = kept_text(body, c, window)
                rows.append((count, removed, hashlib.sha256(out).hexdigest() if digest else out.decode(), None, None, None, None, None))
            else:
                rows.append((int(words.counts[d]), None, None, body.decode(), c.astype(np.int32), (verify[v] - first_word).astype(np.int32), h1[v], h2[v]))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        arrays = [batch.column(f.name) for f in carried] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in carried), "n_words", "n_removed", *found])

    first_pass = staged(met.mapInArrow(settle, schema), "substring-pass")
    unstage(paths)

    unsettled = first_pass.where("__at is not null")
    windows = unsettled.select("__id", "__row", F.explode(F.arrays_zip("__at", "__h1", "__h2")).alias("w")).select("__id", "__row", "w.__at", "w.__h1", "w.__h2").toDF("__id", "__row", "at", "h1", "h2")
    sources = staged(windows.where("__id is not null").groupBy("h1", "h2").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where("first < last").select("h1", "h2", "first"), "window-sources")
    verified = windows.join(sources, ["h1", "h2"]).where("__id > first").groupBy("__id", "__row").agg(F.collect_set("at").alias("__verified"))
    rest = unsettled.drop("__at", "__h1", "__h2").join(verified, ["__id", "__row"], "left")

    done_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried if not f.name.startswith("__")]) + f"{', ' if others else ''}n_words long, n_removed long, {result} string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in carried if not f.name.startswith("__")]
        for batch in batches:
            rows = []
            for t, c, v in zip(batch.column("__text").to_pylist(), batch.column("__settled").to_pylist(), batch.column("__verified").to_pylist(), strict=True):
                count, removed, out = kept_text(t.encode(), np.unique(np.array([*(c or ()), *(v or ())], np.int64)), window)
                rows.append((count, removed, hashlib.sha256(out).hexdigest() if digest else out.decode()))
            made_ = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + made_, names=[*names, "n_words", "n_removed", result])

    settled = first_pass.where("__at is null").select(*[F.col(f"`{c}`") for c in others], "n_words", "n_removed", F.col("__out").alias(result))
    return settled.unionByName(rest.mapInArrow(finish, done_schema))
