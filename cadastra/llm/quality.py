"""Quality classifier: interpolated modified Kneser-Ney model of trusted text (operator 8).

The model is over 4-grams of code points, an open set. N-gram counts of trusted documents,
continuation counts and context totals are tables dealt by context, which grow with the text.
Documents are dealt into blocks; the distinct 4-grams of a block meet those tables in joins, and
only their probabilities go back to the block. Nothing of the model is collected or broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.rows import ARROW, with_columns_by_slice
from cadastra.llm.textarrays import mix, plain_words, slices, spans, utf8
from cadastra.llm.work import stage_path, staged

#: Ids up to this number are broadcast (16 MB); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Order of the model; an n-gram is the pair (symbols before the last three, last three) of 21 bits a symbol.
ORDER, BITS = 4, 21
#: Text of a block, whose distinct n-grams are looked up once, and of a row that carries a part of a block.
BLOCK_BYTES, PACK_BYTES = 16 << 20, 4 << 20
#: Files that blocks are dealt into at most.
MAX_BUCKETS = 4096
#: Distinct n-grams that a counting task holds before it hands them on.
FLUSH_GRAMS = 1 << 18
#: Symbols of the model: all code points and the end mark.
SYMBOLS = 0x110000 + 1


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts for counts of 1, 2, and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
    got = counts.agg(*[F.count_if(F.col("n") == i) for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(v or 0) for v in got)
    if not n1 or not n2 or not n3:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [max(0.0, min(i, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def open_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both parts of every n-gram of code points of each text between end marks (symbol 0), and
    where each text's n-grams begin (length of the text in characters plus one of them)."""
    raw, _ = utf8(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    length = pc.fill_null(pc.utf8_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = length + ORDER
    begin = np.cumsum(block) - block
    x = np.zeros(int(block.sum()), np.int64)
    x[spans(begin + ORDER - 1, length)] = points.astype(np.int64) + 1
    last = spans(begin + ORDER - 1, length + 1)
    hi = np.zeros(len(last), np.int64)
    for back in range(ORDER - 1, 2, -1):
        hi = hi << BITS | x[last - back]
    lo = x[last - 2] << 2 * BITS | x[last - 1] << BITS | x[last]
    return hi, lo, np.cumsum(length + 1) - length - 1


def _key(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One number for an n-gram, to find it by within a block."""
    return mix(mix(hi.astype(np.uint64)) ^ lo.astype(np.uint64))


def _distinct(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct (hi, lo) of all parts, and the sums of their counts."""
    hi, lo, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    codes, found = pd.factorize(_key(hi, lo))
    at = np.zeros(len(found), np.int64)
    at[codes] = np.arange(len(codes))  # any occurrence
    return hi[at], lo[at], np.bincount(codes, n, len(found)).astype(np.int64)


def _slice_grams(texts: pa.Array) -> tuple[np.ndarray, ...]:
    hi, lo, _ = open_grams(texts)
    return _distinct([(hi, lo, np.ones(len(hi), np.int64))])


def _count_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    for whole in batches:
        for batch in slices(whole, "text"):
            held.append(_slice_grams(batch.column("text")))
            if sum(len(p[0]) for p in held) > FLUSH_GRAMS:
                held = [_distinct(held)]
                if len(held[0][0]) > FLUSH_GRAMS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["hi", "lo", "n"])
                    held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _distinct(held)], names=["hi", "lo", "n"])


def _suffix(order: int) -> list[Column]:
    """Both parts of the n-gram of ``order`` symbols at the end of a longer one."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * max(order - 3, 0)) - 1))
    return [hi.alias("hi"), F.col("lo").bitwiseAND(F.lit((1 << BITS * min(order, 3)) - 1)).alias("lo")]


def count_open(trusted: DataFrame) -> dict[int, DataFrame]:
    """Tables (hi, lo, n) of orders 1 to ORDER: counts of all n-grams of ``text``, and continuation counts below."""
    found = trusted.where("text is not null").select("text").mapInArrow(_count_open, "hi long, lo long, n long")
    counts = {ORDER: staged(found.groupBy("hi", "lo").agg(F.sum("n").alias("n")), "kn-counts")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = staged(counts[order + 1].groupBy(*_suffix(order)).agg(F.count(F.lit(1)).alias("n")), "kn-counts")
    return counts


def open_probabilities(counts: dict[int, DataFrame], asked: DataFrame) -> DataFrame:
    """(hi, lo, log_p double) of distinct n-grams ``asked`` (hi, lo), seen or not.

    Per order, asked and counted n-grams are dealt by context together, which gives counts and the
    totals of the context in one place; the lower order's probability joins by suffix.
    """
    wanted = {ORDER: asked}
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = wanted[order + 1].select(*_suffix(order)).distinct()
    lower = None
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[order])
        both = counts[order].withColumn("asked", F.lit(0)).unionByName(wanted[order].select("hi", "lo", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")))
        dealt = both.withColumn("context", F.shiftright("lo", BITS)).repartition("hi", "context")
        grams = dealt.groupBy("hi", "context", "lo").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
        grams = grams.withColumn("d", F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        same = Window.partitionBy("hi", "context")
        found = grams.select("hi", "lo", "n", "d", "asked", F.sum("n").over(same).alias("total"), F.sum("d").over(same).alias("freed")).where("asked = 1")
        if lower is None:
            found = found.withColumn("p_low", F.lit(1 / SYMBOLS))
        else:
            near = found.select("*", *[c.alias(f"low_{p}") for c, p in zip(_suffix(order - 1), ("hi", "lo"), strict=True)])
            found = near.join(lower.select(F.col("hi").alias("low_hi"), F.col("lo").alias("low_lo"), F.col("p").alias("p_low")), ["low_hi", "low_lo"])
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("d") + F.col("freed") * F.col("p_low")) / F.col("total")).otherwise(F.col("p_low"))
        lower = found.select("hi", "lo", p.alias("p"))
    return lower.select("hi", "lo", F.log("p").alias("log_p"))


def _pack(batches: Iterator[pa.RecordBatch], text: str, blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, rows) of about PACK_BYTES of text each, the rows compressed; a task's rows go to ``blocks`` blocks in turn."""
    held: list[pa.RecordBatch] = []
    size, turn = 0, TaskContext.get().partitionId()

    def row() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
            for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
                writer.write_batch(batch)
        return pa.RecordBatch.from_arrays([pa.array([turn % blocks], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    for whole in batches:
        for batch in slices(whole, text):
            held.append(batch)
            size += batch.nbytes
            if size >= PACK_BYTES:
                yield row()
                held, size, turn = [], 0, turn + 7919
    if held:
        yield row()


def _unpacked(packs: pa.Table, text: str) -> Iterator[pa.RecordBatch]:
    for rows in packs.column("rows"):
        for whole in pa.ipc.open_stream(rows.as_buffer()):
            yield from slices(whole, text)


def _block_grams(packs: pa.Table, text: str) -> pa.Table:
    """The distinct n-grams of a block."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in _unpacked(packs, text):
        held.append(_slice_grams(batch.column(text)))
        if sum(len(p[0]) for p in held) > FLUSH_GRAMS:
            held = [_distinct(held)]
    hi, lo, _ = _distinct(held)
    order = np.lexsort((lo, hi))  # packs better
    hi, lo = hi[order], lo[order]
    return pa.table({"block": np.full(len(hi), packs.column("block")[0].as_py()), "hi": hi, "lo": lo})


def _dealt(packs: DataFrame, blocks: int) -> DataFrame:
    """``packs`` (block, rows) written in files by block, so that later steps meet a block's rows without dealing them again."""
    spark = packs.sparkSession
    name = f"kn_blocks_{uuid.uuid4().hex}"
    packs.write.bucketBy(min(blocks, MAX_BUCKETS), "block").option("path", stage_path(spark, "kn-blocks")).saveAsTable(name)
    return spark.table(name)


#: Types of further columns, and what makes them of a batch.
More = tuple[dict[str, str], Callable[[pa.RecordBatch], dict[str, object]]]


def open_perplexity(docs: DataFrame, counts: dict[int, DataFrame], text: str = "text", more: More = ({}, lambda batch: {})) -> DataFrame:
    """``docs`` plus perplexity double: per symbol, end mark included; null for null or empty text.
    ``more`` adds columns in the same pass, so that texts go through one Python worker only.

    Rows are written compressed, dealt into blocks of about BLOCK_BYTES of text, and not moved again.
    The distinct n-grams of all blocks get their probability once, and go back to the blocks that
    hold them.
    """
    types, make = more
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("perplexity", *types)]
    names = [f.name for f in kept]
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    packs = _dealt(docs.select(*[docs[f"`{c}`"] for c in names]).mapInArrow(lambda batches: _pack(batches, text, blocks), "block long, rows binary"), blocks)
    probes = staged(packs.groupBy("block").applyInArrow(lambda table: _block_grams(table, text), "block long, hi long, lo long"), "kn-probes")
    known = open_probabilities(counts, probes.select("hi", "lo").distinct())
    back = probes.join(known, ["hi", "lo"]).select("block", "hi", "lo", F.col("log_p").cast("float").alias("log_p"))

    def score(block: pa.Table, grams: pa.Table) -> pa.Table:
        found = pd.Index(_key(grams.column("hi").to_numpy(), grams.column("lo").to_numpy()))
        log_p = grams.column("log_p").to_numpy().astype(np.float64)
        out = []
        for batch in _unpacked(block, text):
            hi, lo, at = open_grams(batch.column(text))
            n = np.diff(np.append(at, len(hi)))
            mean = np.add.reduceat(log_p[found.get_indexer(_key(hi, lo))], at) / n
            got = pa.array(np.exp(-mean), pa.float64(), mask=n <= 1)
            made = make(batch)
            found_more = [pa.array(made[c], ARROW[t]) for c, t in types.items()]
            out.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), got, *found_more], names=[*names, "perplexity", *types]))
        return pa.Table.from_batches(out)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["perplexity double"] + [f"{c} {t}" for c, t in types.items()])
    return packs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)


def word_facts(text: str, marks: Sequence[str] = (), prefix: str = "") -> More:
    """Columns varied double (distinct pairs of neighbouring words per pair; null under five words) and
    marked boolean (whether one of the words ``marks`` is among the words)."""
    wanted = plain_words(pa.array(marks, pa.string())).hashes

    def make(batch: pa.RecordBatch) -> dict[str, object]:
        words = plain_words(batch.column(text))
        starts, n = words.gram_starts(2)
        doc = np.repeat(np.arange(len(n)), n)
        pair = mix(words.grams(starts, starts + 2) ^ mix(doc.astype(np.uint64)))
        once = ~pd.Series(pair).duplicated().to_numpy()
        owner = np.repeat(np.arange(len(n)), words.counts)[np.isin(words.hashes, wanted)]
        varied = pa.array(np.bincount(doc[once], minlength=len(n)) / np.maximum(n, 1), mask=np.asarray(n) < 4)
        return {f"{prefix}varied": varied, f"{prefix}marked": np.bincount(owner, minlength=len(n)) > 0}

    return {f"{prefix}varied": "double", f"{prefix}marked": "boolean"}, make


def toxic_words(trusted: DataFrame, toxic: DataFrame, share: float = 0.1, times: float = 50, least: int = 5) -> list[str]:
    """Words that mark toxic documents: in ``share`` of a language's different toxic texts or more (and
    ``least`` of them), and ``times`` as often as in the trusted texts of that language.

    Both have text and lang. All texts are counted, copies of a toxic text once; ``share`` bounds how
    many words a language can have.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), 1))
    same = [F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.length("text").alias("n")]
    once = staged(toxic.select("lang", *same, words.alias("ws")).groupBy("lang", "h1", "h2", "n").agg(F.first("ws").alias("ws")), "kn-toxic-texts")
    sizes = once.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    trusted_sizes = trusted.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("trusted"))
    bad = once.select("lang", F.explode("ws").alias("w")).groupBy("w", "lang").agg(F.count(F.lit(1)).alias("bad")).join(sizes, F.col("lang").eqNullSafe(F.col("of"))).drop("of")
    bad = staged(bad.where((F.col("bad") >= least) & (F.col("bad") >= share * F.col("size"))), "kn-toxic")
    asked = F.broadcast(bad.select("w").distinct())  # mean words of a text / share, per language
    good = trusted.select(F.col("lang").alias("of"), F.explode(words).alias("w")).join(asked, "w").groupBy("w", "of").agg(F.count(F.lit(1)).alias("good"))
    good = good.withColumnRenamed("w", "word")
    known = bad.join(good, (F.col("w") == F.col("word")) & F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    known = known.join(trusted_sizes, F.col("lang").eqNullSafe(F.col("of")), "left")
    usual = (F.coalesce("good", F.lit(0)) + 0.5) / F.greatest(F.coalesce("trusted", F.lit(1)), F.lit(1))
    return sorted(r["w"] for r in known.where(F.col("bad") / F.col("size") >= times * usual).select("w").distinct().collect())


def score_quality(docs: DataFrame, trusted_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", tail: float = 0.99, toxic_ids: DataFrame | None = None, low: float = 0.001) -> DataFrame:
    """All columns of ``docs`` plus perplexity, max_perplexity and kept boolean.

    ``trusted_ids`` (doc_id) names the trusted documents. Every fifth by hash (if these are 20 or
    more) is left out of the counts, since counted texts look better than others; a language's limit
    is the ``tail`` quantile of the perplexity of those.
    Languages (null too) with fewer than 20 trusted documents take the limit over all of them.
    A document is kept if it has text and does not pass its limit, if its pairs of words repeat no more
    than those of trusted documents (``low`` quantile of ``word_facts``), and if it has none of the words
    that mark the documents of ``toxic_ids`` (doc_id). Without any trusted text, all
    documents with text are kept. Clashing columns are replaced; an empty table stays empty.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() in ("max_perplexity", "kept", "perplexity")])
    ids = trusted_ids.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__trusted")).distinct()
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    is_left = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(5)) == 0
    trusted = docs.join(near, docs[doc_id] == F.col("__trusted"), "left_semi").where(F.length(text) > 0).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), is_left.alias("left"))
    sizes = trusted.agg(F.count(F.lit(1)), F.count_if("left")).first()
    split = sizes[1] >= 20 and sizes[0] > sizes[1]
    if not sizes[0]:
        return out.withColumn("perplexity", F.lit(None).cast("double")).withColumn("max_perplexity", F.lit(None).cast("double")).withColumn("kept", F.length(text) > 0).fillna(False, ["kept"])
    counts = count_open(trusted.where("not left") if split else trusted)
    mine = open_perplexity(trusted.where("left") if split else trusted, counts)
    # Rounded up to a thousandth, so that the exact quantiles hold some 30,000 different values at most, and
    # come out the same in whatever order the rows come.
    scored = mine.where("perplexity is not null").withColumn("x", F.ceil(F.log("perplexity") * 1000) / 1000)
    quantiles = F.expr(f"percentile_disc({tail}) within group (order by x)").alias("q")
    limit = F.exp("q")
    # One row per language and one for all, from one pass over the trusted documents.
    limits = staged(scored.groupingSets([["lang"], []], "lang").agg(F.grouping("lang").alias("all"), F.count(F.lit(1)).alias("n"), quantiles).select("lang", "all", "n", limit.alias("max")), "kn-limits")
    overall = limits.where("all = 1").first()
    overall = overall["max"] if overall else None
    own = limits.where("all = 0 and n >= 20").select(F.col("lang").alias("__lang"), F.col("max").alias("__max"))
    kinds, facts = word_facts("text")
    floor = with_columns_by_slice(trusted, kinds, facts, "text").select((F.floor(F.col("varied") * 1000) / 1000).alias("x")).agg(F.expr(f"percentile_disc({low}) within group (order by x)")).first()[0]
    marks: list[str] = []
    if toxic_ids is not None:
        bad = toxic_ids.select(F.col(doc_id).alias("__trusted")).distinct()
        bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
        marks = toxic_words(trusted, docs.join(bad, docs[doc_id] == F.col("__trusted"), "left_semi").select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")))
    found = open_perplexity(out, counts, text, word_facts(text, marks, "__"))
    found = found.join(own, found[lang].cast("string").eqNullSafe(F.col("__lang")), "left")
    found = found.withColumn("max_perplexity", F.coalesce("__max", F.lit(overall))).drop("__lang", "__max")
    good = (F.col("perplexity") <= F.col("max_perplexity")) & (F.coalesce(F.col("__varied"), F.lit(1.0)) >= F.lit(floor or 0.0)) & ~F.col("__marked")
    return found.withColumn("kept", F.coalesce(good, F.lit(False))).drop("__varied", "__marked")
