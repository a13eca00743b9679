"""The corpus pipeline: quality, lines, near duplicates, test items, token ids.

Each stage takes (spark, docs, sf_dir) and all that the stage before it kept. All but the last
return the columns of ``documents``, with ``n_chars`` counted anew where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.bpe import bpe_encode_decode
from cadastra.llm.decontaminate import contamination
from cadastra.llm.jaccardjoin import jaccard_join
from cadastra.llm.linededup import line_dedup
from cadastra.llm.quality import score_quality
from cadastra.llm.queries import table, tokenizer_json, toxic_ids, trusted_ids
from cadastra.llm.work import small_batches, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the perplexity limit of their language rejects, that repeat themselves, that hold toxic words or no text."""
    small_batches(spark)
    return score_quality(docs, trusted_ids(spark, sf_dir), toxic_ids=toxic_ids(spark, sf_dir)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that ten documents or more hold stays only in the first of them.

    A document of which no text stays goes: all its lines are in documents before it.
    """
    small_batches(spark)
    out = line_dedup(docs, min_docs=10, min_chars=1, keep_first=True)
    left = out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return left.where(F.length("text") > 0).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the first stays."""
    small_batches(spark)
    groups = jaccard_join(docs.select("doc_id", "text"), size=5, num=4, den=5)
    gone = staged(groups.where("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of ``benchmark`` go."""
    small_batches(spark)
    return contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("item_ids") == 0).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the text decoded from them."""
    small_batches(spark)
    out = bpe_encode_decode(docs, tokenizer_json(), keep_decoded=False)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: SQL can express neither the language model nor the merges; tests/llm compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
