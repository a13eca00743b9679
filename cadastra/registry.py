"""All registered queries of the reference's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.plans import answers, evidence, factgraph, files, geo, ledger, questions, retrieval, semantic, standards, streams, structure, text  # noqa: F401  each registers its queries
from cadastra.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for a batch of questions: four channels, expanded, re-ranked, within a token budget."""
    return QUERIES["hybrid_retrieval"](spark, sf_dir)
