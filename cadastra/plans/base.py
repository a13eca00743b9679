"""Registration of queries with the SQL that checks them, and the tables they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadastra.sources.derived import DERIVED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Given tables as attributes, and derived ones (``d_*``) built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DERIVED:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        made = self.derived(name)
        # The fragment tree is a stored table elsewhere; here it is derived once and read level by level.
        return made.persist() if name == "d_fragments" else made

    def derived(self, name: str, **known: DataFrame) -> DataFrame:
        """The derived table ``name``; of the tables it reads, those in ``known`` are not derived anew."""
        text = DERIVED[name][0]
        return self.spark.sql(text, **{n: known[n] if n in known else getattr(self, n) for n in sorted(names_in(text))})


def names_in(text: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", text))


def oracle(text: str) -> str:
    """``text`` with the definitions of the derived tables that it names in braces put before it."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in DERIVED and name not in parts:
            body = DERIVED[name][1]
            for n in sorted(names_in(body)):
                add(n)
            parts[name] = f"{name} AS MATERIALIZED ({re.sub(r'\{(\w+)\}', r'\1', body)})"

    for n in sorted(names_in(text)):
        add(n)
    body = re.sub(r"\{(\w+)\}", r"\1", text).strip()
    if not parts:
        return body
    head = ",\n".join(parts.values())
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE'):]}"
    if re.match(r"WITH\b", body):
        return f"WITH {head},\n{body[len('WITH'):]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under ``name``; ``sql`` is its twin for DuckDB."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return register
