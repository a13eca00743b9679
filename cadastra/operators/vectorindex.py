"""A coarse index over vectors: lists around centres, probed by queries, ranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators.retrieval import top_k

#: Vectors that the centres are fitted on, at most; every vector is then put in a list.
SAMPLE = 20_000
#: Rows of a part of a list, and queries that meet it at a time.
PART = 4096
#: Rows of the sample that choose the number of probes.
ASKED = 500


def _usable(df: DataFrame, key: str, vector: str, alias: str) -> DataFrame:
    """(``alias``, v) of rows whose vector is of finite numbers and not all zero."""
    v = F.col("v")
    rows = df.select(F.col(key).alias(alias), F.col(vector).cast("array<double>").alias("v")).where(F.col(alias).isNotNull() & v.isNotNull())
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


class Coarse(NamedTuple):
    """Unit centres of the lists, and how many of them a query reads."""

    centres: np.ndarray
    probes: int


def fit(vectors: DataFrame, key: str, vector: str, lists: int, recall: float = 0.95, k: int = 8, sample: int = SAMPLE, rounds: int = 12) -> Coarse:
    """Spherical k-means on the ``sample`` rows of smallest hash of their id, of the most frequent dimension.

    The number of probes is the least by which ASKED rows of the sample find ``recall`` of their ``k`` nearest
    in the sample: few where vectors lie in clusters, many where they point everywhere.
    """
    rows = _usable(vectors, key, vector, "id")
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return Coarse(np.zeros((0, 0)), 1)
    picked = rows.where(F.size("v") == size["d"]).orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    x = _unit(np.stack(picked["v"].to_numpy()))
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)  # an empty list keeps its centre
    return Coarse(centres, _probes(x, centres, recall, k))


def _probes(x: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
    asked = x[:ASKED]
    k = min(k, len(x))
    nearest = np.argpartition(-(asked @ x.T), k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each list in the order of a query
    wanted = np.take_along_axis(place, (x @ centres.T).argmax(1)[nearest], axis=1)
    return int(np.quantile(wanted, recall, method="higher")) + 1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def assign_lists(vectors: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int = 1, alias: str = "id") -> DataFrame:
    """(``alias``, v, list): each usable vector with its ``probes`` nearest centres.

    Vectors of another dimension than the centres' have the list -1 of their own, so that they are found too.
    The centres go to the tasks; their number is a parameter, it does not grow with the vectors.
    """

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = frame["v"].map(len) == centres.shape[1]
            odd = frame[~fits]
            yield odd.assign(list=-1)
            part = frame[fits]
            if len(part):
                k = min(probes, len(centres))
                close = np.argpartition(-(_unit(np.stack(part["v"].to_numpy())) @ centres.T), k - 1, axis=1)[:, :k]
                out = part.loc[part.index.repeat(k)]
                yield out.assign(list=close.reshape(-1))

    return _usable(vectors, key, vector, alias).mapInPandas(near, f"{alias} long, v array<double>, list int")


def index_candidates(queries: DataFrame, index: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` rows of largest cosine for each query among the lists that it probes: question_id, source_fragment_id, base_score, rank.

    ``queries`` (question_id, v, list) and ``index`` (id, v, list), both by ``assign_lists``. A list is dealt
    into parts of PART rows by hash, and so are the queries of a list, so that a full list is many tasks; a
    task multiplies one part of each and hands on the best of each query. Ranks look at nine decimals.
    """
    held = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).alias("n_parts"))
    asked = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).alias("q_parts"))
    plan = F.broadcast(held.join(asked, "list"))  # a row for each list
    rows = index.join(plan, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts"))).withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1)))
    mine = queries.join(plan, "list").withColumn("asked", F.pmod(F.xxhash64("question_id"), F.col("q_parts"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"question_id": np.empty(0, np.int64), "source_fragment_id": np.empty(0, np.int64), "base_score": np.empty(0)})]
        for size in set(left["v"].map(len)) & set(right["v"].map(len)):
            a, b = left[left["v"].map(len) == size], right[right["v"].map(len) == size]
            score = _unit(np.stack(a["v"].to_numpy())) @ _unit(np.stack(b["v"].to_numpy())).T
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else score.min(1)
            at, row = np.nonzero(score >= least[:, None] - 2e-9)
            found.append(pd.DataFrame({"question_id": a["question_id"].to_numpy()[at], "source_fragment_id": b["id"].to_numpy()[row], "base_score": score[at, row]}))
        return pd.concat(found)

    keys = ["list", "part", "asked"]
    pairs = mine.select(*keys, "question_id", "v").groupBy(*keys).cogroup(rows.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(best, "question_id long, source_fragment_id long, base_score double")
    return top_k(pairs.withColumn("__score", F.round("base_score", 9)), k, score="__score").drop("__score").withColumn("retrieval_channel", F.lit("vector"))
