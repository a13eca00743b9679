"""Equal requests answered once: the answers of each kind of request go to all who ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.sources.lineage import cut

#: Askers that are broadcast; more meet the answers by a shuffle.
BROADCAST_ASKERS = 2_000_000


def asked_once(requests: DataFrame, by: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(once, askers): ``requests`` with one ``by`` for each different set of rows, and (``by``, kind) of all who ask it.

    A question is all its rows, so that what an operator makes of a question's rows together stays the same.
    """
    what = [c for c in requests.columns if c != by]
    each = cut(requests.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*what))).alias("__ask")))
    kinds = cut(each.select("__ask").distinct().withColumn("kind", F.monotonically_increasing_id()))
    once = kinds.select(F.col("kind").alias(by), F.explode("__ask").alias("__a")).select(by, "__a.*")
    return once, cut(each.join(kinds, "__ask").select(by, "kind"))


def for_all(answers: DataFrame, askers: DataFrame, by: str = "question_id") -> DataFrame:
    """``answers`` to requests asked once, for each of their askers.

    Answers are dealt over all cores before they multiply; they never move after it.
    """
    known = answers.withColumnRenamed(by, "kind")
    if askers.count() > BROADCAST_ASKERS:
        return known.join(askers, "kind").select(*answers.columns)
    spread = known.repartition(answers.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.join(F.broadcast(askers), "kind").select(*answers.columns)


#: Rows of different texts that are broadcast whole; of more, only those of texts that more than one in FREQUENT rows has.
BROADCAST_TEXTS, FREQUENT = 200_000, 20_000


def read_once(rows: DataFrame, text: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``read(rows)``, where ``read`` adds columns that hang on ``text`` alone or makes several rows of one by it: equal texts are read once.

    What was read is written once and meets the rows by text. Frequent texts are broadcast, so that none
    of them fills a task; the others meet in a shuffle. Texts that hardly repeat are read where they are.
    """
    counts = cut(rows.groupBy(text).agg(F.count(F.lit(1)).alias("__n")))
    different, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    if different * 2 > total:
        return read(rows)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    said = cut(read(counts.repartition(cores * 4)).withColumnRenamed(text, "__text"))
    more = [c for c in said.columns if c not in ("__text", "__n")]
    meet = lambda part, known: part.join(known, F.col(text).eqNullSafe(F.col("__text"))).select(*rows.columns, *more)
    if said.count() <= BROADCAST_TEXTS:
        return meet(rows, F.broadcast(said))
    frequent = F.col("__n") * FREQUENT > total
    often = cut(counts.where(frequent).select(F.col(text).alias("__often")))
    rest = rows.join(F.broadcast(often), F.col(text).eqNullSafe(F.col("__often")), "left_anti")
    return meet(rows, F.broadcast(said.where(frequent))).unionByName(meet(rest, said.where(~frequent)))
