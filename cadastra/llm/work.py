"""Shared helpers: written tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder of a
    local session; on a cluster that is an error, since executors could not read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/cadastra-{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows: documents are long, and a batch is held by the JVM and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a ``staged`` table that no later step reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with n long (rows of its group) and rank long (place in the group by ``order``, from 0).

    Rows are dealt by ranges of group and order, so that a group of any size is spread; a row's place
    is its place in its part plus the rows of its group in the parts before. Windows run over the
    counts only, one row for each part and group in it.
    """
    rows = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    at = F.monotonically_increasing_id()
    rows = staged(rows.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at), name)
    counts = rows.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__count"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0))).withColumn("n", F.sum("__count").over(Window.partitionBy(*group)))
    parts = staged(parts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g_{c}") for c in group], "__first", "__before", "n"), f"{name}-parts")
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return rows.join(parts, same).select(*df.columns, "n", (F.col("__at") - F.col("__first") + F.col("__before")).alias("rank"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (id, component): smallest id reachable, for every id on an edge.

    Alternating large-star and small-star rounds, each written to the shared folder. Minima are
    partial aggregates and both sides of every join come from written tables or plain exchanges,
    so a hub's rows are split by AQE instead of meeting in one task. Self loops and null ends
    are ignored; an empty input gives an empty result.
    """
    cur = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "cc",
    )
    while not _all_stars(cur):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-min")
        large = staged(
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "cc-large",
        )
        low2 = staged(large.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        joined = large.join(low2, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))
        )
        new = staged(small.distinct(), "cc")
        for t in (cur, low, large, low2):
            unstage(t)
        cur = new
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _all_stars(cur: DataFrame) -> bool:
    """Every node has one edge down at most, and no node is both a leaf and a root."""
    ends = cur.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(
        cur.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("root"))
    )
    return (
        ends.groupBy("n")
        .agg(F.sum("down").alias("down"), F.max("root").alias("root"))
        .where("down > 1 or (down = 1 and root = 1)")
        .isEmpty()
    )
