"""Files written one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadastra.sources import files
from cadastra.sources.files import ingest_outcomes, write_each


def test_each_key_has_its_file_and_tasks_share_them(spark, tmp_path):
    docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))  # one task
    write_each(docs, f"{tmp_path}/all", "doc_id", "text")
    found = ingest_outcomes(spark, f"{tmp_path}/all").where("path like '%.txt'").select(F.regexp_extract("path", r"doc_id=(\d+)/", 1).cast("long").alias("doc_id"), "text", F.regexp_extract("path", r"/part-(\d+)-", 1).alias("task"))
    rows = found.collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(k, f"text {k}\n") for k in range(60)]
    assert len({r.task for r in rows}) > 4


@pytest.mark.parametrize("kind", ["text", "csv"])
def test_tasks_open_files_of_a_mounted_folder_themselves(spark, tmp_path, monkeypatch, kind):
    texts = ["", "a,b", 'say "x"', " two\nlines ", "caf\u00e9", "x"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(5, "y"), (7, None)], "doc_id long, text string")
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 4, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFFE"))).cast("string")).otherwise(F.col("text")))
    write_each(docs, f"{tmp_path}/own", "doc_id", kind)
    monkeypatch.setattr(files, "LINES", {})
    write_each(docs, f"{tmp_path}/spark", "doc_id", kind)
    held = lambda top: {p.parent.name: (p.suffix, sorted(p.read_bytes().split(b"\n"))) for p in (tmp_path / top).rglob("part-*")}
    assert held("own") == held("spark") and len(held("own")) == 7
    assert not list((tmp_path / "own").rglob(".*"))  # no checksum files, each of which took a process
    monkeypatch.undo()
    write_each(docs, f"{tmp_path}/flat", "doc_id", kind, nested=False)
    assert {p.stem: (p.suffix, sorted(p.read_bytes().split(b"\n"))) for p in (tmp_path / "flat").glob("folder=*/*")} == held("spark")


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    write_each(spark.range(800).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), f"{tmp_path}/all", "doc_id", "text")
    found = ingest_outcomes(spark, f"{tmp_path}/all")
    assert found.count() == found.where("status = 'ingested'").count() == 800
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() <= spark.sparkContext.defaultParallelism * 4  # it was 25


def test_replacing_documents_moves_their_rows_only(spark, tmp_path, monkeypatch):
    path, moved, put = str(tmp_path / "t"), [], files.replace_partitions

    def watched(df, *args):
        df.collect()

        def shuffled(node):
            name = node.nodeName()
            if name == "AdaptiveSparkPlan" or name.endswith("QueryStage"):
                return shuffled(node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan())
            own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
            return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))

        moved.append(shuffled(df._jdf.queryExecution().executedPlan()))
        put(df, *args)

    monkeypatch.setattr(files, "replace_partitions", watched)
    files.replace_documents(spark.range(4000).selectExpr("id % 200 as document_id", "id as n", "'a' as v"), path)
    for _ in range(2):
        files.replace_documents(spark.createDataFrame([(3, -1, "b"), (500, -2, "c")], "document_id long, n long, v string"), path)
    rows = sorted(tuple(r) for r in spark.read.parquet(path).select("document_id", "n", "v").collect())
    assert rows == sorted([(i % 200, i, "a") for i in range(4000) if i % 200 != 3] + [(3, -1, "b"), (500, -2, "c")])
    assert moved[0] == 4000 and max(moved[1:]) <= 10  # rows and ids of two documents; it was all rows of their buckets


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_documents_replaced_many_times_stay_in_few_files(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(files, "BROADCAST_DOCUMENTS", broadcast)
    monkeypatch.setattr(files, "BUCKET_FILES", 2)
    path = str(tmp_path / "t")
    files.replace_documents(spark.range(40).selectExpr("id as document_id", "0 as v"), path, buckets=2)
    for k in range(1, 9):
        files.replace_documents(spark.range(k, k + 2).selectExpr("id as document_id", f"{k} as v"), path, buckets=2)
    held = spark.read.parquet(path)
    assert {r["document_id"]: r["v"] for r in held.collect()} == {d: min(d, 8) if 0 < d < 10 else 0 for d in range(40)}
    assert held.count() == 40 and len(held.inputFiles()) <= 10
