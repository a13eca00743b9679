"""File sources and sinks: text directories, file identity, GeoJSON, run logs, replaceable partitions."""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cadastra.sources.lineage import cut, written

#: Media types by suffix.
MEDIA_TYPES = {".pdf": "application/pdf", ".txt": "text/plain", ".text": "text/plain", ".md": "text/markdown", ".json": "application/json", ".geojson": "application/geo+json", ".html": "text/html"}


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    found = F.lit("application/octet-stream")
    for s, kind in MEDIA_TYPES.items():
        found = F.when(suffix == s, kind).otherwise(found)
    return found


def file_identity(files: DataFrame) -> DataFrame:
    """``files`` (path, content binary) plus sha256 and mime_type."""
    return files.withColumn("sha256", F.sha2("content", 256)).withColumn("mime_type", media_type(F.col("path")))


#: Suffixes of the formats of which a row is a line of text.
LINES = {"text": "txt", "csv": "csv"}


def write_each(df: DataFrame, path: str, key: str, kind: str, folders: int = 256, nested: bool = True) -> None:
    """A file for each ``key`` under a new directory, as ``folder=…/key=…``, in the format ``kind``.

    Files are dealt over all cores by folder, however few tasks ``df`` has. A folder belongs to one task, so that
    whoever lists the directory lists a folder in one task. Where the directory is on a mounted file system, tasks
    open their files themselves: Hadoop's local file system starts a process or two for each file. Other stores
    get them by Spark's writer, whose commit moves folders, not files. Without ``nested``, files that tasks open
    themselves have no folder of their own, which takes a block of the disk each, and are named ``key=….suffix``.
    """
    spark = df.sparkSession
    dealt = df.withColumn("folder", F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")).repartition(spark.sparkContext.defaultParallelism * 4, "folder")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    at = store.makeQualified(place).toUri()
    if at.getScheme() != "file" or kind not in LINES or not isinstance(df.schema[key].dataType, IntegralType):
        dealt.write.partitionBy("folder", key).format(kind).save(path)
        return
    if store.exists(place):
        raise FileExistsError(path)
    os.makedirs(at.getPath())  # there even without a row
    rest = [c for c in df.columns if c != key]
    if kind == "csv":  # as Spark's writer: a row of nulls is no line; to_csv fails on it
        line = F.when(F.greatest(F.lit(False), *[F.isnotnull(c) for c in rest]), F.concat(F.to_csv(F.struct(*rest)), F.lit("\n")))
    else:
        [text] = rest
        line = F.concat(F.coalesce(text, F.lit("")), F.lit("\n"))
    rows = dealt.select("folder", key, line.cast("binary").alias("line")).sortWithinPartitions("folder", key)
    rows.mapInArrow(_own_files(at.getPath(), key, LINES[kind], nested), "n long").agg(F.sum("n")).collect()


def _own_files(path: str, key: str, suffix: str, nested: bool) -> Callable[[Iterator], Iterator]:
    """Writes the rows of a task (folder, key, line), sorted by key, a file for each key; a file is there whole or not at all."""

    run = uuid.uuid4()

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task, n = TaskContext.get(), 0
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for (folder, value), lines in itertools.groupby(rows, key=lambda row: row[:2]):
            name = f"{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
            home, name = (f"{path}/folder={folder}/{name}", f"part-{task.partitionId():05d}-{run}") if nested else (f"{path}/folder={folder}", name)
            os.makedirs(home, exist_ok=True)
            begun = f"{home}/.{name}-{task.taskAttemptId()}"
            with open(begun, "wb") as f:
                f.writelines(line or b"" for *_, line in lines)
            os.replace(begun, f"{home}/{name}.{suffix}")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return write


def ingest_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files under a directory: path, text, sha256, mime_type; other suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    texts = files.where(F.lower("path").rlike(r"\.(txt|text|md)$"))
    return file_identity(texts.select("path", "content")).select("path", F.decode("content", "UTF-8").alias("text"), "sha256", "mime_type")


def ingest_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file under a directory: path, status, reason, sha256, mime_type, text.

    A text file is ``ingested``; one that is no UTF-8 or holds no words is ``failed``, other suffixes are
    ``skipped``, both with the reason and without a text. No file stops the others. Texts are read by the
    tasks; the content of skipped files is hashed, not kept. Spark would read some thirty small files a task: as many
    tasks as the session has room for read them all.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = file_identity(found.coalesce(spark.sparkContext.defaultParallelism * 4))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    reason = F.when(~suffix.isin("txt", "text", "md"), F.concat(F.lit("unsupported suffix "), suffix)).when(text.isNull(), "not UTF-8").when(~text.rlike(r"\S"), "empty")
    status = F.when(reason.isNull(), "ingested").when(reason.startswith("unsupported"), "skipped").otherwise("failed")
    return files.select("path", status.alias("status"), reason.alias("reason"), "sha256", "mime_type", F.when(reason.isNull(), text).alias("text"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is not among ``known`` (sha256)."""
    return files.join(known.select("sha256"), "sha256", "left_anti")


def read_geojson(spark: SparkSession, path: str, expected_crs: int = 4326, lines: bool = False) -> DataFrame:
    """One row per feature of GeoJSON collections: idx, properties map, geometry string; another CRS is an error.

    A file holds one collection, or with ``lines`` one on each line.
    """
    schema = "type string, crs struct<properties: struct<name: string>>, features array<struct<properties: map<string,string>, geometry: string>>"
    whole = spark.read.text(path, wholetext=not lines).select(F.from_json("value", schema).alias("c"))
    crs = crs_code(F.col("c.crs.properties.name"))
    checked = whole.withColumn(
        "features",
        F.when(F.coalesce(F.col("c.type"), F.lit("")) != "FeatureCollection", F.raise_error(F.lit("not a FeatureCollection")))
        .when(crs != expected_crs, F.raise_error(F.concat(F.lit("unexpected CRS "), crs.cast("string"))))
        .otherwise(F.col("c.features")),
    )
    return checked.select(F.posexplode("features").alias("idx", "f")).select("idx", "f.properties", "f.geometry")


def crs_code(name: Column) -> Column:
    """EPSG number of a CRS name; CRS84 and a missing name count as 4326."""
    return F.when(name.isNull() | name.rlike("(?i)CRS84"), 4326).otherwise(F.try_to_number(F.regexp_extract(name, r"(\d+)\s*$", 1), F.lit("999999")).cast("int"))


def clean_features(raw: DataFrame, key: str, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(features, warnings): rows without geometry or key go, of equal keys (``within`` the columns named) the first by idx stays."""
    from pyspark.sql import Window

    k = F.nullif(F.trim(F.col(f"properties.{key}")), F.lit(""))
    ranked = raw.withColumn("feature_key", k).withColumn("rank", F.row_number().over(Window.partitionBy(*within, "feature_key").orderBy("idx")))
    reason = F.when(F.col("geometry").isNull(), "no geometry").when(F.col("feature_key").isNull(), "no key").when(F.col("rank") > 1, "duplicate key")
    judged = ranked.withColumn("warning", reason)
    return judged.where("warning is null").drop("rank", "warning"), judged.where("warning is not null").select(*within, "idx", "feature_key", "warning")


def append_trace(df: DataFrame, path: str, partition: str = "run_date") -> None:
    """Append-only run log, by date."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str = "document_id") -> None:
    """Overwrites just the partitions that ``df`` holds, so that enrichment can run again."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_runs(df: DataFrame, path: str, partition: str = "run_date", run: str = "run_id") -> None:
    """Appends the runs of ``df`` that the log at ``path`` does not hold yet, so that a job that runs again adds nothing twice.

    Only the run ids of the log are read, of the dates that ``df`` has.
    """
    spark = df.sparkSession
    log = spark._jvm.org.apache.hadoop.fs.Path(path)
    if log.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(log):
        held = spark.read.parquet(path).select(partition, run).join(df.select(partition).distinct(), partition, "left_semi").select(run).distinct()
        df = cut(df.join(held, run, "left_anti"))
    append_trace(df, path, partition)


#: Ids of replaced documents that are broadcast; more meet the table by a shuffle. Files of a bucket at which they are put together.
BROADCAST_DOCUMENTS, BUCKET_FILES = 2_000_000, 16


def replace_documents(df: DataFrame, path: str, document_id: str = "document_id", buckets: int = 64) -> None:
    """Puts the rows of ``df`` in place of all rows that the table at ``path`` has of its documents.

    The table is partitioned by a hash bucket of the document. Only buckets with a document of ``df`` are
    written anew, with what they hold of other documents; a run that is repeated changes nothing. Just the rows
    of ``df`` are moved: the others are read by bucket already, and what was read is replaced when all tasks have
    ended. Buckets of many files are dealt anew.
    """
    spark = df.sparkSession
    new = df.withColumn("bucket", F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int"))
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not table.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(table):
        return replace_partitions(new.hint("rebalance", "bucket"), path, "bucket")
    new = written(new)  # read for its buckets, its documents and its rows
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` rows at most
    gone = new.select(document_id).distinct()
    held = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    others = held.join(F.broadcast(gone) if gone.count() <= BROADCAST_DOCUMENTS else gone, document_id, "left_anti")
    names = tuple(f"/bucket={b}/" for b in touched)
    if sum(any(n in f for n in names) for f in held.inputFiles()) > BUCKET_FILES * len(touched):
        rows = new.unionByName(others).hint("rebalance", "bucket")
    else:
        rows = new.hint("rebalance", "bucket").unionByName(others)
    replace_partitions(rows, path, "bucket")
