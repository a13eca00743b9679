"""Sources and sinks over files that Spark writes out of the given tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.plans.base import query
from cadastra.sources import files
from cadastra.sources.lineage import shared_path


@query(
    "snk_replace_document",
    """SELECT document_id, reading_order, CASE WHEN document_id % 7 = 3 THEN 'v2 ' || raw_text ELSE raw_text END AS raw_text
       FROM {d_blocks} WHERE document_id % 7 <> 3 OR reading_order % 2 = 0
       UNION ALL SELECT doc_id + 100000000, 0, 'new' FROM {documents} WHERE doc_id % 50 = 0""",
)
def snk_replace_document(t):
    """Blocks written once; then every seventh document with fewer and changed blocks and some new documents, twice."""
    path = shared_path(t.spark, "replaced")
    blocks = t.d_blocks.select("document_id", "reading_order", "raw_text")
    files.replace_documents(blocks, path)
    changed = blocks.where("document_id % 7 = 3 and reading_order % 2 = 0").withColumn("raw_text", F.concat(F.lit("v2 "), "raw_text"))
    added = t.documents.where("doc_id % 50 = 0").select((F.col("doc_id") + 100000000).alias("document_id"), F.lit(0).cast("long").alias("reading_order"), F.lit("new").alias("raw_text"))
    gone = blocks.where("document_id % 7 = 3").select("document_id").distinct().join(changed.select("document_id").distinct(), "document_id", "left_anti")
    # A document that lost all its blocks is replaced by nothing: its rows go with a marker that is left out when reading.
    empty = gone.select("document_id", F.lit(-1).cast("long").alias("reading_order"), F.lit(None).cast("string").alias("raw_text"))
    for _ in range(2):
        files.replace_documents(changed.unionByName(added).unionByName(empty), path)
    return t.spark.read.parquet(path).where("reading_order >= 0").select("document_id", "reading_order", "raw_text")


@query("snk_trace_append", "SELECT event_id AS run_id, user_id, event_type, strftime(ts::TIMESTAMP, '%Y-%m-%d') AS run_date FROM {events}")
def snk_trace_append(t):
    """A log of runs by date: even ids first, then all of them twice; every run is there once."""
    path = shared_path(t.spark, "trace")
    runs = t.events.select(F.col("event_id").alias("run_id"), "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("run_date"))
    for part in (runs.where("run_id % 2 = 0"), runs, runs):
        files.append_runs(part, path)
    return t.spark.read.schema(runs.schema).parquet(path).select("run_id", "user_id", "event_type", "run_date")


def _collections(t):
    """GeoJSON collections of a hundred customers, one on each line: some features lack a key or a geometry, some keys come twice."""
    path = shared_path(t.spark, "geojson")
    k = F.col("c_custkey")
    key = F.when(k % 11 == 0, " ").when(k % 13 == 0, F.concat(F.lit("lot "), (k - k % 13 + 1).cast("string"))).otherwise(F.concat(F.lit("lot "), k.cast("string")))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.lit(-63.6) + k * 0.0001, F.lit(44.6)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(key.alias("ID"), F.col("c_mktsegment").alias("SEGMENT"), F.floor(k / 100).cast("string").alias("SET")).alias("properties"), F.when(k % 17 != 0, point).alias("geometry"))
    grouped = t.customer.groupBy(F.floor(k / 100).alias("s")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), feature.alias("f")))).alias("h"))
    crs = F.struct(F.struct(F.lit("urn:ogc:def:crs:OGC:1.3:CRS84").alias("name")).alias("properties"))
    grouped.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), F.transform("h", lambda x: x["f"]).alias("features")))).write.text(path)
    raw = files.read_geojson(t.spark, path, lines=True)
    return raw.withColumn("set", F.col("properties.SET"))


_FEATURES = """SELECT c_custkey, CAST(floor(c_custkey / 100) AS BIGINT)::VARCHAR AS set, row_number() OVER (PARTITION BY floor(c_custkey / 100) ORDER BY c_custkey) - 1 AS idx, c_mktsegment AS segment, c_custkey % 17 = 0 AS bare,
        CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'lot ' || (c_custkey - c_custkey % 13 + 1) ELSE 'lot ' || c_custkey END AS feature_key FROM {customer}"""
_JUDGED = f"SELECT *, CASE WHEN bare THEN 'no geometry' WHEN feature_key IS NULL THEN 'no key' WHEN row_number() OVER (PARTITION BY set, feature_key ORDER BY idx) > 1 THEN 'duplicate key' END AS warning FROM ({_FEATURES})"


@query("src_geojson", f"SELECT set, idx::INT AS idx, feature_key, segment, NOT bare AS has_geometry FROM ({_FEATURES})")
def src_geojson(t):
    key = F.nullif(F.trim(F.col("properties.ID")), F.lit(""))
    return _collections(t).select("set", "idx", key.alias("feature_key"), F.col("properties.SEGMENT").alias("segment"), F.col("geometry").isNotNull().alias("has_geometry"))


@query("src_geojson_clean", f"SELECT set, idx::INT AS idx, feature_key, coalesce(warning, 'kept') AS outcome FROM ({_JUDGED})")
def src_geojson_clean(t):
    good, bad = files.clean_features(_collections(t), "ID", within=("set",))
    return good.select("set", "idx", "feature_key", F.lit("kept").alias("outcome")).unionByName(bad.select("set", "idx", "feature_key", F.col("warning").alias("outcome")))


@query(
    "src_dataset_version",
    "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM {documents} WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)",
)
def src_dataset_version(t):
    """Payloads whose content no known version has: a third of the documents is known."""
    payloads = files.file_identity(t.documents.select("doc_id", F.lit("a.txt").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))
    return files.changed_files(payloads, payloads.where("doc_id % 3 = 0").select("sha256").distinct()).select("doc_id", "sha256")


@query(
    "src_ingest_dir",
    """WITH f AS (SELECT doc_id, coalesce(text, '') || chr(10) AS text, CASE WHEN doc_id % 10 = 3 THEN 'unsupported suffix csv' WHEN doc_id % 7 = 5 THEN 'not UTF-8' WHEN NOT regexp_matches(coalesce(text, ''), '\\S') THEN 'empty' END AS reason FROM {documents})
       SELECT doc_id, CASE WHEN reason IS NULL THEN 'ingested' WHEN doc_id % 10 = 3 THEN 'skipped' ELSE 'failed' END AS status, reason,
           CASE WHEN reason IS NULL THEN sha256(text) END AS sha256, CASE WHEN reason IS NULL THEN len(string_split(text, chr(10))) - 1 END AS n_lines FROM f""",
)
def src_ingest_dir(t):
    """A file for each document: some of another kind, some with bytes that are no text; all have an outcome."""
    path = shared_path(t.spark, "inbox")
    k = F.col("doc_id")
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFFE"))).cast("string")
    files.write_each(docs.where(k % 10 == 3), f"{path}/tables", "doc_id", "csv", nested=False)
    files.write_each(docs.where(k % 10 != 3).withColumn("text", F.when(k % 7 == 5, broken).otherwise(F.col("text"))), f"{path}/texts", "doc_id", "text", nested=False)
    found = files.ingest_outcomes(t.spark, path).where("path not like '%/\\_SUCCESS'")
    whole = F.col("status") == "ingested"
    return found.select(F.regexp_extract("path", r"doc_id=(\d+)[/.]", 1).cast("long").alias("doc_id"), "status", "reason", F.when(whole, F.col("sha256")).alias("sha256"), F.when(whole, F.size(F.split("text", "\n")).cast("long") - 1).alias("n_lines"))
