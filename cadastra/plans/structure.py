"""Queries over outlines, trees, tables and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import hierarchy as H
from cadastra.operators import structure as S
from cadastra.plans.base import query
from cadastra.sources.lineage import written


@query(
    "hierarchy_parent",
    """WITH o AS (SELECT * FROM {d_outline}),
        p AS (SELECT *, max(CASE WHEN level = 2 THEN idx END) OVER w AS l2, max(CASE WHEN level = 3 THEN idx END) OVER w AS l3
              FROM o WINDOW w AS (PARTITION BY document_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT document_id, idx, CASE level WHEN 2 THEN NULL WHEN 3 THEN l2 ELSE greatest(l2, l3) END AS parent_idx FROM p""",
)
def hierarchy_parent(t):
    return S.hierarchy_parent(t.d_outline).select("document_id", "idx", "parent_idx")


@query("hierarchy_full")
def hierarchy_full(t):
    """The trees of all by-laws; golden trees in tests/test_hierarchy.py."""
    return H.hierarchy_full(t.d_bylaws.withColumn("is_boilerplate", F.lit(False)), H.REGIONAL)


_PATHS = """WITH RECURSIVE p(fragment_id, citation_path) AS (
        SELECT fragment_id, citation_label FROM {d_fragments} WHERE parent_fragment_id IS NULL
        UNION ALL
        SELECT f.fragment_id, p.citation_path || ' > ' || f.citation_label FROM d_fragments f JOIN p ON f.parent_fragment_id = p.fragment_id)"""


@query("citation_path", _PATHS + " SELECT fragment_id, citation_path FROM p")
def citation_path(t):
    return S.citation_paths(t.derived("d_fragments").select("fragment_id", "parent_fragment_id", "citation_label")).select("fragment_id", "citation_path")


@query(
    "dup_path_downgrade",
    _PATHS
    + """, c AS (SELECT f.fragment_id, f.document_id, f.parse_status, p.citation_path, count(*) OVER (PARTITION BY f.document_id, p.citation_path) AS n
                 FROM d_fragments f JOIN p ON f.fragment_id = p.fragment_id)
        SELECT fragment_id, CASE WHEN n = 1 THEN citation_path END AS citation_path, CASE WHEN n > 1 THEN 'uncertain' ELSE parse_status END AS parse_status,
               CASE WHEN n > 1 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM c""",
)
def dup_path_downgrade(t):
    f = S.citation_paths(t.derived("d_fragments").select("fragment_id", "parent_fragment_id", "document_id", "citation_label", "parse_status"))
    f = f.select("document_id", "fragment_id", "citation_path", "parse_status", F.lit(0.9).alias("confidence"))
    return S.downgrade_duplicate_paths(f).select("fragment_id", "citation_path", "parse_status", "confidence")


@query(
    "ancestor_chain",
    """WITH RECURSIVE a(fragment_id, ancestor, up) AS (
        SELECT fragment_id, parent_fragment_id, 1 FROM {d_fragments} WHERE parent_fragment_id IS NOT NULL
        UNION ALL
        SELECT a.fragment_id, f.parent_fragment_id, up + 1 FROM a JOIN d_fragments f ON f.fragment_id = a.ancestor WHERE f.parent_fragment_id IS NOT NULL)
        SELECT fragment_id, list(ancestor ORDER BY up DESC) AS ancestors FROM a GROUP BY fragment_id""",
)
def ancestor_chain(t):
    return S.ancestor_chain(t.d_fragments)


@query(
    "fragment_coverage",
    """SELECT document_id, reading_order, 'prose' AS fragment_type, 'uncertain' AS parse_status, 0.4::DOUBLE AS confidence, text
       FROM {d_clauses} WHERE fragment_id % 24 NOT IN (17, 18) AND fragment_id % 5 <> 0""",
)
def fragment_coverage(t):
    blocks = t.d_clauses.select("document_id", "reading_order", F.col("text").alias("raw_text"), (F.col("fragment_id") % 24 == 17).alias("is_boilerplate"), F.when(F.col("fragment_id") % 24 == 18, "footer").otherwise("paragraph").alias("block_type"))
    covered = t.d_clauses.where("fragment_id % 5 = 0").select("document_id", "reading_order")
    return S.uncovered_blocks(blocks, covered)


@query(
    "grouped_tables",
    r"""WITH b AS (SELECT *, reading_order - row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order) AS run
                   FROM {d_blocks} WHERE contains(raw_text, '|')),
        s AS (SELECT *, min(reading_order) OVER (PARTITION BY document_id, page_number, run) AS table_start FROM b),
        c AS (SELECT document_id, page_number, table_start, reading_order - table_start AS row_index, regexp_split_to_array(trim(raw_text), '\s\s+|\s*\|\s*') AS cells FROM s)
        SELECT document_id, page_number, table_start, row_index, unnest(cells) AS text, generate_subscripts(cells, 1) - 1 AS col_index FROM c""",
)
def grouped_tables(t):
    return S.grouped_tables(t.d_blocks.withColumn("block_type", F.when(F.col("raw_text").contains("|"), "table_region").otherwise("paragraph")))


@query(
    "linearize_table",
    """WITH r AS (SELECT table_id, row_index, string_agg(text, ' | ' ORDER BY col_index) AS line FROM {d_cells} GROUP BY table_id, row_index)
       SELECT table_id, string_agg(line, ' ; ' ORDER BY row_index) AS text FROM r GROUP BY table_id""",
)
def linearize_table(t):
    return S.linearize_tables(t.d_cells)


@query(
    "dataframe_cells",
    """SELECT c.table_id, c.row_index, c.col_index, c.text, h.text AS col_header_path, l.text AS row_header_path
       FROM {d_cells} c LEFT JOIN d_cells h ON h.table_id = c.table_id AND h.col_index = c.col_index AND h.row_index = 0
       LEFT JOIN d_cells l ON l.table_id = c.table_id AND l.row_index = c.row_index AND l.col_index = 0
       WHERE c.row_index > 0 AND trim(c.text) <> ''""",
)
def dataframe_cells(t):
    return S.header_cells(t.d_cells)


_REFS = r"""
    SELECT document_id, fragment_id, 'Subject to section ' AS skip, 'section ' || split_part(text, 'section ', 2) AS raw, split_part(text, 'section ', 2) AS target
    FROM {d_fragments} WHERE depth = 5"""


_NUMBER = r"\d+(?:\.\d+){0,5}"
_SECTION = r"(?i)\b(?:section|sections|subsection|subsections)\s+"


def _found(pattern: str, target: str, unless: str = "a^") -> str:
    return f"list_transform(list_filter(regexp_extract_all(text, '{pattern}'), lambda x: NOT regexp_matches(x, '{unless}')), lambda x: {{'raw': x, 'target': {target}}})"


_DETECTED = ", ".join(
    (
        _found(rf"{_SECTION}{_NUMBER}\s+to\s+{_NUMBER}\s+inclusive\b", rf"regexp_replace(x, '^\D+({_NUMBER})\s+to\s+({_NUMBER}).*$', '\1 to \2')"),
        # Without a look ahead: a number that `to` and another number follow is no single section.
        _found(rf"{_SECTION}{_NUMBER}\b(?:\s+to\s+\d)?", rf"regexp_extract(x, '{_NUMBER}')", r"\sto\s+\d$"),
        _found(r"(?i)\bSchedule\s+(?:[A-Z]|\d+)\b", r"'Schedule ' || upper(regexp_extract(x, '\s([A-Za-z]|\d+)$', 1))"),
        _found(rf"(?i)\b(?:provided\s+in|provided\s+by|subject\s+to|except\s+as\s+provided\s+in)\s+{_NUMBER}\b", rf"regexp_extract(x, '{_NUMBER}')"),
    )
)


@query("xref_detect", f"SELECT DISTINCT document_id, fragment_id, r.raw AS raw, r.target AS target FROM (SELECT document_id, fragment_id, unnest(flatten([{_DETECTED}])) AS r FROM {{d_clauses}})")
def xref_detect(t):
    return S.detect_references(t.d_clauses)


@query(
    "xref_resolve",
    rf"""WITH r AS ({_REFS}), l AS (SELECT document_id, citation_label, max_by(fragment_id, reading_order) AS target_fragment_id FROM d_fragments GROUP BY document_id, citation_label)
        SELECT DISTINCT r.document_id, r.fragment_id, raw, target, target_fragment_id, CASE WHEN target_fragment_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status,
               CASE WHEN target_fragment_id IS NULL THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence
        FROM r LEFT JOIN l ON l.document_id = r.document_id AND l.citation_label = r.target""",
)
def xref_resolve(t):
    leaves = t.d_fragments.where("depth = 5")
    return S.resolve_references(S.detect_references(leaves), t.d_fragments)


_FAULTY_REFS = """SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_partkey % 50 = 0 THEN ' ' ELSE concat('section ', CAST(l_suppkey AS STRING)) END AS raw,
    CASE WHEN l_partkey % 3 = 0 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN l_partkey % 7 > 0 THEN l_suppkey END AS target_fragment_id FROM {lineitem}"""


@query(
    "validate_structure",
    f"""WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM {{d_faulty}}), p(fragment_id, citation_path) AS (
        SELECT fragment_id, citation_label FROM f WHERE parent_fragment_id IS NULL
        UNION ALL SELECT f.fragment_id, p.citation_path || ' > ' || f.citation_label FROM f JOIN p ON f.parent_fragment_id = p.fragment_id),
        w(start, cur, n) AS (SELECT fragment_id, parent_fragment_id, 1 FROM f WHERE depth < 4 AND parent_fragment_id IS NOT NULL
            UNION ALL SELECT start, parent_fragment_id, n + 1 FROM w JOIN f ON f.fragment_id = w.cur WHERE parent_fragment_id IS NOT NULL AND n < 6 AND cur <> start),
        d AS (SELECT document_id, citation_path, count(*) AS n, min(f.fragment_id) AS fragment_id FROM f JOIN p USING (fragment_id) GROUP BY document_id, citation_path),
        r AS ({_FAULTY_REFS.replace('STRING', 'VARCHAR')}), t AS (SELECT p_size AS table_id FROM {{part}} WHERE p_size > 2 UNION SELECT 60), c AS (SELECT table_id FROM {{d_tables}})
        SELECT 'unaccounted_block' AS rule, 'error' AS severity, block_id AS object_id FROM {{d_parts}} WHERE NOT is_boilerplate AND block_type <> 'table_region' AND NOT accounted
        UNION ALL SELECT 'missing_parent', 'error', fragment_id FROM f WHERE parent_fragment_id = 0
        UNION ALL SELECT 'odd_root', 'warning', fragment_id FROM f WHERE parent_fragment_id IS NULL AND fragment_type NOT IN ('part', 'section')
        UNION ALL SELECT 'page_range', 'error', fragment_id FROM f WHERE page_end < page_start
        UNION ALL SELECT 'duplicate_path', 'error', fragment_id FROM d WHERE n > 1
        UNION ALL SELECT DISTINCT 'cycle', 'error', start FROM w WHERE cur = start
        UNION ALL SELECT 'orphan_cell', 'error', table_id FROM c WHERE table_id NOT IN (SELECT table_id FROM t)
        UNION ALL SELECT 'table_without_cells', 'warning', table_id FROM t WHERE table_id NOT IN (SELECT table_id FROM c)
        UNION ALL SELECT 'blank_reference', 'error', ref_id FROM r WHERE raw = ' '
        UNION ALL SELECT 'reference_without_target', 'error', ref_id FROM r WHERE status = 'resolved' AND target_fragment_id IS NULL
        UNION ALL SELECT 'beyond_pages', 'error', fragment_id FROM f WHERE page_start < 1 OR page_end > 200""",
)
def validate_structure(t):
    refs = t.spark.sql(_FAULTY_REFS, lineitem=t.lineitem)
    tables = t.part.where("p_size > 2").select(F.col("p_size").alias("table_id")).union(t.spark.sql("SELECT 60")).distinct()
    counts = t.region.select(F.col("r_regionkey").cast("long").alias("document_id"), F.lit(200).alias("page_count"))
    tree = written(t.derived("d_fragments").drop("text", "reading_order"))
    return S.findings(S.citation_paths(t.derived("d_faulty", d_fragments=tree)), t.d_parts, tables, t.d_tables, refs, counts)


@query("tree_cycle_check", "SELECT fragment_id FROM (SELECT o_orderkey AS fragment_id FROM {orders} WHERE o_orderkey % 7 < 3)")
def tree_cycle_check(t):
    # Orders in groups of seven: the first three point at each other in a ring, the rest at the ring.
    k = F.col("o_orderkey")
    parent = F.when(k % 7 == 2, k - 2).when(k % 7 < 2, k + 1).otherwise(k - k % 7)
    top = t.orders.agg(F.max("o_orderkey")).first()[0]
    return S.cycles(t.orders.where(k - k % 7 + 2 <= top).select(k.alias("fragment_id"), parent.alias("parent_fragment_id"))).unionByName(t.orders.where((k - k % 7 + 2 > top) & (k % 7 < 3)).select(k.alias("fragment_id")))


@query(
    "ingest_status",
    """SELECT case_id AS run_id, errors, warnings, CASE WHEN errors > 0 THEN 'failed' WHEN warnings > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status
       FROM (SELECT o_orderkey % 5000 AS case_id, count_if(o_orderkey % 11 = 0) AS errors, count_if(o_orderkey % 4 = 1) AS warnings FROM {orders} GROUP BY ALL)""",
)
def ingest_status(t):
    k = F.col("o_orderkey")
    runs = t.orders.groupBy((k % 5000).alias("run_id")).agg(F.count_if(k % 11 == 0).alias("errors"), F.count_if(k % 4 == 1).alias("warnings"))
    return S.ingest_status(runs)


_RISK = rf"""{_PATHS}, r AS ({_REFS.replace("{d_fragments}", "d_fragments")}),
    k AS (SELECT f.fragment_id, count(*) OVER (PARTITION BY f.document_id, p.citation_path) > 1 AS duplicate FROM d_fragments f JOIN p ON f.fragment_id = p.fragment_id),
    o AS (SELECT fragment_id, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM d_fragments f WHERE f.document_id = r.document_id AND f.citation_label = r.target) GROUP BY fragment_id),
    g AS (SELECT f.*, duplicate, unnest(range(page_start, page_end + 1)) AS page FROM d_fragments f JOIN k USING (fragment_id)),
    a AS (SELECT g.document_id, page, count_if(parse_status = 'uncertain' OR duplicate) AS uncertain, count_if(duplicate) AS duplicates, sum(n)::BIGINT AS unresolved FROM g LEFT JOIN o ON o.fragment_id = g.fragment_id GROUP BY g.document_id, page),
    b AS (SELECT document_id, page, count_if(block_type IN ('table_region', 'footnote')) AS fallback, count_if(NOT is_boilerplate AND block_type <> 'table_region' AND NOT accounted) AS unaccounted FROM {{d_parts}} GROUP BY document_id, page),
    m AS (SELECT table_id % 5 AS document_id, table_id % 40 + 1 AS page, count(DISTINCT table_id) AS tables FROM {{d_tables}} GROUP BY ALL),
    s AS (SELECT document_id, page, coalesce(uncertain, 0) AS uncertain, coalesce(duplicates, 0) AS duplicates, coalesce(tables, 0) AS tables, coalesce(unresolved, 0) AS unresolved, coalesce(fallback, 0) AS fallback, coalesce(unaccounted, 0) AS unaccounted
        FROM a FULL JOIN b USING (document_id, page) FULL JOIN m USING (document_id, page)),
    risk AS (SELECT document_id, page, 3 * uncertain + 4 * duplicates + 2 * tables + unresolved + 5 * unaccounted + CASE WHEN fallback > 0 THEN greatest(1, fallback // 2) ELSE 0 END AS score,
             CASE WHEN uncertain + duplicates + tables + unresolved + fallback + unaccounted = 0 THEN ['low structural risk'] ELSE list_filter([
                CASE WHEN uncertain > 0 THEN uncertain || ' uncertain fragments' END, CASE WHEN duplicates > 0 THEN duplicates || ' duplicate citation path downgrades' END,
                CASE WHEN tables > 0 THEN tables || ' tables present' END, CASE WHEN unresolved > 0 THEN unresolved || ' unresolved cross-references' END,
                CASE WHEN fallback > 0 THEN fallback || ' fallback-sensitive blocks' END, CASE WHEN unaccounted > 0 THEN unaccounted || ' unaccounted non-boilerplate blocks' END], lambda x: x IS NOT NULL) END AS reasons FROM s)"""


def _risk(t):
    f = written(t.derived("d_fragments"))
    refs = S.open_references(f.where("depth = 5"), f)
    paths = S.citation_paths(f.drop("text", "depth", "reading_order")).drop("citation_label")
    downgraded = S.downgrade_duplicate_paths(paths.withColumn("confidence", F.lit(0.9)))
    blocks = t.d_parts.withColumn("fallback", F.col("block_type").isin("table_region", "footnote"))
    tables = t.d_tables.select("table_id").distinct().select((F.col("table_id") % 5).cast("long").alias("document_id"), (F.col("table_id") % 40 + 1).cast("long").alias("page"))
    return S.page_risk(downgraded.withColumn("duplicate", F.col("duplicate_citation_path").isNotNull()), refs, blocks, tables)


@query("page_risk", _RISK + " SELECT document_id, page, CAST(score AS BIGINT) AS score, reasons FROM risk")
def page_risk(t):
    return _risk(t)


@query(
    "audit_sample",
    _RISK + " SELECT document_id, page, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page) AS rank FROM risk) WHERE rank <= 5",
)
def audit_sample(t):
    return S.audit_sample(_risk(t)).select("document_id", "page", "score", "rank")


@query(
    "page_snapshot",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order) AS r FROM {d_blocks})
       SELECT document_id, page_number, count(*) AS n_blocks, string_agg(raw_text, chr(10) ORDER BY reading_order) FILTER (WHERE r <= 40) AS page_text FROM b GROUP BY document_id, page_number""",
)
def page_snapshot(t):
    parts = t.d_blocks.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n_blocks"), F.slice(F.sort_array(F.collect_list(F.struct("reading_order", "raw_text"))), 1, 40).alias("b"))
    return parts.select("document_id", "page_number", "n_blocks", F.array_join(F.transform("b", lambda x: x["raw_text"]), "\n").alias("page_text"))


@query(
    "table_page_ranges",
    """WITH r AS (SELECT document_id, page_start AS s, page_end AS e FROM {d_fragments} WHERE depth = 4),
        m AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
        i AS (SELECT *, sum(CASE WHEN s > coalesce(before + 1, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT document_id, min(s) AS "start", max(e) AS "end" FROM i GROUP BY document_id, island""",
)
def table_page_ranges(t):
    r = t.d_fragments.where("depth = 4").select("document_id", F.col("page_start").alias("start"), F.col("page_end").alias("end"))
    return S.merge_ranges(r)


@query(
    "snk_summary",
    """WITH b AS (SELECT document_id, count(*) AS blocks FROM {d_blocks} GROUP BY 1), f AS (SELECT document_id, count(*) AS fragments FROM {d_clauses} GROUP BY 1),
        r AS (SELECT document_id, count(*) AS refs FROM {d_fragments} WHERE depth = 5 GROUP BY 1)
        SELECT document_id, coalesce(blocks, 0) AS blocks, coalesce(fragments, 0) AS fragments, coalesce(refs, 0) AS refs
        FROM b FULL JOIN f USING (document_id) FULL JOIN r USING (document_id)""",
)
def snk_summary(t):
    return S.document_summary(t.d_blocks, t.d_clauses, t.d_fragments.where("depth = 5"))


@query("snk_export_document")
def snk_export_document(t):
    return S.export_documents(t.d_blocks)


@query(
    "document_outline",
    """SELECT document_id, fragment_id, rank, text FROM (SELECT document_id, fragment_id, row_number() OVER (PARTITION BY document_id ORDER BY depth, reading_order, fragment_id) AS rank,
              CASE WHEN length(text) > 20 THEN rtrim(text[1:19]) || '...' ELSE text END AS text FROM {d_fragments}) WHERE rank <= 250""",
)
def document_outline(t):
    return S.document_outline(t.d_fragments, width=20).select("document_id", "fragment_id", "rank", "text")


@query(
    "image_caption_link",
    """WITH i AS (SELECT p_partkey AS image_id, p_partkey % 5 AS document_id, p_partkey % 200 + 1 AS page_number FROM {part})
        SELECT image_id, i.document_id, page_number, min(f.fragment_id) AS fragment_id FROM i
        LEFT JOIN (SELECT * FROM {d_fragments} WHERE depth = 4) f ON f.document_id = i.document_id AND page_number BETWEEN page_start AND page_end GROUP BY ALL""",
)
def image_caption_link(t):
    images = t.part.select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 5).alias("document_id"), (F.col("p_partkey") % 200 + 1).alias("page_number"))
    return S.image_captions(images, t.d_fragments.where("depth = 4")).select("image_id", "document_id", "page_number", "fragment_id")


