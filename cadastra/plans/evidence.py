"""Queries of evidence assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import evidence as E
from cadastra.operators import geo as G
from cadastra.operators import semantic as S
from cadastra.operators.structure import ancestor_chain, detect_references
from cadastra.plans.base import query
from cadastra.plans.geo import _LINK, _linked
from cadastra.plans.retrieval import _SEEDS, _TERMS, _TOKENS, _seeds
from cadastra.plans.structure import _REFS
from cadastra.sources.lineage import written


def _blocks(t):
    text = F.when(F.col("fragment_id") % 24 == 17, "hr-1 zone").when(F.col("fragment_id") % 24 == 18, "Built form and siting requirements within the COR zone").otherwise(F.col("text"))
    return t.d_clauses.select("document_id", "page_number", text.alias("text"))


_ZONE_PAGES = r"""b AS (SELECT document_id, page_number, CASE fragment_id % 24 WHEN 17 THEN 'HR-1 ZONE' WHEN 18 THEN 'BUILT FORM AND SITING REQUIREMENTS WITHIN THE COR ZONE' ELSE upper(text) END AS t FROM {d_clauses}),
        n AS (SELECT DISTINCT document_id, z AS zone, CASE WHEN t = z || ' ZONE' THEN 1 WHEN contains(t, 'BUILT FORM AND SITING') THEN 2 ELSE 3 END AS tier, page_number
              FROM b, (SELECT unnest(['HR-1', 'COR', 'CEN-2', 'DD']) AS z) WHERE regexp_matches(t, '\b' || z || '\b')),
        z AS (SELECT document_id, zone, tier, page_number FROM n WHERE tier = (SELECT min(tier) FROM n m WHERE m.document_id = n.document_id AND m.zone = n.zone))"""


def _zone_pages(t):
    zones = t.spark.createDataFrame([(z,) for z in ("HR-1", "COR", "CEN-2", "DD")], "zone string")
    return E.zone_pages(zones, _blocks(t))


@query("zone_pages", f"WITH {_ZONE_PAGES} SELECT * FROM z")
def zone_pages(t):
    return _zone_pages(t)


@query(
    "zone_context",
    f"""WITH {_ZONE_PAGES}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, zone ORDER BY page_number) AS r FROM z) WHERE r <= 3),
        near AS (SELECT DISTINCT document_id, zone, unnest(range(page_number, page_number + 3)) AS page_number FROM top)
        SELECT document_id, zone, fragment_id AS source_fragment_id FROM near JOIN d_clauses USING (document_id, page_number)""",
)
def zone_context(t):
    return E.near_pages(_zone_pages(t)).join(t.d_clauses, ["document_id", "page_number"]).select("document_id", "zone", F.col("fragment_id").alias("source_fragment_id"))


# Cells, captions and notes of tables of permitted uses, for both engines: numbered conditions are circled markers, as in the notes to them.
_CIRCLED = "translate(substr(text, 2, 1), '123456789', '①②③④⑤⑥⑦⑧⑨')"
_PERMISSION_CELLS = f"SELECT table_id, row_index, col_index, CASE WHEN text LIKE '[_]' THEN {_CIRCLED} ELSE text END AS text FROM {{d_matrix}}"
_PERMISSION_TABLES = """SELECT DISTINCT table_id, table_id AS document_id, CASE table_id % 3 WHEN 0 THEN 'Table 1A: Permitted uses by zone' WHEN 1 THEN 'TABLE 1B: Permitted uses by zone (continued)' ELSE 'Table 1C: permitted Uses by Zone' END AS caption FROM {d_matrix}"""
_PERMISSION_NOTES = f"""SELECT document_id, fragment_id, fragment_id % 60 + 1 AS page_start, CASE WHEN text LIKE '[_] %' AND text NOT LIKE '[0]%' THEN concat({_CIRCLED}, CASE fragment_id % 2 WHEN 0 THEN ' Use is permitted; ' ELSE ' use is permitted: ' END, substr(text, 5)) ELSE text END AS text FROM {{d_conditions}}"""


@query(
    "permission_table_lookup",
    f"""WITH q AS (SELECT c_custkey AS question_id, 'red widget' AS use, CASE c_custkey % 4 WHEN 0 THEN 'DD' WHEN 1 THEN 'CEN-2' WHEN 2 THEN 'HR-1' END AS zone FROM {{customer}} WHERE c_custkey % 50 < 4),
        cell AS MATERIALIZED ({_PERMISSION_CELLS}), tab AS MATERIALIZED (SELECT * FROM ({_PERMISSION_TABLES}) WHERE caption ILIKE '{E.PERMISSION_CAPTION}'),
        note AS MATERIALIZED (SELECT document_id, marker, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id, marker ORDER BY page_start, fragment_id) AS r
            FROM (SELECT *, substr(text, 1, 1) AS marker FROM ({_PERMISSION_NOTES})) WHERE page_start BETWEEN 45 AND 56 AND text ILIKE '_ Use is permitted%') WHERE r = 1),
        v AS (SELECT question_id, r.table_id, r.row_index, r.text AS label, b.col_index, h.text || '=' || b.text AS v, b.text AS m
              FROM q JOIN cell r ON r.row_index > 0 AND r.col_index = 0 AND starts_with(lower(r.text), q.use)
              JOIN cell b ON b.table_id = r.table_id AND b.row_index = r.row_index AND b.col_index > 0
              JOIN cell h ON h.table_id = r.table_id AND h.row_index = 0 AND h.col_index = b.col_index
              WHERE zone IS NULL OR contains(regexp_replace(upper(h.text), '[- ]', '', 'g'), regexp_replace(upper(zone), '[- ]', '', 'g'))),
        s AS (SELECT question_id, table_id, row_index, label, coalesce(string_agg(v, '; ' ORDER BY col_index) FILTER (WHERE m <> ''), '') AS said FROM v GROUP BY question_id, table_id, row_index, label),
        f AS (SELECT table_id, row_index, said, string_agg(note.text, ' ' ORDER BY marker) AS cited
              FROM (SELECT DISTINCT table_id, row_index, said, unnest(regexp_extract_all(said, '{E.MARKER}')) AS marker FROM (SELECT DISTINCT table_id, row_index, said FROM s)) JOIN tab USING (table_id) JOIN note USING (document_id, marker) GROUP BY ALL)
        SELECT question_id, table_id, row_index, caption || '. ' || label || ': ' || said || '. {E.LEGEND}' || coalesce(' Applicable footnotes: ' || cited, '') AS text
        FROM s JOIN tab USING (table_id) LEFT JOIN f USING (table_id, row_index, said)""",
)
def permission_table_lookup(t):
    k = F.col("c_custkey")
    calls = t.customer.where(k % 50 < 4).select(k.alias("question_id"), F.lit("red widget").alias("use"), F.when(k % 4 == 0, "DD").when(k % 4 == 1, "CEN-2").when(k % 4 == 2, "HR-1").alias("zone"))
    cells, tables, notes = (t.spark.sql(text, d_matrix=t.d_matrix, d_conditions=t.d_conditions) for text in (_PERMISSION_CELLS, _PERMISSION_TABLES, _PERMISSION_NOTES))
    return E.permission_rows(calls, cells, tables, notes)


@query(
    "expand_dataset",
    _LINK
    + """, c AS (SELECT DISTINCT o_custkey % 40 AS question_id, 4000000000000 + o_orderkey AS id FROM {orders} WHERE o_orderkey % 10 = 3)
        SELECT question_id, dataset_id AS external_dataset_id, min(id) AS source_fragment_id, 0.55::DOUBLE AS base_score FROM c JOIN s ON s.fragment_id = c.id GROUP BY question_id, dataset_id""",
)
def expand_dataset(t):
    return E.expand_datasets(_seeds(t), _linked(t))


@query(
    "expand_spatial",
    """WITH l AS (SELECT feature_id AS question_id, dataset, x0 - 0.0005 AS x0, y0 - 0.0005 AS y0, x1 + 0.0004 AS x1, y1 + 0.0004 AS y1 FROM {d_parcels} WHERE feature_id % 20 = 3)
       SELECT l.question_id, l.dataset, p.feature_id, CASE WHEN l.x0 <= p.x0 AND l.y0 <= p.y0 AND l.x1 >= p.x1 AND l.y1 >= p.y1 THEN 0.7 + 0.1 ELSE 0.7 END::DOUBLE AS base_score
       FROM l JOIN d_parcels p ON p.dataset = l.dataset AND least(l.x1, p.x1) - greatest(l.x0, p.x0) > 1e-12 AND least(l.y1, p.y1) - greatest(l.y0, p.y0) > 1e-12""",
)
def expand_spatial(t):
    p = t.d_parcels.where("feature_id % 20 = 3")
    box = [(F.col("x0") - 0.0005).alias("x0"), (F.col("y0") - 0.0005).alias("y0"), (F.col("x1") + 0.0004).alias("x1"), (F.col("y1") + 0.0004).alias("y1")]
    locations = p.select(F.col("feature_id").alias("question_id"), *box)
    return E.expand_spatial(p.select(F.col("feature_id").alias("question_id"), "dataset"), locations, t.d_parcels.select("feature_id", "dataset", "x0", "y0", "x1", "y1"))


@query(
    "resolve_section_ref",
    """WITH r AS (SELECT s_suppkey AS ref_id, s_suppkey % 5 AS document_id, 'Section  ' || (s_suppkey % 25) || '.' || (s_suppkey * 7) AS ref, (s_suppkey % 25) || '.' || (s_suppkey * 7) AS label FROM {supplier}
                   UNION ALL SELECT 100000 + s_suppkey, s_suppkey % 5, 'clause (' || (s_suppkey % 6) || ')', '(' || (s_suppkey % 6) || ')' FROM {supplier}),
        m AS (SELECT ref_id, fragment_id, row_number() OVER (PARTITION BY ref_id ORDER BY page_start, fragment_id) AS rank FROM r JOIN {d_fragments} f ON f.document_id = r.document_id AND f.citation_label = r.label)
        SELECT ref_id, fragment_id, rank FROM m WHERE rank <= 3""",
)
def resolve_section_ref(t):
    k = F.col("s_suppkey")
    a = t.supplier.select(k.alias("ref_id"), (k % 5).alias("document_id"), F.concat(F.lit("Section  "), (k % 25).cast("string"), F.lit("."), (k * 7).cast("string")).alias("ref"))
    b = t.supplier.select((k + 100000).alias("ref_id"), (k % 5).alias("document_id"), F.concat(F.lit("clause ("), (k % 6).cast("string"), F.lit(")")).alias("ref"))
    return E.resolve_section_refs(a.unionByName(b), t.d_fragments)


@query(
    "get_definitions",
    r"""WITH d AS (SELECT fragment_id, lower(regexp_extract(text, '(?i)^"?(lot \d+)"? means', 1)) AS term FROM {d_definitions} WHERE regexp_matches(text, '(?i)^"?lot \d+"? means ')),
        q AS (SELECT s_suppkey AS question_id, 'lot ' || (s_suppkey % 40) AS asked FROM {supplier})
        SELECT question_id, fragment_id AS source_fragment_id, CASE WHEN term = asked THEN 3 ELSE 2 END::DOUBLE AS base_score FROM q JOIN d ON starts_with(term, asked)""",
)
def get_definitions(t):
    calls = t.supplier.select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("Lot "), (F.col("s_suppkey") % 40).cast("string")).alias("term"))
    return E.definitions(calls, S.defined_terms(t.d_definitions))


@query(
    "get_section",
    "SELECT s_suppkey AS question_id, min(fragment_id) AS source_fragment_id, count(*) AS n FROM {supplier} JOIN {d_fragments} ON document_id = s_suppkey % 5 AND citation_label = '(' || (s_suppkey % 9) || ')' GROUP BY s_suppkey",
)
def get_section(t):
    k = F.col("s_suppkey")
    calls = t.supplier.select(k.alias("question_id"), (k % 5).alias("document_id"), F.concat(F.lit("("), (k % 9).cast("string"), F.lit(")")).alias("citation_label"))
    return E.sections(calls, t.d_fragments)


@query(
    "slot_reference",
    """SELECT c_custkey AS question_id, CASE c_custkey % 5 WHEN 0 THEN 'parcel_id' WHEN 1 THEN 'civic_address' WHEN 2 THEN 'named_place' WHEN 3 THEN 'intersection' END AS kind,
        CASE c_custkey % 5 WHEN 0 THEN 'PID ' || c_custkey WHEN 1 THEN c_custkey || ' South Park' WHEN 2 THEN c_name WHEN 3 THEN 'Agricola and ' || c_mktsegment END AS text FROM {customer}""",
)
def slot_reference(t):
    k = F.col("c_custkey")
    is_ = lambda n, c: F.when(k % 5 == n, c)
    slot = F.struct(is_(0, k.cast("string")).alias("parcel_id"), is_(1, k.cast("string")).alias("civic_number"), is_(1, F.lit("South Park")).alias("street"), is_(2, F.col("c_name")).alias("named_place"), is_(3, F.array(F.lit("Agricola"), "c_mktsegment")).alias("intersection"))
    return t.customer.select(k.alias("question_id"), slot.alias("slot")).select("question_id", E.slot_reference(F.col("slot")).alias("r")).select("question_id", "r.kind", "r.text")


@query(
    "response_notes",
    """SELECT question_id, CASE WHEN question_id % 3 > 0 AND question_id % 8 = 2 THEN ['The query contains a parcel id but no location was given.']
        WHEN question_id % 3 > 0 AND question_id % 8 IN (1, 6) THEN ['The query contains a civic address but no location was given.']
        WHEN question_id % 3 = 0 AND question_id % 2 = 1 THEN ['The location was not resolved (unknown reason).'] ELSE [] END AS notes FROM {d_requests}""",
)
def response_notes(t):
    k = F.col("question_id")
    return E.response_notes(t.d_requests.select("*", (k % 3 == 0).alias("has_slot"), (k % 2 == 0).alias("resolved"), F.lit(None).cast("string").alias("detail")))


@query(
    "linked_datasets",
    _LINK + f""", c AS ({_SEEDS}), m AS (SELECT fragment_id, count(*) AS n FROM s WHERE fragment_id IS NOT NULL GROUP BY 1)
        SELECT question_id, source_fragment_id, coalesce(n, 0)::INT AS n_datasets FROM c LEFT JOIN m ON fragment_id = source_fragment_id""",
)
def linked_datasets(t):
    data = _linked(t).withColumn("dataset", F.when(F.col("dataset_id") % 2 == 0, "BUILDING").otherwise("MACHINERY"))
    return E.linked_datasets(_seeds(t), data, G.dataset_summary(t.d_parcels)).select("question_id", "source_fragment_id", F.size("datasets").alias("n_datasets"))


def _leaf_seeds(t):
    """The seeds, and for each supplier a leaf of the tree."""
    leaf = F.min(F.col("l_orderkey") * 1000 + 1 + 5000000000000).alias("source_fragment_id")
    return _seeds(t).unionByName(t.lineitem.groupBy(F.col("l_suppkey").alias("question_id")).agg(leaf, F.lit(1.0).alias("base_score")))


@query(
    "build_match",
    f"""WITH c AS ({_SEEDS} UNION ALL SELECT l_suppkey, min(5000000000000 + l_orderkey * 1000 + 1), 1.0 FROM {{lineitem}} GROUP BY l_suppkey), r AS ({_REFS}), g AS (SELECT fragment_id, list_sort(list(DISTINCT target)) AS refs FROM r GROUP BY 1)
        SELECT question_id, source_fragment_id, citation_label, depth - 1 AS depth, refs AS "references" FROM c JOIN d_fragments f ON f.fragment_id = source_fragment_id LEFT JOIN g USING (fragment_id)""",
)
def build_match(t):
    hits = written(_leaf_seeds(t))
    # Only fragments that a hit names need their ancestors and references.
    of = hits.select(F.col("source_fragment_id").alias("fragment_id")).distinct()
    refs = detect_references(t.d_fragments.where("depth = 5").join(of, "fragment_id", "left_semi"))
    out = E.build_match(hits, t.d_fragments, ancestor_chain(t.d_fragments, of), refs)
    return out.select("question_id", "source_fragment_id", "citation_label", F.size("ancestors").alias("depth"), "references")


@query(
    "coverage_checks",
    """WITH h AS (SELECT c_custkey AS address_id, c_acctbal / 50 AS height_m, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS storeys, c_custkey % 7 <> 0 AS zoned, c_custkey % 5 = 0 AS found, c_custkey % 4 = 0 AS heritage FROM {customer})
       SELECT address_id, coalesce(nullif(concat_ws(' ; ', CASE WHEN NOT zoned THEN 'FAIL[A]: no zone match' END, CASE WHEN height_m NOT BETWEEN 8 AND 145 THEN 'FAIL[B]: height out of range' END,
            CASE WHEN storeys NOT BETWEEN 3 AND 40 THEN 'FAIL[B]: storeys out of range' END, CASE WHEN storeys IS NOT NULL THEN 'FAIL[A]: both height and storeys set' END,
            CASE WHEN NOT heritage AND found THEN 'FAIL[D]: unexpected heritage match' END, CASE WHEN heritage AND NOT found THEN 'WARN[D]: no heritage match' END), ''), 'PASS') AS verdict FROM h""",
)
def coverage_checks(t):
    k = F.col("c_custkey")
    none = F.lit(None)
    layer = lambda name, zone, height, storeys: t.customer.select(k.alias("address_id"), F.lit(name).alias("layer"), zone.cast("string").alias("zone"), height.cast("double").alias("height_m"), storeys.cast("int").alias("storeys"))
    zones = layer("zone", F.lit("DD"), none, none).where("address_id % 7 <> 0")
    heights = layer("height", none, F.col("c_acctbal") / 50, F.when(k % 3 == 0, F.col("c_nationkey")))
    heritage = layer("heritage", none, none, none).where("address_id % 5 = 0")
    return E.coverage_verdicts(t.customer.select(k.alias("address_id"), (k % 4 == 0).alias("heritage")), zones.unionByName(heights).unionByName(heritage))


_RULES = (("(?i)maximum building height", 1.0), ("(?i)^schedule", 0.5))


@query(
    "search_context",
    f"""WITH q AS (SELECT question_id, unnest({_TERMS}) AS term, len({_TERMS}) AS n FROM {{d_requests}}),
        d AS (SELECT fragment_id, unnest({_TOKENS}) AS term FROM {{d_clauses}}),
        h AS (SELECT question_id, fragment_id, count(*) / any_value(n) AS share FROM d JOIN q USING (term) GROUP BY question_id, fragment_id),
        s AS (SELECT question_id, fragment_id AS source_fragment_id, share + {" + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {v}::DOUBLE ELSE 0 END" for p, v in _RULES)} AS base_score FROM h JOIN d_clauses USING (fragment_id))
        SELECT question_id, source_fragment_id, base_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY base_score DESC, source_fragment_id) AS rank FROM s) WHERE rank <= 8""",
)
def search_context(t):
    return E.search_context(t.d_requests, t.d_clauses, _RULES).select("question_id", "source_fragment_id", "base_score", "rank")


@query("trace_lookup", "SELECT run_id, count(*) AS n, max(base_score) AS best FROM (SELECT question_id AS run_id, base_score FROM {d_candidates}) WHERE run_id IN (SELECT s_suppkey FROM {supplier}) GROUP BY run_id")
def trace_lookup(t):
    trace = t.d_candidates.select(F.col("question_id").alias("run_id"), "base_score")
    return trace.join(t.supplier.select(F.col("s_suppkey").alias("run_id")), "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("base_score").alias("best"))
