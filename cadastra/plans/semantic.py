"""Queries of semantic extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import semantic as S
from cadastra.operators.structure import detect_references, resolve_references
from cadastra.plans.base import query
from cadastra.plans.questions import contexts_in, normal_use, standards_in, zones_in


def _one(name, f, column, sql=None):
    @query(name, sql)
    def run(t):
        return t.d_clauses.select("fragment_id", f(F.col("text")).alias(column))

    return run


_USES = f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{S.USE.replace(chr(39), chr(39) * 2)}', 1), lambda u: {normal_use('u')}), lambda u: u NOT IN ('land use', 'permitted use'))))"
_MARKERS = r"list_sort(list_distinct(regexp_extract_all(text, '\[\d+\]')))"
_TABLE_REFS = r"list_transform(regexp_extract_all(text, 'Table \d+[A-Z]?'), lambda x: 'Table ' || upper(x[7:7]) || lower(x[8:]))"
_SECTION_REFS = r"list_sort(list_distinct(regexp_extract_all(text, '(?i)\b(?:Section|Subsection|Schedule)\s+[A-Za-z0-9.\-()]+\b')))"
_VALUES = r"list_sort(list_distinct(regexp_extract_all(text, '(?i)\b\d+(?:\.\d+)?\s*(?:m2|metres?|meters?|feet|ft|sq\.?\s*ft|square feet)\b')))"

_one("extract_zones", S.extract_zones, "zones", f"SELECT fragment_id, {zones_in('text')} AS zones FROM {{d_clauses}}")
_one("extract_uses", S.extract_uses, "uses", f"SELECT fragment_id, {_USES} AS uses FROM {{d_clauses}}")
_one("extract_contexts", S.extract_contexts, "contexts", f"SELECT fragment_id, {contexts_in('text')} AS contexts FROM {{d_clauses}}")
_one("extract_condition_refs", S.extract_condition_refs, "markers", f"SELECT fragment_id, {_MARKERS} AS markers FROM {{d_clauses}}")
_one("extract_table_refs", S.extract_table_refs, "refs", f"SELECT fragment_id, {_TABLE_REFS} AS refs FROM {{d_clauses}}")
_one("extract_section_refs", S.extract_section_refs, "refs", f"SELECT fragment_id, {_SECTION_REFS} AS refs FROM {{d_clauses}}")
_one("extract_values", S.extract_values, "vals", f"SELECT fragment_id, {_VALUES} AS vals FROM {{d_clauses}}")
_one("extract_standards", S.extract_standards, "standards", f"SELECT fragment_id, {standards_in('text')} AS standards FROM {{d_clauses}}")


@query("normalize_zone", "SELECT p_partkey, 'HR-' || (p_size % 3) AS zone FROM {part}")
def normalize_zone(t):
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "hr ").otherwise("HR"), (F.col("p_size") % 3).cast("string"))
    return t.part.select("p_partkey", S.normalize_zone(raw).alias("zone"))


@query("use_label", "SELECT c_custkey, c_custkey % 3 <> 0 AS is_use FROM {customer}")
def use_label(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", S.use_label(F.when(k % 3 == 0, "Height of a building").when(k % 3 == 1, "Retail  use.").otherwise("Secondary suite;")).alias("is_use"))


_MENTION = ", ".join(
    f"list_transform({names}, lambda n: {{'entity_type': '{kind}', 'name': n}})"
    for kind, names in {"zone": zones_in("text"), "use": _USES, "standard": standards_in("text"), "condition": _MARKERS, "table": _TABLE_REFS, "section": _SECTION_REFS, "value": _VALUES, "context": contexts_in("text")}.items()
)
_MENTIONS = f"SELECT document_id, fragment_id, m.entity_type AS entity_type, m.name AS name FROM (SELECT document_id, fragment_id, unnest(flatten([{_MENTION}])) AS m FROM {{d_clauses}})"


@query("entity_mentions", _MENTIONS)
def entity_mentions(t):
    return S.entity_mentions(t.d_clauses)


@query("entity_dedupe", f"SELECT document_id, entity_type, lower(name) AS key, min(fragment_id) AS source_fragment_id, arg_min(name, fragment_id) AS name, count(*) AS mentions FROM ({_MENTIONS}) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY document_id, entity_type, lower(name)"))
def entity_dedupe(t):
    return S.entity_dedupe(S.entity_mentions(t.d_clauses)).drop("entity_id")


_DEFINED = f"regexp_matches(text, '{S.DEFINITION.replace(chr(39), chr(39) * 2)}')"
_PART = lambda n: f"regexp_extract(text, '{S.DEFINITION.replace(chr(39), chr(39) * 2)}', {n})"


@query("definition_fact", f"SELECT document_id, fragment_id, {normal_use(_PART(1))} AS term, trim({_PART(2)}) AS meaning FROM {{d_definitions}} WHERE {_DEFINED}")
def definition_fact(t):
    return S.definition_facts(t.d_definitions)


@query("condition_fact", f"SELECT document_id, fragment_id, unnest({_MARKERS}) AS marker, {_SECTION_REFS} AS section_refs FROM {{d_clauses}}")
def condition_fact(t):
    return S.condition_facts(t.d_clauses)


_READ = rf"""c AS MATERIALIZED (SELECT *, {zones_in('label')}[1] AS z, {standards_in('label')}[1] AS s, {contexts_in('label')} AS xs FROM (
        SELECT table_id, row_index, col_index, trim(regexp_replace(text, '\s+', ' ', 'g')) AS label, col_index = min(col_index) OVER (PARTITION BY table_id, row_index) AS head FROM {{d_tables}})),
    r AS (SELECT table_id, row_index, count_if(z IS NOT NULL OR s IS NOT NULL OR len(xs) > 0) AS hits, count(*) AS n, max(CASE WHEN head THEN label END) AS row_label,
            count_if(NOT head AND z IS NOT NULL) / greatest(count_if(NOT head), 1) AS zone_share FROM c GROUP BY ALL),
    h AS (SELECT table_id, arg_max(row_index, hits * 1000000 - row_index) AS header_row, count(*) AS n_rows, max(n) AS widest FROM r GROUP BY table_id)"""
_IS_USE = f"regexp_matches({normal_use('label')}, ' (use|dwelling|facility|establishment|suite|unit)$')"
_PROFILED = rf"""{_READ},
    l AS (SELECT c.*, header_row, n_rows, widest FROM c JOIN h USING (table_id)),
    b AS (SELECT table_id, label, z, s, xs, 'header' AS part, head FROM l WHERE row_index = header_row UNION ALL SELECT table_id, label, z, s, xs, 'row', head FROM l WHERE head AND row_index > 0),
    d AS (SELECT table_id, count_if(part = 'header' AND z IS NOT NULL) / greatest(count_if(part = 'header'), 1) AS zones, count_if(part = 'row' AND {_IS_USE}) / greatest(count_if(part = 'row'), 1) AS uses,
            count_if(s IS NOT NULL) / count(*) AS standards, count_if(len(xs) > 0) / count(*) AS contexts, bool_or(contains(lower(label), 'parking')) AS parking, bool_or(part = 'row' AND z IS NOT NULL) AS zone_rows FROM b GROUP BY table_id),
    p AS (SELECT table_id, CASE WHEN zones >= 0.4 AND uses >= 0.35 AND NOT parking THEN 'permission_matrix' WHEN parking AND (zones >= 0.2 OR standards >= 0.2) THEN 'parking_matrix'
            WHEN standards >= 0.2 AND contexts >= 0.1 THEN 'requirement_matrix' WHEN standards >= 0.2 AND (zones >= 0.2 OR zone_rows) THEN 'dimensional_matrix'
            WHEN n_rows <= 8 AND widest <= 2 THEN 'key_value_table' ELSE 'unknown' END AS kind, header_row FROM d JOIN h USING (table_id))"""
_FACTS = rf"""{_PROFILED},
    heads AS (SELECT table_id, col_index, CASE WHEN kind IN ('permission_matrix', 'parking_matrix') THEN z WHEN kind = 'dimensional_matrix' THEN s ELSE coalesce(xs[1], nullif(lower(label), '')) END AS col_entity
        FROM c JOIN p USING (table_id) WHERE row_index = header_row AND NOT head),
    named AS (SELECT table_id, kind, r.row_index, CASE WHEN kind IN ('permission_matrix', 'parking_matrix') THEN CASE WHEN {_IS_USE} THEN {normal_use('label')} END WHEN kind = 'dimensional_matrix' THEN z ELSE coalesce(s, xs[1]) END AS row_entity,
            CASE WHEN kind = 'requirement_matrix' THEN xs ELSE [] END AS row_contexts
        FROM r JOIN p USING (table_id) JOIN (SELECT table_id, row_index, label, z, s, xs FROM c WHERE head) USING (table_id, row_index)
        WHERE kind NOT IN ('key_value_table', 'unknown') AND r.row_index <> header_row AND (kind NOT IN ('permission_matrix', 'parking_matrix') OR n <= 2 OR zone_share < 0.5)),
    facts AS (SELECT table_id, row_index, col_index, CASE kind WHEN 'permission_matrix' THEN 'permission' WHEN 'parking_matrix' THEN 'parking_standard' WHEN 'requirement_matrix' THEN 'requirement' ELSE 'dimensional_standard' END AS relation_type,
            row_entity, row_contexts, col_entity, label AS value, CASE WHEN kind IN ('permission_matrix', 'requirement_matrix') THEN {_MARKERS.replace("text", "label")} ELSE [] END AS markers,
            CASE kind WHEN 'permission_matrix' THEN 0.88 WHEN 'parking_matrix' THEN 0.84 WHEN 'requirement_matrix' THEN 0.8 ELSE 0.82 END::DOUBLE AS confidence
        FROM c JOIN named USING (table_id, row_index) JOIN heads USING (table_id, col_index) WHERE NOT head AND label <> '' AND row_entity IS NOT NULL AND col_entity IS NOT NULL)"""
_MEANING = "CASE WHEN value IN ('x', 'X') THEN 'permitted' WHEN len(markers) > 0 THEN 'conditional' ELSE 'unknown' END"


@query("table_header_row", f"WITH {_READ} SELECT table_id, header_row FROM h")
def table_header_row(t):
    return S.header_rows(t.d_tables)


_AXIS = {"row_axis": 0, "col_axis": 1, "value_type": 2, "confidence": 3}
_BY_KIND = ", ".join("CASE kind " + " ".join(f"WHEN '{k}' THEN {repr(v[i]) if v[i] is not None else 'NULL'}" for k, v in S.TABLE_KINDS.items()) + f" END{'::DOUBLE' if i == 3 else ''} AS {name}" for name, i in _AXIS.items())


@query("table_profile", f"WITH {_PROFILED} SELECT table_id, kind, header_row, {_BY_KIND} FROM p")
def table_profile(t):
    return S.table_profiles(t.d_tables)


def _facts(t):
    return S.matrix_facts(t.d_tables, S.table_profiles(t.d_tables))


def _relation(name, relation):
    @query(name, f"WITH {_FACTS} SELECT * FROM facts WHERE relation_type = '{relation}'")
    def run(t):
        return _facts(t).where(F.col("relation_type") == relation)


@query("permission_facts", f"WITH {_FACTS} SELECT *, {_MEANING} AS meaning FROM facts WHERE relation_type = 'permission'")
def permission_facts(t):
    return _facts(t).where("relation_type = 'permission'").withColumn("meaning", S.permission(F.col("value")))


_relation("dimensional_facts", "dimensional_standard")
_relation("parking_facts", "parking_standard")
_relation("requirement_facts", "requirement")


_PARTICIPANTS = """SELECT DISTINCT table_id, row_index, col_index, p.role AS role, p.name AS name FROM (SELECT table_id, row_index, col_index, unnest(flatten([
        [{'role': CASE relation_type WHEN 'dimensional_standard' THEN 'zone' WHEN 'requirement' THEN 'standard' ELSE 'use' END, 'name': row_entity},
         {'role': CASE relation_type WHEN 'dimensional_standard' THEN 'standard' WHEN 'requirement' THEN 'development_context' ELSE 'zone' END, 'name': col_entity}],
        CASE WHEN relation_type = 'parking_standard' THEN [{'role': 'standard', 'name': 'parking spaces'}] ELSE [] END,
        list_transform(row_contexts, lambda c: {'role': 'development_context', 'name': c}), list_transform(markers, lambda m: {'role': 'condition', 'name': m})])) AS p FROM facts)"""


@query("fact_participants", f"WITH {_FACTS} {_PARTICIPANTS}")
def fact_participants(t):
    return S.fact_participants(_facts(t))


@query("axis_bindings", "SELECT DISTINCT table_id, col_index, text AS entity FROM {d_matrix} WHERE row_index = 0 AND col_index > 0")
def axis_bindings(t):
    return t.d_matrix.where("row_index = 0 and col_index > 0").select("table_id", "col_index", S.normalize_zone(F.col("text")).alias("entity"))


_PARTS = """list_concat(list_concat(CASE relation_type WHEN 'permission' THEN ['use: ' || row_entity, 'zone: ' || col_entity] WHEN 'parking_standard' THEN ['use: ' || row_entity, 'zone: ' || col_entity, 'standard: parking spaces']
    WHEN 'dimensional_standard' THEN ['standard: ' || col_entity, 'zone: ' || row_entity] ELSE ['standard: ' || row_entity, 'development_context: ' || col_entity] END,
    list_transform(list_filter(row_contexts, lambda c: c <> col_entity), lambda c: 'development_context: ' || c)), list_transform(markers, lambda m: 'condition: ' || m))"""


@query(
    "fact_evidence",
    f"""WITH {_FACTS}, defs AS (SELECT document_id, fragment_id, text, unnest({_MARKERS}) AS marker FROM {{d_clauses}}),
        said AS (SELECT table_id, row_index, col_index, list(DISTINCT {{'f': fragment_id, 't': text}}) AS d
            FROM (SELECT table_id, row_index, col_index, unnest(markers) AS marker FROM facts) m JOIN defs ON defs.marker = m.marker AND document_id = table_id % 97 GROUP BY ALL)
        SELECT table_id, row_index, col_index, (20 + confidence)::DOUBLE AS base_score,
            concat_ws(' | ', 'Semantic fact (' || relation_type || '): ' || array_to_string({_PARTS}, '; '), 'value: ' || value, CASE WHEN table_id % 2 = 0 THEN 'source table: Table ' || table_id END,
                'source cell row ' || row_index || ', column ' || col_index || ': ' || t.text, CASE WHEN d IS NOT NULL THEN array_to_string(list_transform(list_sort(d), lambda x: 'condition definition: ' || x.t), ' | ') END) AS text
        FROM facts JOIN d_tables t USING (table_id, row_index, col_index) LEFT JOIN said USING (table_id, row_index, col_index)""",
)
def fact_evidence(t):
    facts = _facts(t).withColumn("document_id", F.col("table_id").cast("long") % 97)
    captions = t.d_tables.where("table_id % 2 = 0").select("table_id", F.concat(F.lit("Table "), F.col("table_id").cast("string")).alias("caption")).distinct()
    definitions = S.condition_facts(t.d_clauses).join(t.d_clauses.select("fragment_id", "text"), "fragment_id")
    return S.fact_evidence(facts, t.d_tables, captions, definitions)


@query(
    "permission_summary",
    f"WITH {_FACTS} SELECT table_id, col_entity, list_sort(list(DISTINCT row_entity)) AS uses FROM facts WHERE relation_type = 'permission' AND {_MEANING} = 'permitted' GROUP BY table_id, col_entity",
)
def permission_summary(t):
    return S.permission_summary(_facts(t).where("relation_type = 'permission'").withColumn("meaning", S.permission(F.col("value"))))


_ASKED = """SELECT c_custkey AS question_id, r.relation_type, r.entity_type, r.name FROM {customer}, LATERAL (SELECT unnest([
        {{'relation_type': 'permission', 'entity_type': 'zone', 'name': CASE c_custkey % 3 WHEN 0 THEN 'DD' WHEN 1 THEN 'CEN-2' ELSE 'HR-2' END}},
        {{'relation_type': 'permission', 'entity_type': 'condition_ref', 'name': '[' || (c_custkey % 9 + 1) || ']'}}]) AS r) WHERE c_custkey % 20 = 0""".replace("{{", "{ ").replace("}}", " }")


@query(
    "fact_match",
    f"""WITH {_FACTS}, q AS ({_ASKED}),
        parts AS (SELECT table_id, row_index, col_index, relation_type, confidence, unnest(flatten([['zone:' || col_entity, 'use:' || row_entity], list_transform(markers, lambda m: 'condition_ref:' || m)])) AS part FROM facts WHERE relation_type = 'permission'),
        hit AS (SELECT question_id, table_id, row_index, col_index, max(confidence) AS confidence, max(CASE WHEN q.relation_type = parts.relation_type THEN 1 ELSE 0 END) AS bonus, count(DISTINCT part) AS have
            FROM q JOIN parts ON part = entity_type || ':' || name GROUP BY ALL),
        need AS (SELECT question_id, count(DISTINCT entity_type) AS need FROM q GROUP BY 1)
        SELECT question_id, table_id * 1000000 + row_index * 10 + col_index AS fact_id, (have * 2 + bonus + confidence)::DOUBLE AS score FROM hit JOIN need USING (question_id) WHERE have = need""",
)
def fact_match(t):
    facts = _facts(t).where("relation_type = 'permission'")
    key = (F.col("table_id") * 1000000 + F.col("row_index") * 10 + F.col("col_index")).alias("fact_id")
    participants = S.fact_participants(facts).select(key, F.when(F.col("role") == "condition", "condition_ref").otherwise(F.col("role")).alias("entity_type"), "name")
    k = F.col("c_custkey")
    zone = F.struct(F.lit("zone").alias("entity_type"), F.when(k % 3 == 0, "DD").when(k % 3 == 1, "CEN-2").otherwise("HR-2").alias("name"))
    marker = F.struct(F.lit("condition_ref").alias("entity_type"), F.concat(F.lit("["), (k % 9 + 1).cast("string"), F.lit("]")).alias("name"))
    asked = t.customer.where(k % 20 == 0).select(k.alias("question_id"), F.explode(F.array(zone, marker)).alias("e")).select("question_id", F.array(F.lit("permission")).alias("relation_types"), "e.entity_type", "e.name")
    return S.fact_match(asked, participants, facts.select(key, "relation_type", "confidence"))


@query("reference_edges")
def reference_edges(t):
    leaves = t.d_fragments.where("depth = 5")
    refs = resolve_references(detect_references(leaves), t.d_fragments)
    entities = S.entity_dedupe(S.entity_mentions(t.d_fragments))
    return S.reference_edges(refs, entities)


@query("provenance", "SELECT 'fact' AS object_type, fragment_id AS object_id, 'definition_pattern' AS method, '1' AS version FROM {d_definitions} WHERE " + _DEFINED)
def provenance(t):
    return S.provenance(S.definition_facts(t.d_definitions), "fact", "fragment_id", "definition_pattern", "1")


@query("semantic_validation", "SELECT 'fact_without_provenance' AS rule, fragment_id AS object_id FROM {d_definitions} WHERE fragment_id % 2 = 1 AND " + _DEFINED)
def semantic_validation(t):
    facts = S.definition_facts(t.d_definitions).withColumnRenamed("fragment_id", "fact_id")
    prov = S.provenance(facts.where("fact_id % 2 = 0"), "fact", "fact_id", "definition_pattern", "1")
    return S.semantic_findings(t.d_tables, S.table_profiles(t.d_tables), facts, prov)


@query("dimensional_pairs", "SELECT table_id, row_index, col_index, text, lead(text, 1) OVER w AS next1, lead(text, 2) OVER w AS next2, lead(text, 3) OVER w AS next3 FROM {d_cells} WINDOW w AS (PARTITION BY table_id ORDER BY row_index, col_index)")
def dimensional_pairs(t):
    return S.neighbours(t.d_cells)
