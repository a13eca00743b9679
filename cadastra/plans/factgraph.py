"""Queries of the graph of facts and of walks over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import factgraph as G
from cadastra.operators import retrieval as R
from cadastra.operators import semantic as S
from cadastra.plans.base import query
from cadastra.plans.retrieval import fact_levels
from cadastra.plans.semantic import _FACTS, _MARKERS, _PARTICIPANTS, _SECTION_REFS
from cadastra.sources.lineage import cut


def _id(*parts: str) -> str:
    return "sha256(" + " || chr(31) || ".join(f"({p})::VARCHAR" for p in parts) + ")[1:32]"


_ENTITY = _id("'entity'", "document_id", "CASE WHEN role = 'condition' THEN 'condition_ref' ELSE role END", "name")
_GRAPH = f"""WITH {_FACTS},
    cond AS (SELECT *, {_id("'fact'", "document_id", "'condition_definition'", "fragment_id", "marker")} AS fact_id
        FROM (SELECT document_id, fragment_id, unnest({_MARKERS}) AS marker, list_sort(list_distinct(list_transform({_SECTION_REFS}, lambda x: regexp_replace(x, '\\s+', ' ', 'g')))) AS refs FROM {{d_conditions}})),
    cells AS (SELECT *, {_id("'fact'", "table_id", "relation_type", "table_id", "row_index", "col_index")} AS fact_id FROM facts),
    fact AS (SELECT fact_id, document_id, 'condition_definition' AS relation_type, 'fragment ' || fragment_id AS source FROM cond
        UNION ALL SELECT fact_id, table_id, relation_type, concat_ws(' ', 'cell', table_id, row_index, col_index) FROM cells),
    part_ AS MATERIALIZED (SELECT *, {_ENTITY} AS entity_id FROM (
        SELECT fact_id, document_id, 'condition' AS role, marker AS name FROM cond UNION ALL SELECT fact_id, document_id, 'section_ref', unnest(refs) FROM cond
        UNION ALL SELECT DISTINCT fact_id, table_id, role, name FROM ({_PARTICIPANTS}) JOIN cells USING (table_id, row_index, col_index))),
    edge AS MATERIALIZED (SELECT fact_id AS source_id, entity_id AS target_id, CASE role WHEN 'section_ref' THEN 'references' ELSE 'conditioned_by' END AS edge_type, f.document_id,
            CASE relation_type WHEN 'permission' THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence, source
        FROM part_ JOIN fact f USING (fact_id) WHERE (relation_type = 'condition_definition' AND role = 'section_ref') OR (relation_type <> 'condition_definition' AND role = 'condition'))"""


def _read(t):
    """(facts of tables, graph of these and of conditions), the facts and who takes part written once."""
    facts = cut(S.matrix_facts(t.d_tables, S.table_profiles(t.d_tables)).withColumn("document_id", F.col("table_id").cast("long")))
    return facts, G.united(G.condition_graph(t.d_conditions), G.matrix_graph(facts))


@query("fact_edges", f"{_GRAPH} SELECT source_id, target_id, edge_type, document_id, confidence, source FROM edge")
def fact_edges(t):
    return _read(t)[1].edges.select("source_id", "target_id", "edge_type", "document_id", "confidence", "source")


@query(
    "fact_walk",
    f"""{_GRAPH},
        sect AS (SELECT DISTINCT entity_id, d.fragment_id FROM part_ p JOIN d_conditions d ON d.document_id = p.document_id AND d.citation_label = regexp_replace(p.name, '^\\S+\\s+', '') WHERE role = 'section_ref'),
        hops AS MATERIALIZED (SELECT from_kind, from_id, kind, id, min(w).way AS way, min(w).place AS place FROM (
            SELECT 'fact' AS from_kind, fact_id AS from_id, 'entity' AS kind, entity_id AS id, {{'way': 2, 'place': CASE role WHEN 'section_ref' THEN 0 WHEN 'condition' THEN 1 WHEN 'defined_term' THEN 2 ELSE 10 END}} AS w FROM part_
            UNION ALL SELECT 'entity', entity_id, 'fact', fact_id, {{'way': 2, 'place': CASE relation_type WHEN 'condition_definition' THEN 0 WHEN 'definition' THEN 1 WHEN 'requirement' THEN 2 ELSE 10 END}} FROM part_ JOIN fact USING (fact_id)
            UNION ALL SELECT 'fact', source_id, 'entity', target_id, {{'way': CASE edge_type WHEN 'references' THEN 0 ELSE 1 END, 'place': 0}} FROM edge) GROUP BY ALL),
        given AS MATERIALIZED (SELECT DISTINCT 'fact' AS kind, fact_id AS id, fragment_id, 1 AS later, 'semantic_section_reference' AS expansion FROM part_ JOIN sect USING (entity_id) WHERE role = 'section_ref'
            UNION ALL SELECT 'fact', fact_id, fragment_id, 0, 'semantic_fact_source' FROM cond UNION ALL SELECT 'entity', entity_id, fragment_id, 0, 'semantic_section_reference' FROM sect),
        {fact_levels(4, 200, 25, "SELECT fact_id AS question_id, 'fact' AS kind, fact_id AS id, 0 AS nth FROM cells WHERE len(markers) > 0")},
        best AS (SELECT *, row_number() OVER (PARTITION BY question_id, fragment_id ORDER BY level, nth, src, kind, id, depth, expansion) AS r FROM h4),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY level, nth, src, kind, id, fragment_id) AS rank FROM best WHERE r = 1)
        SELECT question_id, fragment_id, rank::INT AS rank, depth, expansion, greatest(8 - depth * 0.5, 0.5)::DOUBLE AS score FROM ranked WHERE rank <= 25""",
)
def fact_walk(t):
    """From all conditional facts in the tables over their edges to the definitions of their conditions and the sections that these name."""
    facts = _read(t)[0]
    place = [F.col(c) for c in ("table_id", "row_index", "col_index")]
    fact_id = G.object_id(F.lit("fact"), F.col("document_id"), F.col("relation_type"), *place)
    seeds = facts.where("size(markers) > 0").select(fact_id.alias("question_id"), fact_id.alias("fact_id"))
    # Every node belongs to a document and no edge leaves it: documents without a seed are never walked.
    begun = cut(facts.where("size(markers) > 0").select("document_id").distinct())
    g = G.within(G.united(G.condition_graph(t.d_conditions.join(begun, "document_id", "left_semi")), G.matrix_graph(facts)), begun)
    participants = cut(g.participants)
    return R.walk_facts(seeds, participants, g.facts, g.edges, g.sources, G.section_targets(participants, t.d_conditions))
