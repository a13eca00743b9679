"""The graph of facts: stable ids of facts and entities, who takes part in what, and the edges between them.

Ids are made of what an object is (128 bits of a hash of its kind, document and name), so that jobs
that run apart, or again, give the same object the same id without a shared counter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators.semantic import condition_facts, fact_participants

#: Confidence of an edge by the relation of its fact.
EDGE_CONFIDENCE = {"condition_definition": 0.8, "permission": 0.85, "requirement": 0.8}


class FactGraph(NamedTuple):
    """``facts``: fact_id, document_id, relation_type; ``participants``: fact_id, document_id, entity_id, role,
    name; ``edges``: source_kind, source_id, target_kind, target_id, edge_type, document_id, confidence,
    source (where it was read); ``sources``: fact_id, fragment_id."""

    facts: DataFrame
    participants: DataFrame
    edges: DataFrame
    sources: DataFrame


def object_id(*parts: Column) -> Column:
    """The first 32 hex digits of sha256 over the parts; a null part counts as an empty one."""
    return F.substring(F.sha2(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\x1f"), 256), 1, 32)


def entity_id(document: Column, role: Column, name: Column) -> Column:
    """An entity is its document, kind and name; the kind is the role it plays, ``condition_ref`` for conditions."""
    return object_id(F.lit("entity"), document, F.when(role == "condition", "condition_ref").otherwise(role), name)


def _edges(participants: DataFrame, facts: DataFrame, role: str, kind: str) -> DataFrame:
    """An edge of ``kind`` from each fact to each of its participants in ``role``."""
    found = participants.where(F.col("role") == role).join(facts.select("fact_id", "relation_type", "source"), "fact_id")
    sure = F.create_map(*[F.lit(x) for pair in EDGE_CONFIDENCE.items() for x in pair])
    return found.select(
        F.lit("fact").alias("source_kind"),
        F.col("fact_id").alias("source_id"),
        F.lit("entity").alias("target_kind"),
        F.col("entity_id").alias("target_id"),
        F.lit(kind).alias("edge_type"),
        "document_id",
        F.element_at(sure, F.col("relation_type")).alias("confidence"),
        "source",
    )


def condition_graph(fragments: DataFrame) -> FactGraph:
    """Condition definitions in ``fragments`` (document_id, fragment_id, text): the marker and the sections that
    the text names take part; each section is the end of a ``references`` edge."""
    found = condition_facts(fragments).withColumn("relation_type", F.lit("condition_definition"))
    found = found.withColumn("fact_id", object_id(F.lit("fact"), F.col("document_id"), F.col("relation_type"), F.col("fragment_id"), F.col("marker")))
    found = found.withColumn("source", F.concat(F.lit("fragment "), F.col("fragment_id").cast("string")))
    part = lambda role, name: F.struct(F.lit(role).alias("role"), name.alias("name"))
    taking = F.concat(F.array(part("condition", F.col("marker"))), F.transform("section_refs", lambda s: part("section_ref", s)))
    participants = found.select("fact_id", "document_id", F.explode(taking).alias("p")).select("fact_id", "document_id", entity_id(F.col("document_id"), F.col("p.role"), F.col("p.name")).alias("entity_id"), "p.role", "p.name")
    return FactGraph(found.select("fact_id", "document_id", "relation_type"), participants, _edges(participants, found, "section_ref", "references"), found.select("fact_id", "fragment_id"))


def matrix_graph(facts: DataFrame) -> FactGraph:
    """Facts read from tables (``matrix_facts`` with document_id): conditions are the ends of ``conditioned_by``
    edges of permissions and requirements. A cell is no fragment, so ``sources`` is empty."""
    place = [F.col(c) for c in ("table_id", "row_index", "col_index")]
    found = facts.withColumn("fact_id", object_id(F.lit("fact"), F.col("document_id"), F.col("relation_type"), *place))
    found = found.withColumn("source", F.concat_ws(" ", F.lit("cell"), *[c.cast("string") for c in place]))
    keys = found.select("table_id", "row_index", "col_index", "fact_id", "document_id")
    who = fact_participants(facts).join(keys, ["table_id", "row_index", "col_index"])
    participants = who.select("fact_id", "document_id", entity_id(F.col("document_id"), F.col("role"), F.col("name")).alias("entity_id"), "role", "name")
    none = found.where("false").select("fact_id", F.lit(0).cast("long").alias("fragment_id"))
    return FactGraph(found.select("fact_id", "document_id", "relation_type"), participants, _edges(participants, found, "condition", "conditioned_by"), none)


def united(*graphs: FactGraph) -> FactGraph:
    """Graphs as one: entities of the same document, kind and name are the same node."""
    first, *rest = graphs
    for g in rest:
        first = FactGraph(*[a.unionByName(b) for a, b in zip(first, g, strict=True)])
    return first


def within(graph: FactGraph, documents: DataFrame) -> FactGraph:
    """The part of ``graph`` in ``documents`` (document_id); sources are those of its facts."""
    keep = lambda df: df.join(documents, "document_id", "left_semi")
    facts = keep(graph.facts)
    return FactGraph(facts, keep(graph.participants), keep(graph.edges), graph.sources.join(facts.select("fact_id"), "fact_id", "left_semi"))


def section_targets(participants: DataFrame, fragments: DataFrame) -> DataFrame:
    """(entity_id, fragment_id): the fragments of the document whose citation label a section reference names."""
    label = F.regexp_replace("name", r"^\S+\s+", "")
    named = participants.where("role = 'section_ref'").select("document_id", "entity_id", label.alias("citation_label")).distinct()
    return named.join(fragments.select("document_id", "citation_label", "fragment_id"), ["document_id", "citation_label"]).select("entity_id", "fragment_id")
