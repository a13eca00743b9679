"""Semantic extraction: zones, uses, standards, references; entities, facts, edges and their provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.sharing import asked_once, for_all, read_once
from cadastra.sources.lineage import cut

# Zone codes, patterns and vocabularies of the extractors.
KNOWN_ZONES = ("CEN-2", "CEN-1", "CDD-2", "CDD-1", "HR-2", "HR-1", "ER-3", "ER-2", "ER-1", "CH-2", "CH-1", "UC-2", "UC-1", "DD", "DH", "COR", "CLI", "LI", "HRI", "INS", "DND", "PCF", "RPK", "WA")
ZONE = r"(?i)\b[A-Z]{1,4}-?\s?\d[A-Z]?(?:-?\s?[A-Z])?\b|\b(?:DD|DH|COR|CLI|LI|HRI|INS|DND|PCF|RPK|WA)\b"
USE = r"\b([A-Z][A-Za-z0-9,'()/& -]{1,120}?(?:\s+use|\s+dwelling|\s+facility|\s+establishment|\s+suite|\s+unit))\b"
MARKER = r"[\x{2460}-\x{24FF}\x{3251}-\x{325F}]|\[\d+\]"
TABLE_REF = r"(?i)\bTable\s+\d+[A-Z]?\b"
SECTION_REF = r"(?i)\b(?:Section|Subsection|Schedule)\s+[A-Za-z0-9.\-()]+\b"
VALUE = r"(?i)\b\d+(?:\.\d+)?\s*(?:m2|m²|metres?|meters?|feet|ft|sq\.?\s*ft|square feet|%)\b"
CONTEXT = r"(?i)\b(rear additions?|internal conversions?|interior conversions?|additions?|conversions?)\b"
STANDARDS = (
    "minimum lot area", "lot area", "lot frontage", "minimum lot frontage", "minimum rear yard", "front yard setback", "side yard setback", "minimum side yard", "minimum side yard for additions",
    "rear yard setback", "building height", "maximum height", "maximum footprint of addition", "additions and structural changes", "dwelling units", "lot coverage", "parking spaces", "open space",
)
USE_ALIASES = {"restaurant": "restaurant use", "single detached dwelling": "single-unit dwelling use", "single unit dwelling": "single-unit dwelling use"}
NOT_USES = ("land use", "permitted use")
PERMITTED = ("●", "\uf098", "•", "■", "x", "X")


def _all(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def normalize_zone(raw: Column) -> Column:
    """Upper case without spaces, hyphens put in, a leading L or I read into a known code taken off."""
    upper = F.regexp_replace(F.upper(raw), r"\s+", "")
    compact = F.replace(upper, F.lit("-"), F.lit(""))
    hyphened = F.regexp_replace(F.regexp_replace(upper, r"^([A-Z]{1,4})(\d[A-Z]?)$", "$1-$2"), r"^([A-Z]{1,4})(\d[A-Z])([A-Z])$", "$1-$2-$3")
    out = F.when(upper.contains("-"), upper).otherwise(hyphened)
    for code in KNOWN_ZONES:
        bare = code.replace("-", "")
        out = F.when(compact.isin("L" + bare, "I" + bare), code).otherwise(out)
    return out


def extract_zones(t: Column) -> Column:
    """Sorted distinct zone codes of a text; square metres are none."""
    raw = F.filter(_all(t, ZONE), lambda z: ~z.rlike(r"(?i)^(m\s*2|m²)$"))
    return F.array_sort(F.array_distinct(F.transform(raw, normalize_zone)))


def normalize_use(t: Column) -> Column:
    """Lower-cased name of a use without outer punctuation, aliases by their canonical name."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(t), r"^[.,;:]+|[.,;:]+$", ""), r"\s+", " ")
    name = F.replace(F.lower(bare), F.lit(" - "), F.lit("-"))
    out = name
    for alias, canonical in USE_ALIASES.items():
        out = F.when(name == alias, canonical).otherwise(out)
    return out


def extract_uses(t: Column) -> Column:
    uses = F.transform(_all(t, USE, 1), normalize_use)
    return F.array_sort(F.array_distinct(F.filter(uses, lambda u: ~u.isin(*NOT_USES))))


def use_label(t: Column) -> Column:
    return normalize_use(t).rlike(r" (use|dwelling|facility|establishment|suite|unit)$")


def extract_standards(t: Column, terms: Sequence[str] = STANDARDS) -> Column:
    """Vocabulary terms in the text without those inside a longer match; the longest first."""
    low = F.lower(t)
    found = F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in terms]))
    maximal = F.filter(found, lambda a: ~F.exists(found, lambda b: (a != b) & b.contains(a)))
    order = F.transform(maximal, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.array_sort(order), lambda x: x["w"])


def extract_condition_refs(t: Column) -> Column:
    """Circled numbers and bracketed ones, without the filled signs that mark plain permission."""
    return F.array_sort(F.array_distinct(_all(t, MARKER)))


def extract_table_refs(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(t, TABLE_REF), lambda x: F.initcap(F.regexp_replace(x, r"\s+", " ")))))


def extract_section_refs(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(t, SECTION_REF), lambda x: F.regexp_replace(x, r"\s+", " "))))


def extract_values(t: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(t, VALUE), lambda x: F.regexp_replace(x, r"\s+", " "))))


def extract_contexts(t: Column) -> Column:
    """Development contexts in their plural form; interior counts as internal."""
    plural = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), r"([^s])$", "$1s"), "^interior", "internal")
    return F.array_sort(F.array_distinct(F.transform(_all(t, CONTEXT, 1), plural)))


EXTRACTORS = {
    "zone": extract_zones, "use": extract_uses, "standard": extract_standards, "condition": extract_condition_refs,
    "table": extract_table_refs, "section": extract_section_refs, "value": extract_values, "context": extract_contexts,
}


def entity_mentions(fragments: DataFrame) -> DataFrame:
    """(document_id, fragment_id, entity_type, name): all extractors in one pass over the different texts."""

    def named(kind: str, names: Column) -> Column:
        return F.transform(names, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("name")))

    structs = [named(kind, f(F.col("text"))) for kind, f in EXTRACTORS.items()]
    read = read_once(fragments.select("document_id", "fragment_id", "text"), "text", lambda rows: rows.select("*", F.explode(F.concat(*structs)).alias("m")))
    return read.select("document_id", "fragment_id", "m.entity_type", "m.name")


def entity_dedupe(mentions: DataFrame) -> DataFrame:
    """One entity per document, type and lower-cased name: its first source, and how often it is named."""
    return mentions.groupBy("document_id", "entity_type", F.lower("name").alias("key")).agg(F.min("fragment_id").alias("source_fragment_id"), F.min_by("name", "fragment_id").alias("name"), F.count(F.lit(1)).alias("mentions")).withColumn(
        "entity_id", F.xxhash64("document_id", "entity_type", "key")
    )


# Fixed value: what a definition at the start of a fragment looks like.
DEFINITION = r"^\s*([A-Z][A-Za-z0-9 /'()-]{1,80}?)\s+means\s+([^\n]+)"


def definition_facts(fragments: DataFrame) -> DataFrame:
    """(document_id, fragment_id, term, meaning): fragments that begin with a capitalised term that ``means`` something.

    A term in quotes is none; the meaning ends with its line. The term is the canonical name; it is the
    fact's only participant (role defined_term).
    """
    found = fragments.where(F.col("text").rlike(DEFINITION))
    term = normalize_use(F.regexp_extract("text", DEFINITION, 1))
    return found.select("document_id", "fragment_id", term.alias("term"), F.trim(F.regexp_extract("text", DEFINITION, 2)).alias("meaning")).where("term <> ''")


# Fixed value: the same with the term in quotes or in small letters.
DEFINED = r"""(?i)^\s*["“]?([A-Z][A-Za-z0-9 /'()-]{1,80}?)["”]?\s+means\s+\S"""


def defined_terms(fragments: DataFrame) -> DataFrame:
    """(fragment_id, term): what fragments define that begin with a term that ``means`` something, however the term is written."""
    return fragments.where(F.col("text").rlike(DEFINED)).select("fragment_id", normalize_use(F.regexp_extract("text", DEFINED, 1)).alias("term"))


def condition_facts(fragments: DataFrame) -> DataFrame:
    """(document_id, fragment_id, marker, section_refs): condition definitions, one for each marker of a fragment.

    Participants are the marker (role condition) and the sections that the fragment names (role
    section_ref, each also the end of a ``references`` edge).
    """
    return fragments.select("document_id", "fragment_id", F.explode(extract_condition_refs(F.col("text"))).alias("marker"), extract_section_refs(F.col("text")).alias("section_refs"))


def _read_cells(cells: DataFrame) -> DataFrame:
    """``cells`` with the cleaned label, its first zone, standard and context, and whether it is its row's first cell."""
    label = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    first = F.col("col_index") == F.min("col_index").over(Window.partitionBy("table_id", "row_index"))
    read = cells.select("table_id", "row_index", "col_index", label.alias("label"), first.alias("is_first"))
    names = {"zone": extract_zones, "standard": extract_standards, "context": extract_contexts}
    return read.select("*", *[F.get(f(F.col("label")), F.lit(0)).alias(k) for k, f in names.items()])


def _read_rows(read: DataFrame) -> DataFrame:
    """(table_id, row_index, hits, n, row_label, zone_share): the cells of each row that name something, and its first cell."""
    named = F.col("zone").isNotNull() | F.col("standard").isNotNull() | F.col("context").isNotNull()
    return read.groupBy("table_id", "row_index").agg(
        F.count_if(named).alias("hits"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("is_first"), F.col("label"))).alias("row_label"),
        (F.count_if(~F.col("is_first") & F.col("zone").isNotNull()) / F.greatest(F.count_if(~F.col("is_first")), F.lit(1))).alias("zone_share"),
    )


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, header_row): the row with most cells that name a zone, standard or context; the first of equal ones."""
    return _read_rows(_read_cells(cells)).groupBy("table_id").agg(F.max_by("row_index", F.struct("hits", (-F.col("row_index")).alias("o"))).alias("header_row"))


#: What a kind of table binds: row axis, column axis, value, confidence of the profile and of its facts, and their relation.
TABLE_KINDS = {
    "permission_matrix": ("use", "zone", "permission_marker", 0.9, 0.88, "permission"),
    "parking_matrix": ("use", "standard", "requirement", 0.75, 0.84, "parking_standard"),
    "requirement_matrix": ("standard", "development_context", "requirement", 0.78, 0.8, "requirement"),
    "dimensional_matrix": ("zone", "standard", "numeric_or_text", 0.8, 0.82, "dimensional_standard"),
    "key_value_table": ("key", "value", "text", 0.55, None, None),
    "unknown": (None, None, None, 0.4, None, None),
}


def table_profiles(cells: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """(table_id, kind, header_row, row_axis, col_axis, value_type, confidence): what a table speaks of.

    Densities of zones, uses, standards and contexts among the header row and the row labels decide,
    and ``captions`` (table_id, caption) where given.
    """
    read = _read_cells(cells)
    rows = _read_rows(read)
    heads = rows.groupBy("table_id").agg(F.max_by("row_index", F.struct("hits", (-F.col("row_index")).alias("o"))).alias("header_row"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("widest"))
    labels = read.join(heads, "table_id")
    header, row_label = F.col("row_index") == F.col("header_row"), F.col("is_first") & (F.col("row_index") > 0)
    both = header.cast("int") + row_label.cast("int")  # a label that is both counts twice

    def share(column: str) -> Column:
        return F.sum(F.when(F.col(column).isNotNull(), both).otherwise(0)) / F.greatest(F.sum(both), F.lit(1))

    facts = labels.groupBy("table_id", "header_row", "rows", "widest").agg(
        (F.count_if(header & F.col("zone").isNotNull()) / F.greatest(F.count_if(header), F.lit(1))).alias("zones"),
        (F.count_if(row_label & use_label(F.col("label"))) / F.greatest(F.count_if(row_label), F.lit(1))).alias("uses"),
        share("standard").alias("standards"),
        share("context").alias("contexts"),
        F.coalesce(F.bool_or((header | row_label) & F.lower("label").contains("parking")), F.lit(False)).alias("parking"),
        F.coalesce(F.bool_or(row_label & F.col("zone").isNotNull()), F.lit(False)).alias("zone_rows"),
    )
    if captions is not None:
        facts = facts.join(captions.select("table_id", F.lower("caption").alias("caption")), "table_id", "left")
    caption = F.coalesce(F.col("caption"), F.lit("")) if captions is not None else F.lit("")
    parking = F.col("parking") | caption.contains("parking")
    kind = (
        F.when((caption.contains("permitted uses by zone") | ((F.col("zones") >= 0.4) & (F.col("uses") >= 0.35))) & ~parking, "permission_matrix")
        .when(parking & ((F.col("zones") >= 0.2) | (F.col("standards") >= 0.2)), "parking_matrix")
        .when((F.col("standards") >= 0.2) & (F.col("contexts") >= 0.1), "requirement_matrix")
        .when((F.col("standards") >= 0.2) & ((F.col("zones") >= 0.2) | F.col("zone_rows")), "dimensional_matrix")
        .when((F.col("rows") <= 8) & (F.col("widest") <= 2), "key_value_table")
        .otherwise("unknown")
    )
    out = facts.select("table_id", kind.alias("kind"), "header_row")
    for i, name in enumerate(("row_axis", "col_axis", "value_type", "confidence")):
        value = F.lit(None).cast("double" if name == "confidence" else "string")
        for k, v in TABLE_KINDS.items():
            value = F.when(F.col("kind") == k, F.lit(v[i])).otherwise(value)
        out = out.withColumn(name, value)
    return out


def matrix_facts(cells: DataFrame, profiles: DataFrame) -> DataFrame:
    """Facts of permission, parking, dimensional and requirement tables: row label × header × cell.

    (table_id, row_index, col_index, relation_type, row_entity, row_contexts, col_entity, value,
    markers, confidence). Blank cells, repeated header rows of zone tables, and rows and columns
    whose label names nothing that the kind of table binds give none.
    """
    read = _read_cells(cells)
    known = profiles.where(F.col("kind").isin(*[k for k, v in TABLE_KINDS.items() if v[5]])).select("table_id", "kind", "header_row")
    placed = read.join(known, "table_id")
    by_zone = F.col("kind").isin("permission_matrix", "parking_matrix")
    col_entity = F.when(by_zone, F.col("zone")).when(F.col("kind") == "dimensional_matrix", F.col("standard")).otherwise(F.coalesce("context", F.when(F.col("label") != "", F.lower("label"))))
    heads = placed.where("row_index = header_row and not is_first").select("table_id", "col_index", col_entity.alias("col_entity")).where("col_entity is not null")
    rows = _read_rows(placed).join(known, "table_id").where("row_index <> header_row").where(~by_zone | (F.col("n") <= 2) | (F.col("zone_share") < 0.5))
    contexts, label = extract_contexts(F.col("row_label")), F.col("row_label")
    row_entity = (
        F.when(by_zone, F.when(use_label(label), normalize_use(label)))
        .when(F.col("kind") == "dimensional_matrix", F.get(extract_zones(label), F.lit(0)))
        .otherwise(F.coalesce(F.get(extract_standards(label), F.lit(0)), F.get(contexts, F.lit(0))))
    )
    named = rows.select("table_id", "kind", "row_index", row_entity.alias("row_entity"), F.when(F.col("kind") == "requirement_matrix", contexts).otherwise(F.array().cast("array<string>")).alias("row_contexts")).where("row_entity is not null")
    body = read.where("not is_first and label <> ''").select("table_id", "row_index", "col_index", F.col("label").alias("value"))
    relation, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, v in TABLE_KINDS.items():
        relation, confidence = F.when(F.col("kind") == k, F.lit(v[5])).otherwise(relation), F.when(F.col("kind") == k, F.lit(v[4])).otherwise(confidence)
    marked = F.when(F.col("kind").isin("permission_matrix", "requirement_matrix"), extract_condition_refs(F.col("value"))).otherwise(F.array().cast("array<string>"))
    return (
        body.join(named, ["table_id", "row_index"])
        .join(heads, ["table_id", "col_index"])
        .select("table_id", "row_index", "col_index", relation.alias("relation_type"), "row_entity", "row_contexts", "col_entity", "value", marked.alias("markers"), confidence.alias("confidence"))
    )


def _taking_part() -> Column:
    """Participants of a fact in their order, each once in a role: subject, scope, shared standard, contexts, conditions."""
    row, col = F.col("row_entity"), F.col("col_entity")

    def as_role(role: str, name: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), name.alias("name"))

    relation = F.col("relation_type")
    main = (
        F.when(relation == "permission", F.array(as_role("use", row), as_role("zone", col)))
        .when(relation == "parking_standard", F.array(as_role("use", row), as_role("zone", col), as_role("standard", F.lit("parking spaces"))))
        .when(relation == "dimensional_standard", F.array(as_role("standard", col), as_role("zone", row)))
        .otherwise(F.array(as_role("standard", row), as_role("development_context", col)))
    )
    contexts = F.transform("row_contexts", lambda c: as_role("development_context", c))
    return F.array_distinct(F.concat(main, contexts, F.transform("markers", lambda m: as_role("condition", m))))


def fact_participants(facts: DataFrame) -> DataFrame:
    """(table_id, row_index, col_index, role, name): the entities that take part in each fact, each once in a role."""
    return facts.select("table_id", "row_index", "col_index", F.explode(_taking_part()).alias("p")).select("table_id", "row_index", "col_index", "p.role", "p.name")


def fact_evidence(facts: DataFrame, cells: DataFrame, captions: DataFrame, definitions: DataFrame) -> DataFrame:
    """(table_id, row_index, col_index, base_score, text): each fact as a text that says where it is from.

    Its relation and participants, value, table caption, source cell, and what the document says of
    its conditions. ``facts`` has document_id, ``captions`` (table_id, caption), ``definitions``
    (document_id, fragment_id, marker, text). The score is 20 and the fact's confidence.
    """
    place = ["table_id", "row_index", "col_index"]
    said = definitions.groupBy("document_id", "marker").agg(F.sort_array(F.collect_list(F.struct("fragment_id", "text"))).alias("d"))
    asked = facts.select(*place, "document_id", F.explode("markers").alias("marker")).join(said, ["document_id", "marker"])
    known = asked.select(*place, F.explode("d").alias("d")).groupBy(*place).agg(F.array_sort(F.collect_set("d")).alias("d"))
    found = facts.join(cells.select(*place, F.col("text").alias("cell")), place).join(captions, "table_id", "left").join(known, place, "left")
    parts = F.array_join(F.transform(_taking_part(), lambda p: F.concat(p["role"], F.lit(": "), p["name"])), "; ")
    text = F.concat_ws(
        " | ",
        F.concat(F.lit("Semantic fact ("), "relation_type", F.lit("): "), parts),
        F.concat(F.lit("value: "), "value"),
        F.concat(F.lit("source table: "), F.nullif("caption", F.lit(""))),
        F.concat(F.lit("source cell row "), F.col("row_index").cast("string"), F.lit(", column "), F.col("col_index").cast("string"), F.lit(": "), "cell"),
        F.transform("d", lambda d: F.concat(F.lit("condition definition: "), d["text"])),
    )
    return found.select(*place, (F.col("confidence") + 20).alias("base_score"), text.alias("text"))


def permission(value: Column) -> Column:
    """Meaning of a permission cell."""
    return F.when(value.isin(*PERMITTED), "permitted").when(F.size(extract_condition_refs(value)) > 0, "conditional").otherwise("unknown")


def reference_edges(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between entities of fragments that refer to each other."""
    first = cut(entities.groupBy("source_fragment_id").agg(F.min("entity_id").alias("entity_id")))  # both ends read it
    a = first.select(F.col("source_fragment_id").alias("fragment_id"), F.col("entity_id").alias("source_id"))
    b = first.select(F.col("source_fragment_id").alias("target_fragment_id"), F.col("entity_id").alias("target_id"))
    return refs.where("target_fragment_id is not null").join(a, "fragment_id").join(b, "target_fragment_id").select("source_id", "target_id", F.lit("references").alias("edge_type")).distinct()


def provenance(objects: DataFrame, kind: str, key: str, method: str, version: str) -> DataFrame:
    """One row per derived object: where it is from and how it was made."""
    return objects.select(F.lit(kind).alias("object_type"), F.col(key).cast("long").alias("object_id"), F.lit(method).alias("method"), F.lit(version).alias("version"))


def semantic_findings(tables: DataFrame, profiles: DataFrame, facts: DataFrame, prov: DataFrame) -> DataFrame:
    """Tables without a profile and facts without provenance."""
    a = tables.select("table_id").distinct().join(profiles.select("table_id"), "table_id", "left_anti").select(F.lit("table_without_profile").alias("rule"), F.col("table_id").cast("long").alias("object_id"))
    b = facts.join(prov.select(F.col("object_id").alias("fact_id")), "fact_id", "left_anti").select(F.lit("fact_without_provenance").alias("rule"), F.col("fact_id").cast("long").alias("object_id"))
    return a.unionByName(b)


def fact_match(requests: DataFrame, participants: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts that cover every kind of entity a question asks for (relational division): (question_id, fact_id, score).

    ``requests``: question_id, relation_types, entity_type, name; ``participants``: fact_id,
    entity_type, name; ``facts``: fact_id, relation_type, confidence. The score is 2 for each covered
    entity, 1 where the fact's relation is asked for, and its confidence. Equal requests meet the facts once.
    """
    requests, askers = asked_once(requests)
    asked = requests.groupBy("question_id").agg(F.count_distinct("entity_type").alias("need"), F.first("relation_types").alias("relation_types"))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        bare = F.replace(F.lower("name"), F.lit("-"), F.lit(""))
        return df.withColumn("__key", F.regexp_replace(bare, "s+$", "")).withColumn(name, F.lower("name")).drop("name")

    # Names meet without hyphens and a final s; one of the two may differ, not both.
    plain, other = F.col("__name"), F.col("__asked")
    same = (F.replace(plain, F.lit("-"), F.lit("")) == F.replace(other, F.lit("-"), F.lit(""))) | (F.regexp_replace(plain, "s+$", "") == F.regexp_replace(other, "s+$", ""))
    met = keyed(participants, "__name").join(keyed(requests, "__asked"), ["entity_type", "__key"]).where(same)
    hits = met.groupBy("question_id", "fact_id").agg(F.count_distinct("entity_type").alias("have"))
    covered = hits.join(asked, "question_id").where("have = need").join(facts, "fact_id")
    bonus = F.when(F.array_contains("relation_types", F.col("relation_type")), 1).otherwise(0)
    return for_all(covered.select("question_id", "fact_id", (F.col("have") * 2 + bonus + F.coalesce("confidence", F.lit(0.0))).alias("score")), askers)


def permission_summary(facts: DataFrame) -> DataFrame:
    """(table_id, col_entity, uses): the uses that a zone permits in a table, as one sorted list."""
    return facts.where("meaning = 'permitted'").groupBy("table_id", "col_entity").agg(F.array_sort(F.collect_set("row_entity")).alias("uses"))


def neighbours(cells: DataFrame) -> DataFrame:
    """Each cell with the next three of its table in reading order."""
    w = Window.partitionBy("table_id").orderBy("row_index", "col_index")
    return cells.select("*", *[F.lead("text", i).over(w).alias(f"next{i}") for i in (1, 2, 3)])
