"""Evidence assembly: zone pages, permission rows, dataset and spatial expansions, section references, matches and notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.geo import spatial_match

from cadastra.operators.questions import query_terms
from cadastra.operators.retrieval import any_term_candidates
from cadastra.operators.sharing import asked_once, for_all


def zone_pages(zones: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, zone, tier, page_number): pages about a zone from the best tier that has any.

    Tier 1: the block is the zone's heading; 2: it names the zone beside its built-form heading;
    3: it names the zone at all. Zones meet blocks on the code found in the text, not by comparison
    with every block. ``zones`` has zone; ``blocks`` document_id, page_number, text.
    """
    text = F.trim(F.regexp_replace(F.upper("text"), r"\s+", " "))
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{1,4}-?\d?[A-Z]?)\b"), F.lit(1)))
    named = blocks.select("document_id", "page_number", text.alias("t"), F.explode(codes).alias("zone")).join(F.broadcast(zones.select("zone").distinct()) if zones.count() < 10_000 else zones.select("zone").distinct(), "zone")
    tier = F.when(F.col("t") == F.concat("zone", F.lit(" ZONE")), 1).when(F.col("t").contains("BUILT FORM AND SITING REQUIREMENTS WITHIN"), 2).otherwise(3)
    found = named.select("document_id", "zone", tier.alias("tier"), "page_number").distinct()
    best = found.groupBy("document_id", "zone").agg(F.min("tier").alias("tier"))
    return found.join(best, ["document_id", "zone", "tier"])


def near_pages(pages: DataFrame, before: int = 0, after: int = 2, first: int = 3) -> DataFrame:
    """The first pages of each zone with their neighbours."""
    w = Window.partitionBy("document_id", "zone").orderBy("page_number")
    top = pages.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first)
    near = top.select("document_id", "zone", F.explode(F.sequence(F.col("page_number") - before, F.col("page_number") + after)).alias("page_number"))
    return near.where("page_number > 0").distinct()


# Captions of tables of permitted uses, the circled markers of their cells, the pages that hold the notes, and the legend.
PERMISSION_CAPTION = "Table 1%Permitted uses by zone%"
MARKER, NOTE, NOTE_PAGES = "[①-㉟]", "(?i)([①-㉟]) Use is permitted", (45, 56)
LEGEND = "Filled circle markers indicate permitted uses; circled numbers indicate permission subject to the corresponding table footnote."


def permission_rows(calls: DataFrame, cells: DataFrame, tables: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(question_id, table_id, row_index, text): rows whose label starts with the use asked for, with the
    columns (all without a zone) whose header names the zone, those that are not blank.

    With ``tables`` (table_id, document_id, caption) only tables of permitted uses answer, and a text has the
    caption, the legend and the first of the document's ``notes`` (document_id, fragment_id, page_start, text)
    to each marker in it. A row's label is its first cell; a column without a header is called by its number.
    Rows and calls meet on the first word of the use, equal calls once. ``calls``: question_id, use, zone.
    """
    calls, askers = asked_once(calls)
    head = lambda c: F.element_at(F.split(c, " "), 1)
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    bare = lambda c: F.regexp_replace(F.upper(c), "[- ]", "")
    held = F.sort_array(F.collect_list(F.struct("col_index", "text")))
    rows = cells.where("row_index > 0").groupBy("table_id", "row_index").agg(held.alias("row")).withColumn("label", F.col("row")[0]["text"])
    asked = calls.select("question_id", plain("use").alias("use"), F.nullif("zone", F.lit("")).alias("zone")).where("use <> ''")
    found = rows.withColumn("w", head(plain("label"))).join(asked.withColumn("w", head(F.col("use"))), "w").where(plain("label").startswith(F.col("use")))
    found = found.join(cells.where("row_index = 0").groupBy("table_id").agg(held.alias("heads")), "table_id", "left")

    def column(cell: Column) -> Column:
        named = F.try_element_at(F.filter("heads", lambda h: h["col_index"] == cell["col_index"]), F.lit(-1))["text"]
        return F.struct(F.coalesce(named, F.concat(F.lit("column "), cell["col_index"].cast("string"))).alias("header"), F.trim(cell["text"]).alias("marker"))

    # Each step of a row is a column of its own, so that it is evaluated once.
    found = found.withColumn("row", F.transform(F.filter("row", lambda c, i: i > 0), column))
    found = found.withColumn("row", F.filter("row", lambda c: F.col("zone").isNull() | bare(c["header"]).contains(bare(F.col("zone"))))).where("zone is null or size(row) > 0")
    found = found.withColumn("v", F.transform(F.filter("row", lambda c: c["marker"] != ""), lambda c: F.concat_ws("=", c["header"], c["marker"])))
    said = F.concat(F.lit(": "), F.array_join("v", "; "))
    if tables is None:
        return for_all(found.select("question_id", "table_id", "row_index", F.concat(plain("label"), said).alias("text")), askers)
    known = tables.where(F.col("caption").ilike(PERMISSION_CAPTION)).select("table_id", "document_id", "caption")
    footnotes = F.lit("")
    if notes is not None:
        marked = notes.where(F.col("page_start").between(*NOTE_PAGES)).select("document_id", "page_start", "fragment_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NOTE), F.lit(1)))).alias("marker"))
        first = marked.groupBy("document_id", "marker").agg(F.min_by("text", F.struct("page_start", "fragment_id")).alias("text"))
        known = known.join(first.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("marker", "text"))).alias("notes")), "document_id", "left")
        markers = F.regexp_extract_all(F.array_join("v", " "), F.lit(MARKER), F.lit(0))
        cited = F.transform(F.filter("notes", lambda n: F.array_contains(markers, n["marker"])), lambda n: n["text"])
        footnotes = F.when(F.size(cited) > 0, F.concat(F.lit(" Applicable footnotes: "), F.array_join(cited, " "))).otherwise(F.lit(""))
    text = F.concat("caption", F.lit(". "), "label", said, F.lit(f". {LEGEND}"), footnotes)
    return for_all(found.join(known, "table_id").select("question_id", "table_id", "row_index", text.alias("text")), askers)


def expand_datasets(candidates: DataFrame, datasets: DataFrame, score: float = 0.55) -> DataFrame:
    """Datasets linked to a candidate's fragment, each once a question."""
    linked = datasets.where("fragment_id is not null").select(F.col("fragment_id").alias("source_fragment_id"), F.col("dataset_id").alias("external_dataset_id"))
    rows = candidates.select("question_id", "source_fragment_id").distinct().join(linked, "source_fragment_id")
    return rows.groupBy("question_id", "external_dataset_id").agg(F.min("source_fragment_id").alias("source_fragment_id")).withColumn("base_score", F.lit(score))


def expand_spatial(candidates: DataFrame, locations: DataFrame, features: DataFrame, score: float = 0.7, bonus: float = 0.1) -> DataFrame:
    """Features of the candidates' datasets at each question's location; more where the feature lies within it.

    ``candidates``: question_id, dataset; ``locations``: question_id and a box; ``features``: feature_id, dataset and a box.
    """
    hits = spatial_match(locations, features).select("question_id", "feature_id", "dataset", "contains")
    wanted = hits.join(candidates.select("question_id", "dataset").distinct(), ["question_id", "dataset"])
    return wanted.select("question_id", "dataset", "feature_id", (F.lit(score) + F.when(F.col("contains"), bonus).otherwise(0.0)).alias("base_score"))


def section_labels(ref: Column) -> Column:
    """Forms under which a section reference may be labelled, in order."""
    plain = F.trim(F.regexp_replace(ref, r"\s+", " "))
    bare = F.regexp_replace(plain, r"(?i)^(section|subsection|clause)\s+", "")
    return F.array_distinct(F.array(plain, bare, F.regexp_replace(bare, r"(\d+)\((\d+)\)", "$1 ($2)"), F.concat(F.lit("Section "), bare)))


def resolve_section_refs(refs: DataFrame, fragments: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` fragments of the document, by page, whose label is one of a reference's forms.

    ``refs``: ref_id, document_id, ref. Forms explode and meet labels in an equi-join; a label brings
    no more than its own first ``k`` fragments, however many bear it.
    """
    forms = refs.select("ref_id", "document_id", F.explode(section_labels(F.col("ref"))).alias("citation_label"))
    place = ["document_id", "citation_label"]
    named = fragments.select(*place, "fragment_id", "page_start").join(forms.select(*place).distinct(), place, "left_semi")
    first = named.withColumn("r", F.row_number().over(Window.partitionBy(*place).orderBy("page_start", "fragment_id"))).where(F.col("r") <= k).drop("r")
    hits = forms.join(first, place).dropDuplicates(["ref_id", "fragment_id"])
    w = Window.partitionBy("ref_id").orderBy("page_start", "fragment_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("ref_id", "fragment_id", "rank")


def sections(calls: DataFrame, fragments: DataFrame) -> DataFrame:
    """(question_id, source_fragment_id, n): the first fragment with the label in the document asked for, and how many there are.

    Labels are counted before they meet ``calls`` (question_id, document_id, citation_label), one call a question.
    """
    place = ["document_id", "citation_label"]
    named = fragments.join(calls.select(*place).distinct(), place, "left_semi").groupBy(*place).agg(F.min("fragment_id").alias("source_fragment_id"), F.count(F.lit(1)).alias("n"))
    return calls.join(named, place).groupBy("question_id").agg(F.min("source_fragment_id").alias("source_fragment_id"), F.sum("n").alias("n"))


def definitions(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """Definitions of the terms that calls ask for; an exact term scores 3, one that starts with it 2.

    Both meet on the first word of the term, equal calls once.
    """
    calls, askers = asked_once(calls)
    word = lambda c: F.element_at(F.split(F.lower(c), " "), 1)
    asked = calls.select("question_id", F.lower("term").alias("asked"), word(F.col("term")).alias("w"))
    known = facts.select("fragment_id", F.lower("term").alias("known"), word(F.col("term")).alias("w"))
    score = F.when(F.col("known") == F.col("asked"), 3.0).when(F.col("known").startswith(F.col("asked")), 2.0)
    found = asked.join(known, "w").withColumn("base_score", score).where("base_score is not null")
    return for_all(found.select("question_id", F.col("fragment_id").alias("source_fragment_id"), "base_score"), askers)


def slot_reference(slot: Column) -> Column:
    """struct(kind, text) of a location slot: parcel, civic address, named place, then intersection; null without any.

    ``slot`` is struct(parcel_id, civic_number, street, named_place, intersection array).
    """
    made = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(full(slot["parcel_id"]), made("parcel_id", F.concat(F.lit("PID "), slot["parcel_id"])))
        .when(full(slot["civic_number"]) & full(slot["street"]), made("civic_address", F.concat_ws(" ", slot["civic_number"], slot["street"])))
        .when(full(slot["named_place"]), made("named_place", slot["named_place"]))
        .when(F.size(slot["intersection"]) >= 2, made("intersection", F.array_join(slot["intersection"], " and ")))
    )


def response_notes(requests: DataFrame) -> DataFrame:
    """(question_id, notes): advice where the query names an address but no location was given, or where one
    was given and not resolved. ``requests``: question_id, question, has_slot, resolved, detail.
    """
    from cadastra.operators.geo import CIVIC, PARCEL

    shaped = F.when(F.col("question").rlike(PARCEL), "a parcel id").when(F.col("question").rlike(CIVIC), "a civic address")
    missing = F.when(~F.col("has_slot") & shaped.isNotNull(), F.concat(F.lit("The query contains "), shaped, F.lit(" but no location was given.")))
    failed = F.when(F.col("has_slot") & ~F.col("resolved"), F.concat(F.lit("The location was not resolved ("), F.coalesce("detail", F.lit("unknown reason")), F.lit(").")))
    return requests.select("question_id", F.array_compact(F.array(missing, failed)).alias("notes"))


def linked_datasets(matches: DataFrame, datasets: DataFrame, summaries: DataFrame) -> DataFrame:
    """Each match with its datasets, each with its summary, as one array."""
    items = datasets.where("fragment_id is not null").join(summaries, "dataset", "left").select(F.col("fragment_id").alias("source_fragment_id"), F.struct("dataset_id", "dataset", "n", "low", "high").alias("item"))
    per = items.groupBy("source_fragment_id").agg(F.sort_array(F.collect_list("item")).alias("datasets"))
    return matches.join(per, "source_fragment_id", "left").withColumn("datasets", F.coalesce("datasets", F.expr("cast(array() as array<struct<dataset_id:bigint,dataset:string,n:bigint,low:double,high:double>>)")))


def build_match(hits: DataFrame, fragments: DataFrame, ancestors: DataFrame, refs: DataFrame, with_ancestors: bool = True, with_refs: bool = True) -> DataFrame:
    """One nested row per hit: its fragment, and on demand its ancestors and references."""
    out = hits.join(fragments.select(F.col("fragment_id").alias("source_fragment_id"), "citation_label", "text"), "source_fragment_id")
    if with_ancestors:
        out = out.join(ancestors.withColumnRenamed("fragment_id", "source_fragment_id"), "source_fragment_id", "left")
    if with_refs:
        targets = refs.groupBy(F.col("fragment_id").alias("source_fragment_id")).agg(F.array_sort(F.collect_set("target")).alias("references"))
        out = out.join(targets, "source_fragment_id", "left")
    return out


def coverage_verdicts(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """(address_id, verdict): failures of expected against found layers, or PASS.

    ``expected``: address_id, heritage boolean; ``hits``: address_id, layer, zone, height_m, storeys.
    """
    per = hits.groupBy("address_id").agg(
        F.max(F.when(F.col("layer") == "zone", F.col("zone"))).alias("zone"),
        F.max(F.when(F.col("layer") == "height", F.col("height_m"))).alias("height_m"),
        F.max(F.when(F.col("layer") == "height", F.col("storeys"))).alias("storeys"),
        F.bool_or(F.col("layer") == "heritage").alias("is_heritage"),
    )
    j = expected.join(per, "address_id", "left")
    said = F.array_compact(
        F.array(
            F.when(F.col("zone").isNull(), F.lit("FAIL[A]: no zone match")),
            F.when(~F.col("height_m").between(8, 145), F.lit("FAIL[B]: height out of range")),
            F.when(~F.col("storeys").between(3, 40), F.lit("FAIL[B]: storeys out of range")),
            F.when(F.col("height_m").isNotNull() & F.col("storeys").isNotNull(), F.lit("FAIL[A]: both height and storeys set")),
            F.when(~F.col("heritage") & F.coalesce("is_heritage", F.lit(False)), F.lit("FAIL[D]: unexpected heritage match")),
            F.when(F.col("heritage") & ~F.coalesce("is_heritage", F.lit(False)), F.lit("WARN[D]: no heritage match")),
        )
    )
    return j.select("address_id", F.when(F.size(said) == 0, "PASS").otherwise(F.array_join(said, " ; ")).alias("verdict"))


def search_context(calls: DataFrame, fragments: DataFrame, rules: Sequence[tuple[str, float]], k: int = 8) -> DataFrame:
    """Share of a call's terms, plus the points of scoring rules that fit the fragment, the ``k`` best.

    Rules are a configuration of (pattern, points), applied once per fragment.
    """
    terms = calls.select("question_id", F.array_distinct(query_terms(F.col("question"))).alias("terms"))
    points = sum((F.when(F.col("text").rlike(pattern), value).otherwise(0.0) for pattern, value in rules), F.lit(0.0))
    texts = fragments.select(F.col("fragment_id").alias("source_fragment_id"), "text")
    return any_term_candidates(terms, texts, k, texts.select("source_fragment_id", points.alias("points")))
