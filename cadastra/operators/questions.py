"""Understanding of questions: terms, zones, uses, standards, semantic requests, plans; all in column expressions."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators import semantic as S
from cadastra.operators.sharing import read_once

# Vocabularies, patterns and result names of question understanding and planning.
STOP_WORDS = ("what", "are", "the", "for", "with", "that", "this", "from", "into", "can", "how", "many", "does", "zone", "uses", "use")
TOPICS = {
    "definition": ("define", "definition", "meaning"),
    "permitted_use": ("permitted", "allowed", "temporary use", "use"),
    "setback": ("setback", "yard"),
    "height": ("height", "storey", "storeys", "story", "stories"),
    "parking": ("parking", "stall"),
    "open_space": ("open space", "landscaped open space"),
    "density": ("density", "persons per acre"),
    "exception": ("except", "exception", "unless"),
    "cross_reference": ("subject to", "see section", "cross reference"),
    "applicability": ("apply", "applies", "applicable"),
}
SECTION_TYPES = {
    "schedule": ("schedule",),
    "table": ("table",),
    "section": ("section", "subsection", "clause"),
    "definition": ("definition", "defined"),
}
LEGAL_TERMS = ("temporary use", "residential zones", "minimum lot area")
DIMENSIONS = {
    "minimum lot area": ("minimum lot area", "lot area minimum", "minimum area"),
    "maximum height": ("maximum height", "height maximum", "height limit"),
    "lot frontage": ("lot frontage", "frontage minimum", "minimum frontage"),
    "lot coverage": ("lot coverage", "coverage maximum", "maximum coverage"),
    "open space": ("open space", "landscaped open space"),
    "population density": ("population density", "persons per acre", "density"),
}
STORY_WORDS = ("story", "stories", "storey", "storeys")
ZONE_WORD = r"(?i)\b([A-Z]{1,3}-?\d[A-Z]?(?:-?[A-Z])?)\b"
USE_WORD = r"(temporary use|residential use|parking)"
CITATION = r"(?i)(?:section|subsection|clause|schedule)\s+([A-Za-z0-9\.\(\)]+)"
PLAN_CITATION = r"(?i)(?:section|subsection|clause|schedule)\s+([A-Za-z0-9\.\(\)-]+)"
PLAN_ZONE = r"\b([A-Z]{1,3})-?\s?(\d[A-Z]?)(?:-?\s?([A-Z]))?\b"
STANDARD_ALIASES = {
    "front_yard": ("front yard", "front setback", "frontyard", "front-yard"),
    "side_yard": ("side yard", "side setback", "sideyard", "side-yard"),
    "rear_yard": ("rear yard", "rear setback", "back yard", "backyard", "back-yard"),
    "flankage_yard": ("flankage yard", "flanking yard", "flankage setback"),
    "building_height": ("height", "building height", "maximum height", "stories", "storeys"),
    "lot_frontage": ("frontage", "lot frontage", "street frontage", "required frontage"),
    "lot_area": ("lot area", "minimum lot area", "lot size"),
    "lot_coverage": ("lot coverage", "coverage"),
    "open_space": ("open space", "landscaped open space", "amenity space"),
    "density": ("density", "population density", "persons per acre", "units per acre"),
    "parking": ("parking", "parking requirement", "parking spaces", "stalls"),
    "accessory_structure": ("accessory building", "accessory buildings", "accessory structure", "accessory structures"),
}
USE_PHRASE = r"\b([a-z][a-z0-9-]*(?:\s+[a-z][a-z0-9-]*){0,5}\s+use)\b"
NOT_USES = ("land use", "permitted use", "temporary use")
PLAN_STOPS = ("a", "an", "the", "my", "this", "that", "any", "use", "uses", "operate", "have", "build", "permit", "permitted", "allowed", "can", "i", "we", "is", "are", "does", "in", "within", "zone")
FACT_STOPS = ("a", "an", "the", "what", "which", "does", "do", "condition", "conditions", "apply", "applies", "to", "for", "require", "requires", "parking", "operate", "allowed", "permitted", "can", "i", "is", "are")
FACT_STOP_FORM = r"^([a-z]{1,4}-?\d[a-z]?|\d+)$"
PERMISSION_WORDS = ("permitted", "allowed", "can i", "can a", "can an", "operate", "have", "build")
REQUEST_PERMISSION_WORDS = ("permitted", "allowed", "can i", "can a", "can an", "operate")
REQUEST_STANDARD_WORDS = ("minimum", "maximum", "required", "height", "setback", "frontage", "lot area", "lot coverage")
TERM_PREFIXES = ("what is a ", "what is an ", "what is the ", "what is ", "define a ", "define an ", "define the ", "define ")
CONTEXT_WORDS = ("day care", "apartment house", "south end", "schedule a", "schedule b")
PERMISSION_TABLES = "permitted Tables 1A 1B 1C 1D black dot white circle"


def has_any(t: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words, inside other words too."""
    return functools.reduce(lambda a, b: a | b, [t.contains(w) for w in words])


def query_terms(q: Column, min_len: int = 2) -> Column:
    """Lower-cased words of letters and digits, without stop words and short ones, in order."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(q), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(*STOP_WORDS))


def normalized(q: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(q), r"\s+", " "))


def _named(t: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Names, in their order, of which a word is in the text."""
    return F.array_compact(F.array(*[F.when(has_any(t, w), F.lit(name)) for name, w in words.items()]))


def topics(q: Column) -> Column:
    return _named(normalized(q), TOPICS)


def concepts(q: Column) -> Column:
    """Legal terms, dimensions, and ``maximum height`` for words of storeys; a name may come twice."""
    t = normalized(q)
    story = F.when(has_any(t, STORY_WORDS), F.array(F.lit("maximum height"))).otherwise(F.array().cast("array<string>"))
    return F.concat(_named(t, {w: (w,) for w in LEGAL_TERMS}), _named(t, DIMENSIONS), story)


def section_types(q: Column) -> Column:
    return _named(normalized(q), SECTION_TYPES)


def zone_keywords(q: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.upper(q), F.lit(ZONE_WORD), F.lit(1)), lambda z: F.replace(F.upper(z), F.lit("-"), F.lit("")))


def use_keywords(q: Column) -> Column:
    return F.regexp_extract_all(normalized(q), F.lit(USE_WORD), F.lit(1))


def citation_guesses(q: Column) -> Column:
    return F.regexp_extract_all(q, F.lit(CITATION), F.lit(1))


def needs_definitions(q: Column) -> Column:
    return has_any(normalized(q), TOPICS["definition"]) | normalized(q).startswith("what is")


def zone_code(q: Column) -> Column:
    """A known code in the text (longer ones first), else the first code in order that the extractor
    finds, else a generic code with hyphens put in; else null."""
    upper = F.upper(q)
    known = [F.when(upper.rlike(rf"(?<![A-Z0-9]){code}(?![A-Z0-9])"), F.lit(code)) for code in sorted(S.KNOWN_ZONES, key=len, reverse=True)]
    parts = [F.regexp_extract(upper, PLAN_ZONE, i) for i in (1, 2, 3)]
    generic = F.when(parts[1] != "", F.concat(parts[0], F.lit("-"), parts[1], F.when(parts[2] != "", F.concat(F.lit("-"), parts[2])).otherwise("")))
    return F.coalesce(*known, F.get(S.extract_zones(q), F.lit(0)), generic)


def standard_type(q: Column) -> Column:
    """Name of the standard that a question asks for: special cases, then aliases in their order."""
    t = F.replace(F.lower(q), F.lit("-"), F.lit(" "))
    compact = F.replace(t, F.lit(" "), F.lit(""))
    out = F.when(t.contains("backyard suite"), F.lit(None).cast("string"))
    out = out.when(t.contains("accessory") & has_any(t, ("building", "structure")), "accessory_structure")
    out = out.when(t.contains("parking"), "parking").when(t.contains("open space"), "open_space")
    out = out.when(has_any(t, ("density", "persons per acre", "dwelling units")), "density")
    for name, aliases in STANDARD_ALIASES.items():
        out = out.when(has_any(t, aliases) | has_any(compact, [a.replace(" ", "") for a in aliases]), name)
    return out.when(has_any(t, ("setback", "yard")), "setback")


def _bare_words(phrase: Column, stops: tuple[str, ...], form: str | None) -> Column:
    """The words of a phrase after leading stop words (and words of a form)."""
    words = F.split(phrase, r"\s+")
    stays = F.transform(words, lambda w: ~(w.isin(*stops) | (w.rlike(form) if form else F.lit(False))))
    at = F.array_position(stays, True).cast("int")
    return F.when(at > 0, F.slice(words, at, F.size(words))).otherwise(F.array().cast("array<string>"))


def use_name(q: Column, pick: str = "first") -> Column:
    """The ``… use`` phrase of a question, without leading stop words; null without one.

    ``first`` takes the first of five words at most, as plans and searches do; ``shortest`` the
    canonical one with the fewest words and characters, as the fact channel does.
    """
    phrases = F.regexp_extract_all(F.regexp_replace(F.lower(q), "[^a-z0-9 -]+", " "), F.lit(USE_PHRASE), F.lit(1))
    if pick == "first":
        bare = F.transform(phrases, lambda p: _bare_words(p, PLAN_STOPS, None))
        found = F.filter(bare, lambda w: (F.size(w) > 0) & (F.size(w) <= 5) & ~F.array_join(w, " ").isin(*NOT_USES))
        return F.array_join(F.get(found, F.lit(0)), " ")
    names = F.transform(phrases, lambda p: S.normalize_use(F.array_join(_bare_words(p, FACT_STOPS, FACT_STOP_FORM), " ")))
    found = F.filter(names, lambda n: (n != "") & ~n.isin(*NOT_USES))
    # Without the place in the list, equally long names would be told apart by letters.
    ranked = F.transform(found, lambda n, i: F.struct(F.size(F.split(n, r"\s+")).alias("words"), F.length(n).alias("chars"), i.alias("place"), n.alias("name")))
    return F.get(F.array_sort(ranked), F.lit(0))["name"]


def defined_term(q: Column) -> Column:
    """What follows ``what is`` or ``define`` and an article, as a canonical name; null without one."""
    t = F.trim(F.regexp_replace(F.lower(q), "[^a-z0-9 -]+", " "))
    out = None
    for prefix in TERM_PREFIXES:
        rest = S.normalize_use(F.trim(F.substring(t, len(prefix) + 1, 1 << 30)))
        out = (F if out is None else out).when(t.startswith(prefix), F.when(rest != "", rest))
    return out


def understand(questions: DataFrame) -> DataFrame:
    """``questions`` (question_id, question) plus topics, concepts, section_types, zones, uses, citations and needs_definitions."""
    q = F.col("question")
    said = (
        topics(q).alias("topics"),
        concepts(q).alias("concepts"),
        section_types(q).alias("section_types"),
        zone_keywords(q).alias("zones"),
        use_keywords(q).alias("uses"),
        citation_guesses(q).alias("citations"),
        needs_definitions(q).alias("needs_definitions"),
    )
    return read_once(questions, "question", lambda rows: rows.select("*", *said))


def semantic_request(questions: DataFrame) -> DataFrame:
    """``questions`` plus relation_types array<string> and entities array<struct<type, name>>: what facts to look for."""
    q = F.col("question")
    low = F.lower(q)
    standards, markers, contexts, zones = S.extract_standards(q), S.extract_condition_refs(q), S.extract_contexts(q), S.extract_zones(q)
    asks_permission = has_any(low, REQUEST_PERMISSION_WORDS) | (low.contains("condition") & has_any(low, ("apply", "applies", "permitted", "allowed")))
    defines = low.contains("define") | low.startswith("what is ")
    kinds = (
        (asks_permission, "permission"),
        (low.contains("parking"), "parking_standard"),
        (F.size(contexts) > 0, "requirement"),
        ((F.size(standards) > 0) | has_any(low, REQUEST_STANDARD_WORDS), "dimensional_standard"),
        (F.size(markers) > 0, "condition_definition"),
        (defines, "definition"),
    )
    term = F.when(defines & (F.size(zones) == 0) & (F.size(standards) == 0), defined_term(q))

    def entities(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))

    found = F.concat(
        entities("zone", zones),
        entities("standard", standards),
        entities("development_context", contexts),
        entities("condition_ref", markers),
        entities("use", F.array_compact(F.array(use_name(low, "shortest")))),
        entities("defined_term", F.array_compact(F.array(term))),
    )
    return questions.select("*", F.array_compact(F.array(*[F.when(when, F.lit(kind)) for when, kind in kinds])).alias("relation_types"), found.alias("entities"))


def asked_use(q: Column) -> Column:
    """The use that a plan is about: named ones by a fixed precedence, else the phrase of a question about permission."""
    low = F.lower(q)
    asks = has_any(low, PERMISSION_WORDS)
    return (
        F.when(low.contains("accessory structure") & has_any(low, ("permit", "permitted", "allowed", "can ")), "accessory structure or use")
        .when(low.rlike(r"\boffice\s+use\b"), "office use")
        .when(has_any(low, ("single-unit dwelling", "single unit dwelling")) & asks, "single-unit dwelling use")
        .when(low.contains("townhouse") & asks, "townhouse dwelling use")
        .when(low.contains("shipping container"), "shipping container")
        .when(low.contains("backyard suite"), "backyard suite use")
        .when(low.contains("daycare"), "daycare use")
        .when(low.contains("day care"), "day care facility")
        .when(asks, use_name(low, "first"))
    )


def retrieval_plan(questions: DataFrame) -> DataFrame:
    """Ordered lookups of each question: (question_id, intent, step, tool, zone, standard_type, use_type, area_context, argument).

    The intent gives the calls; then calls that a zone, a standard, a use or parking need are added
    where they are missing. ``argument`` is the text, label or term that a tool looks up. Equal questions are planned once.
    """
    return read_once(questions.select("question_id", "question"), "question", _plan).drop("question")


def _plan(questions: DataFrame) -> DataFrame:
    """``questions`` with the lookups of each, a row for each step."""
    q, low = F.col("question"), F.lower("question")
    base = questions.select(
        "*",
        zone_code(q).alias("zone"),
        standard_type(q).alias("standard"),
        asked_use(q).alias("use"),
        F.regexp_extract(q, PLAN_CITATION, 1).alias("citation"),
        F.when(low.contains("south end"), "South End").alias("area"),
        has_any(low, PERMISSION_WORDS).alias("asks"),
        F.trim(F.regexp_replace(F.regexp_replace(low, r"^(what is|what does|define)\s+", ""), r"^[ ?]+|[ ?]+$", "")).alias("term"),
        (low.startswith("what is") | low.contains("define")).alias("defines"),
        has_any(low, CONTEXT_WORDS).alias("wide"),
    )
    zone, standard, use, question = F.col("zone"), F.col("standard"), F.col("use"), F.col("question")
    intent = (
        F.when((use == "backyard suite use") | (use.isNotNull() & F.col("asks")), "lookup_use_permission")
        .when(standard == "parking", "lookup_parking_requirement")
        .when(standard.isNotNull(), "lookup_dimensional_standard")
        .when(F.col("citation") != "", "retrieve_section")
        .when(F.col("defines"), "lookup_definition")
        .otherwise("general_context_search")
    )
    none = F.lit(None).cast("string")

    def call(when: Column, tool: str, **args: Column) -> Column:
        fields = [args.get(a, none).alias(a) for a in ("zone", "standard_type", "use_type", "area_context", "argument")]
        return F.when(when, F.struct(F.lit(tool).alias("tool"), *fields))

    plan = base.withColumn("intent", intent)
    kind = F.col("intent")
    permission, dimension = kind == "lookup_use_permission", kind.isin("lookup_parking_requirement", "lookup_dimensional_standard")
    wide_query = F.concat(question, F.lit(" "), use, F.lit(" " + PERMISSION_TABLES))
    searches = permission | (dimension & (zone.isNull() | F.col("wide"))) | (kind == "general_context_search")
    calls = F.array(
        call(use.isNotNull() & F.col("asks"), "search_context", argument=wide_query),
        call(standard.isNotNull() & zone.isNotNull(), "get_standard", zone=zone, standard_type=standard, use_type=use, area_context=F.col("area")),
        call(permission, "search_context", argument=wide_query),
        call(zone.isNotNull() & (permission | dimension), "get_zone_context", zone=zone),
        call(dimension & (zone.isNull() | F.col("wide")), "search_context", argument=question),
        call(kind == "retrieve_section", "get_section", argument=F.col("citation")),
        call(kind == "lookup_definition", "get_definitions", argument=F.col("term")),
        call(kind == "general_context_search", "search_context", argument=question),
        call(zone.isNotNull() & ~(permission | dimension), "get_zone_context", zone=zone),
        call((standard == "parking") & ~searches, "search_context", argument=question),
    )
    steps = plan.select(*questions.columns, "intent", F.posexplode(F.array_compact(calls)).alias("step", "call"))
    return steps.select(*questions.columns, "intent", F.col("step").cast("long").alias("step"), "call.*")
