"""What a document says about a standard (a yard, a height, parking) in a zone: ranked tables, rules and blocks.

Lookups go from the best source to the weakest, and each sees only what those before it left open:
a zone's pages come from its heading, else from its built-form heading, else from a heading that names
it, else from any fragment that does. All joins are equi-joins on the document (and page); what is
joined within a document is one standard's marked tables, rules and blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.questions import STANDARD_ALIASES
from cadastra.operators.sharing import BROADCAST_ASKERS
from cadastra.sources.lineage import cut, written

# Words that mark a standard in a text, headings, and points of a source by what it says.
STANDARD_MARKERS = {
    "front_yard": ("front yard", "front setback", "frontyard", "front or flanking setback", "minimum required front or flanking setback", "official street line", "street line"),
    "side_yard": ("side yard", "side setback", "sideyard", "lot line", "distance from lot line"),
    "rear_yard": ("rear yard", "rear setback", "back yard", "backyard", "lot line", "distance from lot line"),
    "flankage_yard": ("flankage yard", "flanking yard"),
    "building_height": ("maximum height", "height maximum", "building height", "height", "size of building", "angular plane", "angular planes", "vertical angle", "60 degrees"),
    "lot_frontage": ("lot frontage", "frontage minimum", "minimum frontage", "frontage"),
    "lot_area": ("lot area minimum", "minimum lot area", "lot area"),
    "lot_coverage": ("lot coverage maximum", "maximum lot coverage", "lot coverage"),
    "open_space": ("open space", "landscaped open space"),
    "density": ("population density", "persons per acre", "density", "dwelling units", "lot area"),
    "parking": ("parking", "parking space", "parking spaces", "stalls"),
    "accessory_structure": ("accessory building", "accessory buildings", "accessory structure", "accessory structures", "footprint", "maximum size of its footprint"),
    "setback": ("setback", "yard", "official street line", "lot line", "distance from lot line"),
}
ZONE_HEADING = r"\b[A-Z]{1,3}-?\d[A-Z]?(?:-?[A-Z])?\s+ZONE\b"
BUILT_FORM = "BUILT FORM AND SITING REQUIREMENTS WITHIN"
SECTION_PAGES, CONTEXT_BLOCKS, INTRO_BLOCKS, INTRO_PAGES, CHILDREN, NEAR_BLOCKS = 16, 5, 8, 3, 8, 8
#: (condition over standard, c = the combined text in small letters, t = the table's, p = the page's context; points), in SQL for both engines.
TABLE_POINTS = (
    ("contains(p, 'requirements')", 0.5),
    ("standard IN ('front_yard', 'side_yard', 'rear_yard', 'lot_frontage', 'lot_area') AND contains(t, 'lot frontage') AND contains(t, 'lot area')", 0.75),
    ("standard IN ('side_yard', 'lot_coverage', 'lot_area', 'lot_frontage') AND NOT has_digit", -2.0),
    ("standard = 'building_height' AND (contains(c, 'angular plane') OR contains(c, 'vertical angle') OR contains(c, 'size of building'))", 1.0),
    ("standard = 'building_height' AND contains(c, 'size of building')", 2.0),
    ("standard = 'building_height' AND contains(c, 'distance between external walls')", -1.25),
    ("standard = 'building_height' AND contains(c, 'balconies, cornices, eaves, and canopies')", -1.25),
    ("standard IN ('front_yard', 'side_yard', 'rear_yard', 'setback') AND contains(c, 'distance from lot line')", 1.0),
    ("standard = 'parking' AND (contains(c, 'required to provide') OR contains(c, 'shall be required') OR contains(c, 'one parking space') OR contains(c, '1 space'))", 1.5),
    ("standard = 'parking' AND contains(c, use_low)", 3.0),
    ("standard = 'parking' AND contains(c, 'parking lots and parking structures existing')", -1.0),
    ("standard = 'parking' AND contains(c, 'special parking')", 0.75),
    ("contains(c, area_low)", 2.0),
    ("standard = 'density' AND (contains(c, 'persons per acre') OR contains(c, 'dwelling units') OR contains(c, 'lot area'))", 2.0),
    ("standard = 'open_space' AND (contains(c, 'two or more bedrooms') OR contains(c, '120 square feet') OR contains(c, 'landscaped open space'))", 2.0),
    ("standard = 'accessory_structure' AND contains(c, 'may be located')", 2.0),
)
RULE_POINTS = (
    ("standard = 'building_height' AND contains(c, 'maximum required building height specified on schedule 15')", 1.5),
    ("standard IN ('front_yard', 'flankage_yard', 'setback') AND contains(c, 'minimum required front or flanking setback')", 1.0),
    ("standard IN ('front_yard', 'flankage_yard', 'setback') AND contains(c, '1.5 metres')", 0.75),
    ("standard IN ('front_yard', 'flankage_yard', 'setback') AND contains(c, 'maximum front or flanking setback')", -0.75),
)
NEAR_POINTS = (
    ("has_measure", 0.4),
    ("standard = 'side_yard' AND contains(c, 'townhouse dwelling use') AND contains(c, '3.0 metres elsewhere')", 1.5),
    ("standard = 'accessory_structure' AND (contains(c, 'maximum size of its footprint') OR contains(c, '60.0 square metres'))", 1.75),
)
ACCESSORY_POINTS = (
    ("contains(c, 'maximum size of its footprint') OR contains(c, '60.0 square metres')", 2.0),
    ("contains(c, 'may be located')", 1.0),
)
PARKING_POINTS = (
    ("contains(c, 'one separately accessible parking space') OR contains(c, 'one parking space')", 2.0),
    ("contains(c, 'square feet')", 1.5),
)
MEASURE = r"\d+(?:\.\d+)?\s*(?:metres?|square metres?|%)"
CHILD_VALUE = r"(?i)\d|%|metres?|feet|storeys?|units?"


def markers(standard: str) -> list[str]:
    """Words of a standard without blanks, as they are looked for."""
    return sorted({m.replace(" ", "") for m in (*STANDARD_MARKERS.get(standard, ()), *STANDARD_ALIASES.get(standard, ()))})


def compact(t: Column) -> Column:
    return F.translate(t, "- ", "")


def marked(text: Column, standard: Column) -> Column:
    """Whether a text holds a word of its standard; blanks and hyphens do not matter."""
    low, found = compact(F.lower(text)), F.when(standard.isNull(), False)
    for s in STANDARD_MARKERS:
        found = found.when(standard == s, low.rlike("|".join(re.escape(m) for m in markers(s))))  # a text is made compact once
    return F.coalesce(found, F.lit(False))


def names_zone(text: Column, zone: Column) -> Column:
    return F.contains(compact(F.upper(text)), compact(F.upper(zone)))


def points(rules: tuple[tuple[str, float], ...]) -> Column:
    total = F.lit(0.0)
    for condition, value in rules:
        total = total + F.when(F.expr(condition), F.lit(value)).otherwise(F.lit(0.0))
    return total


def joined_blocks(rows: DataFrame, keys: list[str], order: list[str], text: str, limit: int | None = None) -> DataFrame:
    """Per key the texts in their order, ``limit`` of them at most, joined by a blank."""
    if limit:
        rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= limit)
    held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("h"))
    return held.select(*keys, F.array_join(F.transform("h", lambda x: x["t"]), " ").alias("joined"))


def zone_sections(zones: DataFrame, blocks: DataFrame, fragments: DataFrame) -> DataFrame:
    """(document_id, zone, tier, first_pages, start, last) of ``zones`` (document_id, zone) that a document names.

    The best tier gives the pages; the section runs from the first of them to the page before the next
    heading of a zone, over 16 pages at most.
    """
    upper = F.upper("text")
    clean = F.trim(F.regexp_replace(upper, r"\s+", " "))
    short = F.replace(F.upper("zone"), F.lit("-"), F.lit(""))
    # A heading of any kind holds one of two words; only texts that do are moved and read by patterns.
    bare = F.replace(upper, F.lit("-"), F.lit(""))
    seen = written(blocks.where(bare.contains("ZONE") | bare.contains("BUILT")).select("document_id", "page_number", upper.alias("u"), clean.alias("clean")))
    holds = F.contains(F.replace(F.col("u"), F.lit("-"), F.lit("")), short)
    built, dots = F.col("clean").contains(BUILT_FORM), F.col("clean").contains(".....")
    tier = (
        F.when(F.replace(F.col("clean"), F.lit("-"), F.lit("")) == F.concat(short, F.lit(" ZONE")), 1)
        .when(built & holds, 2)
        .when(holds & ~dots & (F.col("u").rlike(ZONE_HEADING) | built), 3)
    )
    by_block = cut(zones.join(seen, "document_id").where(holds).withColumn("tier", tier).where("tier is not null").select("document_id", "zone", "tier", "page_number").distinct())
    left = zones.join(by_block, ["document_id", "zone"], "left_anti")
    told = fragments.select("document_id", F.col("page_start").alias("page_number"), "text")
    by_fragment = left.join(told, "document_id").where(F.contains(bare, short)).select("document_id", "zone", F.lit(4).alias("tier"), "page_number").distinct()
    # The first pages of the best tier are the first of all by tier and page.
    nth = F.row_number().over(Window.partitionBy("document_id", "zone").orderBy("tier", "page_number"))
    firsts = by_block.unionByName(by_fragment).withColumn("n", nth).where("n <= 3").groupBy("document_id", "zone").agg(F.min("tier").alias("tier"), F.sort_array(F.collect_list(F.struct("tier", "page_number"))).alias("h"))
    of_best = F.transform(F.filter("h", lambda x: x["tier"] == F.col("tier")), lambda x: x["page_number"])
    starts = firsts.select("document_id", "zone", "tier", of_best.alias("first_pages")).withColumn("start", F.col("first_pages")[0])
    heads = seen.where(~dots & (built | F.col("clean").rlike(f"^(?:{ZONE_HEADING})$"))).select("document_id", F.col("page_number").alias("head")).distinct()
    after = starts.join(heads, "document_id").where("head > start").groupBy("document_id", "zone").agg(F.min("head").alias("head"))
    last = F.least(F.col("start") + SECTION_PAGES - 1, F.coalesce(F.col("head") - 1, F.col("start") + SECTION_PAGES - 1))
    return starts.join(after, ["document_id", "zone"], "left").select("document_id", "zone", "tier", "first_pages", "start", last.alias("last"))


def get_standard(calls: DataFrame, blocks: DataFrame, tables: DataFrame, fragments: DataFrame, k: int = 10) -> DataFrame:
    """(question_id, rank, stage, tier, source_table_id, source_fragment_id, page, base_score, text): the
    max(k, 8) best sources of each call, ties by stage and id.

    ``calls``: question_id, document_id, zone, standard_type, use_type, area_context; ``blocks``: document_id,
    page_number, reading_order, text, without boilerplate; ``tables``: document_id, table_id, page_start, text;
    ``fragments``: document_id, fragment_id, parent_fragment_id, page_start, reading_order, text.

    Stages: ``table`` and, on the zone's pages, ``rule``, its ``child`` fragments and the ``near`` blocks after
    it; ``accessory`` rules anywhere in the document; ``parking`` blocks that name the use. Without a zone
    (or where the document does not name it) tables of the whole document count, and no rules. A source
    comes once for each stage. A call without a standard gives nothing.
    """
    asked = calls.where("standard_type is not null and document_id is not null").select(
        "question_id", "document_id", F.col("zone"), F.col("standard_type").alias("standard"), F.lower("use_type").alias("use_low"), F.lower("area_context").alias("area_low")
    )
    sections = cut(zone_sections(asked.where("zone is not null").select("document_id", "zone").distinct(), blocks, fragments))
    ranged = cut(asked.join(sections, ["document_id", "zone"], "left"))
    within = lambda page: F.col(page).between(F.col("start"), F.col("last"))
    zoned = F.col("zone").isNotNull()

    # Tables, with what their page and the zone's first pages say before them.
    told = tables.select("document_id", "table_id", F.col("page_start").alias("page"), F.col("text").alias("table_text"))
    accessory = F.col("standard") == "accessory_structure"
    hit = ranged.join(told, "document_id").where((F.col("start").isNull() | within("page") | accessory) & marked(F.col("table_text"), F.col("standard")))
    t = F.lower("table_text")
    hit = cut(hit.where(~((F.col("standard") == "parking") & t.contains("parking lots and parking structures existing")) & ~(accessory & t.contains("deleted") & ~t.contains("may be located"))))
    low = F.lower("text")
    words = low.contains("requirements") | low.contains("yard") | low.contains("height") | low.contains("frontage") | low.contains("lot area")
    spots = hit.select("document_id", "page", "zone").distinct()
    around = spots.join(blocks.withColumnRenamed("page_number", "page"), ["document_id", "page"]).where(words | F.coalesce(names_zone(F.col("text"), F.col("zone")), F.lit(False)))
    context = joined_blocks(around, ["document_id", "page", "zone"], ["reading_order"], "text", CONTEXT_BLOCKS).withColumnRenamed("joined", "context")
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    general = low.contains("multiple dwelling zone") | low.contains("general residential")
    rule = low.contains("where any building") & low.contains("shall comply with the following requirements")
    shown = sections.join(blocks.where(F.upper("text").contains("ZONE") | general | rule), "document_id").where(F.col("page_number").between(F.col("start"), F.least(F.col("last"), F.col("start") + INTRO_PAGES - 1)))
    forms = F.upper(clean).isin(F.concat(F.upper("zone"), F.lit(" ZONE"))) | (F.upper(clean) == F.concat(F.replace(F.upper("zone"), F.lit("-"), F.lit("")), F.lit(" ZONE")))
    intro = joined_blocks(shown.where(forms | (general & (F.length(clean) < 120)) | rule), ["document_id", "zone"], ["page_number", "reading_order"], "text", INTRO_BLOCKS).withColumnRenamed("joined", "intro")
    beside_it = context.select(F.col("document_id").alias("__d"), F.col("page").alias("__p"), F.col("zone").alias("__z"), "context")
    here_too = (F.col("document_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & F.col("zone").eqNullSafe(F.col("__z"))
    placed = hit.join(intro, ["document_id", "zone"], "left").join(beside_it, here_too, "left").drop("__d", "__p", "__z")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    placed = placed.withColumn("text", F.trim(F.concat_ws(" ", F.when(~accessory, some("intro")), some("context"), some("table_text"))))
    placed = placed.withColumn("c", F.lower("text")).withColumn("t", F.lower("table_text")).withColumn("p", F.lower(F.coalesce("context", F.lit("")))).withColumn("has_digit", F.col("table_text").rlike(r"\d"))
    here = F.coalesce(names_zone(F.col("text"), F.col("zone")), F.lit(False))
    fits = (~zoned | accessory | here) & (F.col("use_low").isNull() | (F.col("standard") == "parking") | F.coalesce(F.contains("c", "use_low"), F.lit(False)))
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    score = 4.0 + one(marked(F.col("text"), F.col("standard"))) + one(here) + one(F.array_contains("first_pages", F.col("page"))) + points(TABLE_POINTS)
    none = F.lit(None).cast("long")
    found = placed.where(fits).select("question_id", F.lit("table").alias("stage"), "tier", F.col("table_id").alias("source_table_id"), none.alias("source_fragment_id"), "page", score.alias("base_score"), "text")

    # Rules on the zone's pages, their children, and the blocks after them.
    said = fragments.select("document_id", "fragment_id", "reading_order", F.col("page_start").alias("page"), "text")
    met = ranged.where(F.col("start").isNotNull() | accessory).join(said, "document_id")
    is_rule = F.col("start").isNotNull() & within("page") & marked(F.col("text"), F.col("standard"))
    is_accessory = accessory & (low.contains("accessory building") | low.contains("accessory structure") | low.contains("footprint"))
    met = met.where(is_rule | is_accessory).withColumn("c", low)
    as_rule = F.struct(F.lit("rule").alias("stage"), (3.5 + points(RULE_POINTS)).alias("base_score"))
    as_accessory = F.struct(F.lit("accessory").alias("stage"), (4.0 + points(ACCESSORY_POINTS)).alias("base_score"))
    met = met.withColumn("as", F.explode(F.array_compact(F.array(F.when(is_rule, as_rule), F.when(is_accessory, as_accessory)))))
    both = written(met.select("question_id", "document_id", "zone", "standard", "tier", "fragment_id", "reading_order", "page", "text", "as.*"))
    heads = both.where("stage = 'rule'").select("question_id", "tier", F.col("fragment_id").alias("parent"), (F.col("base_score") - 0.05).alias("base_score"))
    kids = fragments.select(F.col("parent_fragment_id").alias("parent"), "fragment_id", F.col("page_start").alias("kid_page"), F.col("text").alias("kid_text")).where("parent is not null").join(heads.select("parent"), "parent", "left_semi")
    kids = kids.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("fragment_id"))).where((F.col("r") <= CHILDREN) & F.col("kid_text").rlike(CHILD_VALUE))
    children = heads.join(kids, "parent").select("question_id", F.lit("child").alias("stage"), "tier", none.alias("source_table_id"), F.col("fragment_id").alias("source_fragment_id"), F.col("kid_page").alias("page"), "base_score", F.col("kid_text").alias("text"))
    # Blocks meet a rule by stretches of as many numbers as are near it, of which it touches two at most.
    stretch = f"{NEAR_BLOCKS + 1}"
    spread = both.where("reading_order is not null").select("document_id", "fragment_id", F.col("reading_order").alias("o")).distinct().withColumn("stretch", F.explode(F.expr(f"sequence(o div {stretch}, (o + {NEAR_BLOCKS}) div {stretch})")))
    lined = blocks.select("document_id", "reading_order", "text", F.expr(f"reading_order div {stretch}").alias("stretch"))
    near = joined_blocks(spread.join(lined, ["document_id", "stretch"]).where(F.col("reading_order").between(F.col("o"), F.col("o") + NEAR_BLOCKS)), ["document_id", "fragment_id"], ["reading_order"], "text")
    beside = both.drop("text").join(near, ["document_id", "fragment_id"]).where(F.col("joined").rlike(r"\d") | marked(F.col("joined"), F.col("standard")))
    beside = beside.withColumn("c", F.lower("joined")).withColumn("has_measure", F.col("c").rlike(MEASURE))
    near_score = F.col("base_score") - 0.03 + points(NEAR_POINTS) + F.when(F.coalesce(names_zone(F.col("joined"), F.col("zone")), F.lit(False)), 0.35).otherwise(0.0)
    near_rows = beside.select("question_id", F.lit("near").alias("stage"), "tier", none.alias("source_table_id"), F.col("fragment_id").alias("source_fragment_id"), "page", near_score.alias("base_score"), F.col("joined").alias("text"))
    own = both.select("question_id", "stage", "tier", none.alias("source_table_id"), F.col("fragment_id").alias("source_fragment_id"), "page", "base_score", "text")

    # Blocks about parking for the use.
    terms = F.filter(F.split(F.regexp_replace("use_low", "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2)
    parking = ranged.where("standard = 'parking' and use_low is not null").withColumn("terms", terms)
    asked_of = parking.select("document_id").distinct()
    # Most documents are not asked about parking: their blocks are not moved where the others can be broadcast.
    told = blocks.join(F.broadcast(asked_of), "document_id", "left_semi") if asked_of.count() <= BROADCAST_ASKERS else blocks
    parking = parking.join(told.select("document_id", "page_number", "reading_order", "text"), "document_id").withColumn("c", F.lower("text"))
    any_term = parking.where(F.exists("terms", lambda w: F.contains("c", w)))
    first = any_term.withColumn("r", F.row_number().over(Window.partitionBy("question_id").orderBy("page_number", "reading_order"))).where(F.col("r") <= 5 * k)
    named = first.where(F.forall("terms", lambda w: F.contains("c", w)) & (F.col("c").contains("parking") | F.col("c").contains("accommodation")))
    use_score = 5.0 + points(PARKING_POINTS) + F.when(F.coalesce(names_zone(F.col("text"), F.col("zone")), F.lit(False)), 1.0).otherwise(0.0)
    uses = named.select("question_id", F.lit("parking").alias("stage"), "tier", none.alias("source_table_id"), F.col("reading_order").alias("source_fragment_id"), F.col("page_number").alias("page"), use_score.alias("base_score"), "text")

    every = found.unionByName(own).unionByName(children).unionByName(near_rows).unionByName(uses)
    # One exchange by call: the best of a source's rows, then the best sources.
    best = Window.partitionBy("question_id", "stage", "source_table_id", "source_fragment_id").orderBy(*[F.desc(c) for c in ("base_score", "tier", "page", "text")])
    every = every.withColumn("base_score", F.round("base_score", 6)).repartition("question_id").withColumn("n", F.row_number().over(best)).where("n = 1")
    order = F.expr("CASE stage WHEN 'table' THEN 0 WHEN 'rule' THEN 1 WHEN 'child' THEN 2 WHEN 'near' THEN 3 WHEN 'accessory' THEN 4 ELSE 5 END")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("base_score"), order, F.coalesce("source_table_id", "source_fragment_id"))))
    return ranked.where(F.col("rank") <= max(k, 8)).select("question_id", "rank", "stage", "tier", "source_table_id", "source_fragment_id", "page", "base_score", "text")
