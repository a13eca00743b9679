"""Text operators on page blocks: all are Column expressions, so Catalyst fuses them into one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of the block and citation grammars.
PAGE_PREFIX = r'^\s*PAGE\s+([A-Z"(])'
LIST_ITEM = r"(?i)^\s*(?:\([a-z]\)|\([ivxlcdm]+\)|[-*•])\s+"
FOOTNOTE = r"^\s*(?:\[\d+\]|\d+\s+)[a-z].{8,}$"
NUMERIC_CELL = r"(?i)^(?:\d+(?:\.\d+)?%?|\d+\s*(?:m2|m²|ft2|ft²)|[ivxlcdm]+\)|[A-Za-z]-\d.*)$"
TOC_ENTRY = r"[.\x{2026}]{2,}\s*\d+\s*$"
TOC_CODE_LINE = r"^[A-Z]{1,4}(?:-\d{1,2}[A-Z]?)?$"
DEFINITION_START = r'(?m)^\s*["“][^"\n]{2,80}?["”]\s+means\b'
COMPOUND = r"^\s*((?:\d+[A-Z]*)(?:\([0-9A-Za-z]+\))*[A-Z]?)(?=\s|$)\s*(.*)$"
SPLIT_COMPOUND = r"^\s*(\d+)\s+([A-Z]{1,3})\b\s+(.*)$"
PAGE_NUMBER = r"(?i)^(?:-?[ivxlcdm]+-?|\d+)$"
VALUE_HEAD = r"^\(?\s*(\d[\d,./]*)\s*(.*)$"
UNIT_HEADS = ("%", "percent", "ft", "foot", "feet", "m", "m2", "m²", "metre", "metres", "sq ft", "sq. ft", "sq.ft", "square foot", "square feet", "square metre", "square metres")
BANNER = "Regional Centre Land Use By-law |"
SPLIT_RULE = r"(?i)^(\(\d+(?:\.\d+)?\)|district,\s+any main building|setback as specified on Schedule 18\.?|not exceed the maximum required building height specified on Schedule 15\.?)"
VALUE_TAILS = ("except", "central", "on-site", "onsite", "(")
CITATIONS = {
    "part": r"(?i)^\s*part\s+([A-Z]|\d+)\b(?:\s*[-:]\s*)?(.*)$",
    "schedule": r"(?i)^\s*schedule\s+([A-Z]|\d+)\b(?:\s*[-:]\s*)?(.*)$",
    "appendix": r"(?i)^\s*appendix\s+([A-Z]|\d+)\b(?:\s*[-:]\s*)?(.*)$",
    "numeric_paren": r"^\s*(\d+(?:\.\d+){0,5}(?:\([A-Za-z0-9]+\))+)\s+(.*)$",
    "paren_numeric": r"^\s*\((\d+(?:\.\d+){0,5})\)\s+(.*)$",
    "numeric": r"^\s*(\d+(?:\.\d+){0,5})\b(?:[.)])?\s*(.*)$",
    "subclause": r"(?i)^\s*\(([ivxlcdm]{2,})\)\s+(.*)$",
    "clause": r"(?i)^\s*(\([a-z]{1,3}\))\s+(.*)$",
}


def text_to_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line; a form feed starts a page, order runs over the document."""
    pages = docs.select(F.col(doc_id).alias("document_id"), F.posexplode(F.split(text, "\f")).alias("page", "page_text"))
    lines = pages.select("document_id", (F.col("page") + 1).cast("long").alias("page_number"), F.posexplode(F.split("page_text", "\n")).alias("line", "raw_text"))
    lines = lines.where(F.col("raw_text").rlike(r"\S"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "line"))
    return lines.select("document_id", "page_number", order.cast("long").alias("reading_order"), F.trim("raw_text").alias("raw_text"), (F.col("line") * 12).cast("long").alias("y0"))


def normalize_text(t: Column) -> Column:
    """Without NUL characters, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.replace(t, F.lit("\0"), F.lit("")), r"(?U)\s+", " "))


def strip_page_prefix(t: Column) -> Column:
    """Drops a leading PAGE before a capital, quote or parenthesis."""
    return F.trim(F.regexp_replace(t, PAGE_PREFIX, "$1"))


def with_value(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that is computed once, however often ``of`` names it."""
    return F.transform(F.array(value), of)[0]


def _words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.size(F.split(norm, " ")))


def word_count(t: Column) -> Column:
    return _words(normalize_text(t))


def _topic(norm: Column) -> Column:
    words = F.split(norm, " ")
    return ~norm.rlike("[.;:]") & _words(norm).between(1, 8) & ~F.exists(words, lambda w: w.rlike(r"^\p{Ll}")) & norm.rlike(r"\p{L}")


def topic_heading(t: Column) -> Column:
    """One to eight words, none of . ; : and no word with a small first letter, some letter."""
    return _topic(normalize_text(t))


#: A unit, the longest that fits, and nothing or an allowed opener after it.
VALUE_REST = "^(?>{})[ .;,:]*+(?:$|{})".format(
    "|".join(u.replace(".", r"\.") for u in sorted(UNIT_HEADS, key=len, reverse=True)), "|".join(h.replace("(", r"\(") for h in VALUE_TAILS)
)


def _value(norm: Column) -> Column:
    rest = F.rtrim(F.regexp_replace(F.lower(F.trim(F.regexp_extract(norm, VALUE_HEAD, 2))), r"\.+$", ""))
    return norm.rlike(VALUE_HEAD) & F.coalesce(rest.rlike(VALUE_REST), F.lit(False))


def requirement_value(t: Column) -> Column:
    """A number and a unit, with nothing or an allowed opener after it; the longest unit counts."""
    return _value(normalize_text(t))


def _cited(kind: Column | str, label: Column, level: Column | int, title: Column, confidence: float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(kind).alias("type"), label.alias("label"), as_col(level).cast("int").alias("level"), title.alias("title"), F.lit(confidence).alias("confidence"))


def compound_citation(norm: Column) -> Column:
    """A label such as 48DB(1), 10(3)A or 43 I of normalised text: each parenthesis and a capital after one is
    a level below the section; the last parenthesis tells clauses and subclauses. A bare number is none."""
    apart, whole = (lambda g: F.regexp_extract(norm, SPLIT_COMPOUND, g)), (lambda g: F.regexp_extract(norm, COMPOUND, g))
    joins = norm.rlike(SPLIT_COMPOUND) & ((F.length(apart(2)) >= 2) | apart(3).rlike(r"^\p{Lu}"))
    label = F.when(joins, F.concat(apart(1), apart(2))).when(norm.rlike(COMPOUND), whole(1))
    title = F.trim(F.when(joins, apart(3)).otherwise(whole(2)))
    tokens = F.regexp_extract_all(label, F.lit(r"\(([0-9A-Za-z]+)\)"), F.lit(1))
    last = F.try_element_at(tokens, F.lit(-1))
    level = 2 + F.size(tokens) + F.when(label.rlike(r"\)[A-Z]$"), 1).otherwise(0)
    kind = F.when(last.rlike("^[a-z]$"), "clause").when(last.rlike("(?i)^[ivxlcdm]+$"), "subclause").when(level == 2, "section").otherwise("subsection")
    return F.when(label.isNotNull() & ~label.rlike(r"^\d+$"), _cited(kind, label, level, title, 0.9))


def citation(t: Column, compound: bool = False) -> Column:
    """struct(type, label, level, title, confidence) of a leading citation, null where there is none.

    The first rule of the grammar that fits decides: parts, schedules and appendices are level 1,
    sections 2, dotted numbers 3 to 5, clauses 5, roman subclauses 6. ``compound`` adds labels in which
    letters and parentheses follow a number.
    """
    return with_value(normalize_text(t), lambda norm: _citation(norm, compound))


def _citation(norm: Column, compound: bool) -> Column:
    def piece(rule: str, group: int) -> Column:
        return F.trim(F.regexp_extract(norm, CITATIONS[rule], group))

    made = _cited

    number = piece("numeric", 1)
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    fraction = norm.rlike(r"^\d+(?:\.\d+){0,5}/")
    found = F.when(norm.rlike(CITATIONS["part"]), made("part", F.concat(F.lit("Part "), F.upper(piece("part", 1))), 1, piece("part", 2), 0.95))
    for kind in ("schedule", "appendix"):
        found = found.when(norm.rlike(CITATIONS[kind]), made(kind, F.concat(F.lit(kind.title() + " "), F.upper(piece(kind, 1))), 1, piece(kind, 2), 0.95))
    if compound:
        label = compound_citation(norm)
        found = found.when(label.isNotNull(), label)
    return (
        found.when(norm.rlike(CITATIONS["numeric_paren"]), made("section", piece("numeric_paren", 1), 2, piece("numeric_paren", 2), 0.9))
        .when(norm.rlike(CITATIONS["paren_numeric"]), made("subsection", F.concat(F.lit("("), piece("paren_numeric", 1), F.lit(")")), 3, piece("paren_numeric", 2), 0.85))
        .when(
            norm.rlike(CITATIONS["numeric"]) & ~fraction,
            made(F.when(depth == 1, "section").otherwise("subsection"), number, F.when(depth <= 2, depth + 1).otherwise(3 + F.least(depth - 2, F.lit(2))), piece("numeric", 2), 0.9),
        )
        .when(norm.rlike(CITATIONS["subclause"]) & ~fraction, made("subclause", F.concat(F.lit("("), F.lower(piece("subclause", 1)), F.lit(")")), 6, piece("subclause", 2), 0.85))
        .when(norm.rlike(CITATIONS["clause"]), made("clause", F.lower(piece("clause", 1)), 5, piece("clause", 2), 0.85))
    )


#: What any rule of the grammar fits, as one pattern; a fraction is no number.
ANY_CITATION = (
    r"(?i)^(?:(?:part|schedule|appendix)\s+(?:[A-Z]|\d+)\b|\d+(?:\.\d+){0,5}(?:\([A-Za-z0-9]+\))+\s|\(\d+(?:\.\d+){0,5}\)\s"
    r"|(?!\d+(?:\.\d+){0,5}/)\d+(?:\.\d+){0,5}\b|\([ivxlcdm]{2,}\)\s|\([a-z]{1,3}\)\s)"
)


#: What the compound labels add to it.
ANY_COMPOUND = r"^\d+(?:[A-Z]+(?:\([0-9A-Za-z]+\))*|(?:\([0-9A-Za-z]+\))+)[A-Z]?(?=\s|$)|^\d+\s+(?:[A-Z]{2,3}\b\s|[A-Z]\b\s+\p{Lu})"


def has_citation(t: Column, compound: bool = False) -> Column:
    """Whether ``citation`` is not null."""
    return _has(normalize_text(t), compound)


def _has(norm: Column, compound: bool) -> Column:
    return norm.rlike(ANY_CITATION) | norm.rlike(ANY_COMPOUND) if compound else norm.rlike(ANY_CITATION)


def _cell(norm: Column) -> Column:
    known = norm.contains("Class A") | norm.contains("Class B") | norm.contains("%") | norm.contains("minimum") | norm.contains("maximum")
    return (norm != "") & (norm.rlike(NUMERIC_CELL) | known | ((_words(norm) <= 6) & norm.rlike(r"\d")))


def table_cell(t: Column) -> Column:
    """Whether a line looks like one cell of a table."""
    return _cell(normalize_text(t))


def table_like(t: Column, compound: bool = False) -> Column:
    """A pipe or tab, or enough short numeric lines; prose next to citations speaks against it."""
    return with_value(strip_page_prefix(t), lambda text: _table(text, compound))


def _table(text: Column, compound: bool) -> Column:
    def fits(lines: Column) -> Column:
        count = lambda test: F.size(F.filter(lines, test))
        cells, cites = count(_cell), count(lambda x: _has(x, compound))
        short, prose = count(lambda x: _words(x) <= 8), count(lambda x: _words(x) >= 9)
        veto = (cites >= 1) & (prose >= 1) & (cells == 0)
        dense = (cells >= 2) & (short >= 2) & (cites <= F.greatest(F.lit(1), F.floor(F.size(lines) / 3)))
        hinted = (short >= 3) & text.rlike(r"[ \t]{2,}|\t|\|")
        return (F.size(lines) >= 2) & ~veto & (dense | hinted)

    lines = F.filter(F.transform(F.split(text, "\n"), normalize_text), lambda x: x != "")
    return text.contains("|") | text.contains("\t") | (text.contains("\n") & with_value(lines, fits))


def classify_block(t: Column, y0: Column | None = None, y1: Column | None = None, page_height: Column | None = None, compound: bool = False) -> Column:
    """Block type by the first rule that fits; the geometry rules need the box and the page height."""
    none = F.lit(None).cast("double")
    top = F.coalesce((y1 if y1 is not None else none) < (page_height if page_height is not None else none) * 0.10, F.lit(False))
    bottom = F.coalesce((y0 if y0 is not None else none) > (page_height if page_height is not None else none) * 0.90, F.lit(False))

    def kind(text: Column, norm: Column) -> Column:
        words, bare = _words(norm), norm.rlike(PAGE_NUMBER)
        return (
            F.when(norm == "", "unknown")
            .when(norm.rlike(TOC_ENTRY), "heading")
            .when(_value(norm), "paragraph")
            .when(bare & top, "header")
            .when(bare & bottom, "footer")
            .when(_table(text, compound), "table_region")
            .when(norm.rlike(FOOTNOTE) & (F.length(norm) < 400), "footnote")
            .when(norm.rlike(LIST_ITEM), "list_item")
            .when(_has(norm, compound), F.when(F.length(norm) <= 160, "heading").otherwise("list_item"))
            .when(_topic(norm), "heading")
            .when(text.rlike(r"[ \t]{2,}|\t|\|") & (words <= 12) & _cell(norm), "table_region")
            .when((F.upper(norm) == norm) & (F.lower(norm) != norm) & words.between(2, 12), "heading")
            .when(top, "header")
            .when(bottom, "footer")
            .otherwise("paragraph")
        )

    return with_value(strip_page_prefix(t), lambda text: with_value(normalize_text(text), lambda norm: kind(text, norm)))


def boilerplate(blocks: DataFrame, threshold: int = 2) -> DataFrame:
    """``blocks`` (document_id, page_number, raw_text) plus is_boilerplate: short text that repeats in its
    document; its block_type becomes footer (null without one before).

    The counts are one aggregate per document and text, joined back; nothing is gathered per document.
    """
    read = blocks.withColumn("__key", F.lower(normalize_text(F.col("raw_text"))))
    key = F.col("__key")
    eligible = (key != "") & (F.length(key) <= 120) & ~F.col("raw_text").rlike(LIST_ITEM) & ~key.rlike(ANY_CITATION)
    marked = read.withColumn("key", F.when(eligible, key)).drop("__key")
    counts = marked.where("key is not null").groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n"))
    pages = blocks.groupBy("document_id").agg(F.count_distinct("page_number").alias("pages"))
    need = F.least(F.col("pages"), F.lit(threshold))
    return (
        marked.join(pages, "document_id")
        .join(counts, ["document_id", "key"], "left")
        .withColumn("is_boilerplate", F.coalesce((need >= 2) & (F.col("n") >= need), F.lit(False)))
        .withColumn("block_type", F.when(F.col("is_boilerplate"), "footer").otherwise(F.col("block_type") if "block_type" in blocks.columns else F.lit(None)))
        .drop("key", "n", "pages")
    )


def zone_hyphen(t: Column) -> Column:
    """Repairs a zone code that a line break split after its hyphen."""
    return F.regexp_replace(t, r"\b([A-Z]{1,4})-\s+(\d[A-Z]?)\b", "$1-$2")


def profile_rules(blocks: DataFrame, boilerplate_pages: int = 6, banner: str = BANNER) -> DataFrame:
    """Corpus switches: hyphen repair, first pages and banner lines are boilerplate, split rules are not.

    ``blocks`` have page_number, raw_text, block_type and is_boilerplate; what no rule names keeps both.
    """
    text = zone_hyphen(normalize_text(F.col("raw_text")))
    split_rule = text.rlike(SPLIT_RULE)
    front = (F.col("page_number") <= boilerplate_pages) | text.startswith(banner)
    return blocks.select(
        *[c for c in blocks.columns if c not in ("block_type", "is_boilerplate")],
        text.alias("normalized_text"),
        F.when(text.startswith(banner), True).when(split_rule, False).when(front, True).otherwise(F.col("is_boilerplate")).alias("is_boilerplate"),
        F.when(text.startswith(banner), "footer").when(split_rule, F.when(text.startswith("("), "list_item").otherwise("paragraph")).when(front, "footer").otherwise(F.col("block_type")).alias("block_type"),
    )


def split_at_citations(blocks: DataFrame) -> DataFrame:
    """Blocks with more than one line that starts a citation become segments, one from each such line."""
    lines = blocks.select("document_id", "reading_order", F.posexplode(F.split("raw_text", "\n")).alias("line", "t")).withColumn("starts", has_citation(F.col("t")).cast("int"))
    w = Window.partitionBy("document_id", "reading_order").orderBy("line")
    whole = Window.partitionBy("document_id", "reading_order")
    numbered = lines.withColumn("segment", F.when(F.sum("starts").over(whole) > 1, F.greatest(F.sum("starts").over(w) - 1, F.lit(0))).otherwise(0))
    parts = numbered.groupBy("document_id", "reading_order", "segment").agg(F.sort_array(F.collect_list(F.struct("line", "t"))).alias("p"))
    return parts.select("document_id", "reading_order", F.col("segment").cast("long").alias("segment"), F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def trimmed_lines(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def citation_starts(lines: Column, compound: bool = False) -> Column:
    """Which of a block's lines start a citation, from 0. A section or subsection whose title goes on in a
    small letter is a wrapped line, not a start."""

    def starts(line: Column) -> Column:
        cite = citation(line, compound)
        wrapped = cite["type"].isin("section", "subsection") & F.trim(cite["title"]).rlike(r"^\p{Ll}")
        return cite.isNotNull() & ~F.coalesce(wrapped, F.lit(False))

    return F.filter(F.transform(lines, lambda x, i: F.when(has_citation(x, compound), F.when(starts(x), i))), lambda i: i.isNotNull())


def citation_segments(lines: Column, begin: Column) -> Column:
    """The pieces of a block whose lines ``begin`` start citations: one from each but the first, and all that stands before."""
    cuts = F.concat(F.array(F.lit(0)), F.slice(begin, 2, F.greatest(F.size(begin) - 1, F.lit(0))), F.array(F.size(lines)))
    spans = F.arrays_zip(F.slice(cuts, 1, F.size(cuts) - 1).alias("a"), F.slice(cuts, 2, F.size(cuts) - 1).alias("b"))
    return F.transform(spans, lambda s: F.array_join(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), "\n"))


def definition_segments(raw: Column) -> Column:
    """The quoted terms of a block with what they mean, where it holds two or more; what stands before the first one goes."""
    pieces = F.filter(F.split(raw, DEFINITION_START.replace("(?m)", "(?m)(?=") + ")"), lambda x: x.rlike(DEFINITION_START))
    return F.when(F.size(pieces) > 1, F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))).otherwise(F.array().cast("array<string>"))


def split_at_definitions(blocks: DataFrame) -> DataFrame:
    """Blocks with two or more quoted terms that ``means`` something are split where each starts."""
    starts = F.size(F.regexp_extract_all(F.col("raw_text"), F.lit(r'(?m)^\s*["“][^"\n]{2,80}?["”]\s+means\b'), F.lit(0)))
    pieces = F.when(starts >= 2, F.split("raw_text", r'(?m)(?=^\s*["“][^"\n]{2,80}?["”]\s+means\b)')).otherwise(F.array("raw_text"))
    return blocks.select("document_id", "reading_order", F.posexplode(F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")).alias("segment", "text"))


def toc_segments(raw: Column) -> Column:
    """The entries of a table of contents: every line ends in dot leaders and a page, or is a code such as
    ZM-21 before such a line, which it joins. An empty array for fewer than two entries or any other line."""
    lines = trimmed_lines(raw)
    is_entry = lambda x: F.coalesce(normalize_text(x).rlike(TOC_ENTRY), F.lit(False))
    is_code = lambda x, i: ~is_entry(x) & normalize_text(x).rlike(TOC_CODE_LINE) & is_entry(F.get(lines, i + 1))
    fits = F.forall(F.transform(lines, lambda x, i: is_entry(x) | is_code(x, i)), lambda ok: ok)
    joined = F.transform(lines, lambda x, i: F.when(is_code(x, i), F.concat(x, F.lit("\n"), F.get(lines, i + 1))).when((i == 0) | is_entry(F.get(lines, i - 1)), x))
    entries = F.filter(joined, lambda x: x.isNotNull())
    return F.when((F.size(lines) > 1) & fits & (F.size(entries) > 1), entries).otherwise(F.array().cast("array<string>"))


def split_toc(blocks: DataFrame) -> DataFrame:
    """Tables of contents in a block become one segment per entry; other blocks none."""
    return blocks.select("document_id", "reading_order", F.posexplode(toc_segments(F.col("raw_text"))).alias("segment", "text"))


def pipe_cells(blocks: DataFrame) -> DataFrame:
    """Cells of blocks with pipes: ``;`` parts rows, ``|`` columns; a row needs two columns."""
    rows = blocks.where(F.col("raw_text").contains("|")).select("document_id", "reading_order", F.posexplode(F.split("raw_text", ";")).alias("row_index", "row"))
    cells = rows.withColumn("cells", F.split("row", r"\|")).where(F.size("cells") >= 2)
    return cells.select("document_id", "reading_order", F.col("row_index").cast("long").alias("row_index"), F.posexplode("cells").alias("col_index", "c")).select(
        "document_id", "reading_order", "row_index", F.col("col_index").cast("long").alias("col_index"), F.trim("c").alias("text")
    )


def captions(lines: DataFrame) -> DataFrame:
    """First ``Table n:`` line of each page, with the next line unless that is a caption too."""
    w = Window.partitionBy("document_id", "page_number").orderBy("reading_order")
    nxt = F.lead("raw_text").over(w)
    found = lines.withColumn("next", nxt).where(F.col("raw_text").rlike(r"^\s*Table\s+\d+\s*:"))
    text = F.concat_ws(" ", F.trim("raw_text"), F.when(~F.col("next").rlike(r"^\s*Table\s+\d+\s*:"), F.trim("next")))
    first = F.row_number().over(w)
    return found.withColumn("rank", first).where("rank = 1").select("document_id", "page_number", text.alias("caption"))
