"""The section tree of a document: an ordered fold over its blocks.

What a block says on its own (its citation, whether it defines a term, leads in, repeats a value) is
column expressions. What it hangs on depends on all blocks before it: the open sections, the heading
and the definition it stands under. That state is small and runs over the blocks of a document in
order, batch by batch, so that a document of any length needs no more memory than a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.operators import blocks as B
from cadastra.operators.sharing import read_once
from cadastra.operators.structure import downgrade_duplicate_paths
from cadastra.sources.lineage import cut

# What a defined term, the start of a list of definitions and a quote mark with a space after it look like.
DEFINED_TERM = r"""(?i)^\s*['"“]?[A-Z][A-Za-z0-9 /&,'()-]{2,100}['"”]?\s+(?:means|includes)\b"""
DEFINED_TERM_REGIONAL = r"""(?i)^\s*['"“]?[A-Z][A-Za-z0-9 /&,'()-]{2,100}['"”]?\s+(?:means|includes|shall\s+mean|shall\s+include|\(deleted\b)"""
TERM_REFERENCE = r"""(?i)^\s*['"“]?[A-Z][A-Za-z0-9 /&,'()-]{2,100}['"”]?\s*[-:]\s*see\b"""
DEFINITIONS_HEADING = r"(?i)^\s*definitions?\b"
DEFINITIONS_INTRO = r"(?i)^\s*in this by-?law\s*:\s*$"
SPACED_QUOTE = r"""^(\s*['"“])\s+"""
ROMANS = ("(i)", "(ii)", "(iii)", "(iv)", "(v)", "(vi)", "(vii)", "(viii)", "(ix)", "(x)")


@dataclass(frozen=True)
class Rules:
    """Switches of a corpus: compound labels such as 43G(2), roman items under a lead-in, more words that define."""

    compound_labels: bool = False
    promote_romans: bool = False
    defined_term: str = DEFINED_TERM


REGIONAL = Rules(compound_labels=True, promote_romans=True, defined_term=DEFINED_TERM_REGIONAL)


def titleish(t: Column) -> Column:
    """No words, or at most twelve of which the first six with a letter start in capitals no less often than in small letters."""
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    named = F.slice(F.filter(words, lambda w: w.rlike(r"\p{L}")), 1, 6)
    count = lambda pattern: F.size(F.filter(named, lambda w: w.rlike(pattern)))
    return (F.size(words) == 0) | ((F.size(words) <= 12) & (F.size(named) > 0) & (count(r"^\p{Lu}") >= count(r"^\p{Ll}")))


def segments(blocks: DataFrame, rules: Rules) -> DataFrame:
    """``blocks`` with segment, raw_text and block_type of the pieces that a block holds: entries of a table
    of contents, definitions, or citations at the start of lines. A block that holds one piece stays whole."""
    raw, kind, compound = F.col("raw_text"), F.col("block_type"), rules.compound_labels
    several, prose = F.size("__lines") > 1, kind.isin("paragraph", "heading")
    starts = several & (kind != "table_region") & ~B.table_like(raw, compound)
    split = (
        blocks.withColumn("__lines", B.trimmed_lines(raw))
        .withColumn("__toc", F.when(several & prose, B.toc_segments(raw)))
        .withColumn("__terms", F.when(several & prose, B.definition_segments(raw)))
        .withColumn("__begin", F.when(starts, B.citation_starts(F.col("__lines"), compound)))
    )
    cited = F.when(F.size("__begin") > 1, B.citation_segments(F.col("__lines"), F.col("__begin")))
    pieces = F.when(F.size("__toc") > 1, F.col("__toc")).when(F.size("__terms") > 0, F.col("__terms")).otherwise(cited)
    split = split.withColumn("__pieces", pieces).drop("__lines", "__toc", "__terms", "__begin")
    each = split.select("*", F.posexplode(F.coalesce("__pieces", F.array("raw_text"))).alias("segment", "__piece"))
    block_type = F.when(F.col("__pieces").isNull(), kind).otherwise(B.classify_block(F.col("__piece"), compound=rules.compound_labels))
    return each.withColumn("block_type", block_type).withColumn("raw_text", F.col("__piece")).withColumn("__whole", F.col("__pieces").isNull()).drop("__pieces", "__piece")


#: Columns that say what a block is; blocks that are alike in them are read once.
SAID = ("raw_text", "block_type", "is_boilerplate", "normalized_text")


def read_blocks(blocks: DataFrame, rules: Rules) -> DataFrame:
    """One row for each piece, with all that the fold has to know of it, beside the other columns of ``blocks``. Nothing is filtered on what is read
    out of a text: the optimiser would move such a filter down and repeat all patterns in it."""
    shown = blocks.where(~F.coalesce("is_boilerplate", F.lit(False)) & ~F.col("block_type").isin("header", "footer") & F.col("raw_text").rlike(r"\S"))
    text = B.normalize_text(F.col("raw_text"))
    if "normalized_text" in blocks.columns:  # repaired by a profile
        text = F.when(F.col("__whole"), F.coalesce("normalized_text", text)).otherwise(text)
    pieces = segments(shown, rules).withColumn("text", text)
    kind, value = F.col("block_type"), B.requirement_value(F.col("text"))
    cite = B.citation(F.col("text"), rules.compound_labels)
    read = pieces.withColumn("is_value", value).withColumn("cite", F.when(~value & (kind != "table_region") & (kind != "footnote") & ~B.table_like(F.col("raw_text"), rules.compound_labels), cite))
    title = F.trim(F.col("cite.title"))
    plain_section = (F.col("cite.type") == "section") & ~F.col("cite.label").contains(".")
    fits = (
        F.when(F.col("cite.type").isin("part", "schedule", "appendix"), True)
        .when(plain_section & (kind == "heading"), F.upper(title) != "ANGLE")
        .when(plain_section, F.lower(title).rlike("^(minimum|maximum) ") | titleish(title))
        .when(F.col("cite.type").isin("subsection", "clause", "subclause"), kind.isin("heading", "list_item", "paragraph"))
        .otherwise(kind.isin("heading", "list_item"))
    )
    term = F.regexp_replace("text", SPACED_QUOTE, "$1")
    own = F.col("text")
    leads = (kind == "heading") | own.endswith(":")
    short = (F.size(F.split(own, " ")) <= 12) & ~own.rlike("[.;]$") & ~F.lower(own).contains(" means ")
    return (
        read.withColumn("cite", F.when(F.col("cite").isNotNull() & fits, F.col("cite")))
        .select(
            *[c for c in blocks.columns if c not in SAID], F.col("segment").cast("int").alias("segment"), "text",
            F.when(F.col("is_value"), "paragraph").otherwise(kind).alias("kind"), "is_value",
            F.col("cite.type").alias("cited"), F.col("cite.label").alias("label"), F.col("cite.level").alias("level"), F.col("cite.confidence").alias("sure"),
            (term.rlike(rules.defined_term) | term.rlike(TERM_REFERENCE)).alias("defines"),
            F.when(own.rlike(DEFINITIONS_HEADING), "heading").when(own.rlike(DEFINITIONS_INTRO), "intro").alias("definitions"),
            leads.alias("leads"), short.alias("short"),
        )
    )


@dataclass
class Open:
    """A section that may still get children."""

    index: int
    level: int
    path: str | None
    kind: str
    leads: bool


@dataclass
class Outline:
    """What the blocks of a document so far leave open."""

    promote: bool
    size: int = 0
    stack: list[Open] = field(default_factory=list)
    #: The last fragment but prose and footnotes, and its type.
    content: tuple[int, str] | None = None
    #: The last fragment of all: page, and whether it is cited.
    last: tuple[int, bool] | None = None
    heading: tuple[int, str] | None = None
    term: int | None = None
    terms: int | None = None

    def _top(self, level: int) -> Open | None:
        while self.stack and self.stack[-1].level >= level:
            self.stack.pop()
        return self.stack[-1] if self.stack else None

    def _lead_in(self) -> bool:
        return self.promote and bool(self.stack) and self.stack[-1].leads

    def _division(self) -> int | None:
        """The open part, schedule or appendix."""
        return next((o.index for o in reversed(self.stack) if o.kind in ("part", "schedule", "appendix")), None)

    def _placed(self, row: dict, kind: str, label: str | None, parent: int | None, path: str | None, status: str, confidence: float) -> tuple:
        index, self.size, self.last = self.size, self.size + 1, (row["page_number"], label is not None)
        return index, parent, kind, label, path, status, confidence

    def cited(self, row: dict) -> tuple:
        kind, label, level = row["cited"], row["label"], row["level"]
        roman = label in ROMANS
        if roman and kind == "clause" and self._lead_in():
            kind, level = "subclause", 6
        parent = self._top(level)
        if roman and kind == "subclause" and not (parent and parent.path) and not self._lead_in():
            kind, level = "clause", 5
            parent = self._top(level)
        low = kind in ("clause", "subclause")
        above = parent.path if parent else None
        under = parent.index if parent else None
        if under is None and kind in ("section", "subsection") and self.content and self.content[1] == "heading":
            under = self.content[0]
        if low and under is None:
            under = self.term if self.term is not None else self.terms
        if low and self.heading and self.term is None and self.terms is None:
            under = self.heading[0]
            if above and self.heading[1]:
                above = f"{above} > [{self.heading[1]}]"
        addressed = bool(above) or not low
        path = (f"{above} > {label}" if above else label) if addressed else None
        out = self._placed(row, kind, label, under, path, "parsed" if addressed else "uncertain", row["sure"] if addressed else min(row["sure"], 0.6))
        self.stack.append(Open(out[0], level, path, kind, row["leads"] or kind == "subclause" or (kind == "clause" and row["short"])))
        if not low:
            self.term = self.terms = None
        self.content = (out[0], kind)
        return out

    def headed(self, row: dict) -> tuple:
        out = self._placed(row, "heading", None, self._division(), None, "uncertain", 0.55)
        self.content, self.heading = (out[0], "heading"), (out[0], row["text"])
        if row["definitions"] == "heading":
            self.terms, self.term = out[0], None
        else:
            self.term = out[0] if row["defines"] else None
        return out

    def listed(self, row: dict) -> tuple:
        under = self.content[0] if self.content else self.stack[-1].index if self.stack else None
        if row["defines"]:
            under = self.terms or self._division()
        bullet = row["text"].startswith(("-", "*", "•"))
        out = self._placed(row, "list_item", None, under, None, "uncertain" if bullet else "parsed", 0.7)
        self.content = (out[0], "list_item")
        if row["definitions"] == "intro":
            self.terms, self.term = out[0], None
        elif row["defines"]:
            self.term = out[0]
        return out

    def noted(self, row: dict) -> tuple:
        return self._placed(row, "footnote", None, self.stack[-1].index if self.stack else None, None, "parsed", 0.75)

    def said(self, row: dict) -> tuple:
        """Prose: a value goes with the uncited fragment before it on its page, a definition with its list,
        other prose with the open section above clauses."""
        under = self.stack[-1].index if self.stack else None
        if row["is_value"]:
            if self.last == (row["page_number"], False):
                under = self.size - 1
        elif row["defines"]:
            content = self.content[0] if self.content and self.content[1] in ("heading", "list_item") else None
            under = self.terms or self._division() or content
        elif self.stack and self.stack[-1].level >= 5:
            under = next((o.index for o in reversed(self.stack) if o.level < 5), None)
        out = self._placed(row, "prose", None, under, None, "parsed" if under is not None else "uncertain", 0.8 if under is not None else 0.5)
        self.term = out[0] if row["defines"] else None
        return out

    def place(self, row: dict) -> tuple:
        """(index, parent, type, label, path, status, confidence) of the next fragment."""
        if row["cited"]:
            return self.cited(row)
        return {"heading": self.headed, "list_item": self.listed, "footnote": self.noted}.get(row["kind"], self.said)(row)


_FRAGMENT = "document_id long, page_number long, reading_order long, segment int, text string, fragment_index long, parent_index long, fragment_type string, citation_label string, citation_path string, parse_status string, confidence double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())


def _fold(promote: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, outline = None, Outline(promote)
        for batch in batches:
            placed = []
            for row in batch.to_pylist():
                if row["document_id"] != document:
                    document, outline = row["document_id"], Outline(promote)
                placed.append(None if row["kind"] == "table_region" and not row["cited"] else outline.place(row))
            kept = [k for k, p in enumerate(placed) if p]
            if kept:
                columns = zip(*[placed[k] for k in kept], strict=True)
                made = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
                own = ["document_id", "page_number", "reading_order", "segment", "text"]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept)) for c in own] + made, names=[*own, "fragment_index", "parent_index", "fragment_type", "citation_label", "citation_path", "parse_status", "confidence"])

    return run


def hierarchy_full(blocks: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The fragments of all documents, from ``blocks`` (document_id, page_number, reading_order, raw_text,
    block_type, is_boilerplate): fragment_index from 0 in each document, parent_index, fragment_type,
    citation_label, citation_path, parse_status, confidence, duplicate_citation_path.

    Boilerplate, headers, footers, blank blocks and tables give no fragment. Blocks without a document
    go; those without a type count as paragraphs, and all are classified by their text where there is no column block_type; rows that repeat a place are taken by their text.
    A list of definitions that is the first fragment of its document does not hold definitions in prose.
    Documents are dealt by id and sorted by Spark; a document is one fold, in one task. The fragments are
    written once, since their duplicate paths are counted.
    """
    said = F.struct(*[c for c in SAID if c in blocks.columns]).alias("__said")
    typed = "block_type" in blocks.columns

    def read(rows: DataFrame) -> DataFrame:
        each = rows.select("*", "__said.*")
        kind = F.coalesce("block_type", F.lit("paragraph")) if typed else B.classify_block(F.col("raw_text"))
        return read_blocks(each.withColumn("block_type", kind), rules)

    placed = blocks.where("document_id is not null").select("document_id", F.col("page_number").cast("long").alias("page_number"), F.col("reading_order").cast("long").alias("reading_order"), said)
    rows = read_once(placed, "__said", read).drop("__said")
    order = ["document_id", "reading_order", "segment", "page_number", "text"]
    fragments = rows.repartition("document_id").sortWithinPartitions(*order).mapInArrow(_fold(rules.promote_romans), _FRAGMENT)
    return downgrade_duplicate_paths(cut(fragments))
