"""Structure operators: outlines, trees, tables, references, validation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.operators.sharing import read_once
from cadastra.sources.lineage import cut, written


def hierarchy_parent(outline: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """``outline`` (keys, idx, level) plus parent_idx: the nearest row before with a smaller level.

    For each level the last index that had it is one running window; the parent is the latest of
    those under the row's own level. All windows share one sort, over as many levels as there are.
    """
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    levels = [r[0] for r in outline.select("level").where("level is not null").distinct().orderBy("level").collect()]  # as many as outlines are deep
    last = {k: F.max(F.when(F.col("level") == k, F.col("idx"))).over(w) for k in levels}
    with_last = outline.select("*", *[c.alias(f"__last{k}") for k, c in last.items()])
    none = F.lit(None).cast("long")
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"__last{k}")) for k in last], none, none)
    return with_last.withColumn("parent_idx", parent).drop(*[f"__last{k}" for k in last])


#: Rows that one key of a climb may have of all that meet there; those above a key with more are broadcast, so many of them at most.
FREQUENT_UP = 20_000


def _above(rows: DataFrame, upper: DataFrame) -> DataFrame:
    """``rows`` with what the fragment at their pointer holds put before what they hold, and its pointer.

    Fragments that many rows point at are broadcast, so that none of them fills a task; the others meet in a shuffle.
    """
    known = upper.select(F.col("fragment_id").alias("up"), F.col("up").alias("next"), F.col("held").alias("more"))
    meet = lambda part, above: part.join(above, "up").select("fragment_id", F.col("next").alias("up"), F.concat("more", "held").alias("held"))
    counts = written(rows.groupBy("up").count())
    pointed, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if pointed <= FREQUENT_UP:
        return meet(rows, F.broadcast(known.join(F.broadcast(counts), "up", "left_semi")))
    often = written(counts.where(F.col("count") * FREQUENT_UP > total).select("up"))
    if often.isEmpty():
        return meet(rows, known)
    rest = rows.join(F.broadcast(often), "up", "left_anti")
    return meet(rows, F.broadcast(known.join(F.broadcast(often), "up", "left_semi"))).unionByName(meet(rest, known))


def _climb_inner(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, climbed) of ``rows`` (fragment_id, up, held): the fragments that others point at (fragment_id), and these
    with all that is held from the root down to each one. Their pointers double, each round joins what a fragment holds to
    what the ancestor at its pointer holds, so trees of any depth take as many rounds as its logarithm."""
    parents = written(rows.where("up is not null").select(F.col("up").alias("fragment_id")).distinct())
    inner = written(rows.join(parents, "fragment_id", "left_semi"))
    done, open_, left = [inner.where("up is null")], written(inner.where("up is not null")), None
    while (n := open_.count()) and n != left:
        # A round ends at least one open fragment, unless all that are open hang on cycles.
        left = n
        step = written(_above(open_, functools.reduce(DataFrame.unionByName, [*done, open_])))
        done.append(step.where("up is null"))
        open_ = step.where("up is not null")
    return parents, written(functools.reduce(DataFrame.unionByName, [*done, open_]))


def _climb(fragments: DataFrame, carried: Column, of: DataFrame | None = None) -> DataFrame:
    """(fragment_id, up, held): ``carried``, an array, of all fragments from the root down to each one, up null;
    with ``of`` (fragment_id, each once) only of these.

    Only fragments that others point at climb; the others, most of a tree, meet their parent once, after that.
    Fragments that hang on a cycle keep a pointer; those whose root is missing are left out.
    """
    rows = fragments.select("fragment_id", F.col("parent_fragment_id").alias("up"), carried.alias("held"))
    parents, climbed = _climb_inner(rows)
    wanted = rows if of is None else rows.join(of, "fragment_id", "left_semi")
    leaves = wanted.join(parents, "fragment_id", "left_anti")
    below = _above(written(leaves.where("up is not null")), climbed)
    above = climbed if of is None else climbed.join(of, "fragment_id", "left_semi")
    return above.unionByName(leaves.where("up is null")).unionByName(below)


def citation_paths(fragments: DataFrame) -> DataFrame:
    """``fragments`` plus citation_path: labels from the root, joined by `` > ``.

    Null labels are passed over. Fragments on or under a cycle, or under a missing parent, have no path.
    Fragments are written once and meet the path of their parent in one exchange, with all that they hold;
    those of frequent parents are not moved.
    """
    fragments = written(fragments)
    label = F.when(F.col("citation_label").isNull(), F.array().cast("array<string>")).otherwise(F.array("citation_label"))
    climbed = _climb_inner(fragments.select("fragment_id", F.col("parent_fragment_id").alias("up"), label.alias("held")))[1].where("up is null")
    # A parent without any label has a path of none.
    known = climbed.select(F.col("fragment_id").alias("__up"), F.struct(F.when(F.size("held") > 0, F.array_join("held", " > ")).alias("path")).alias("__above"))
    up, above = F.col("parent_fragment_id"), F.col("__above.path")
    path = F.when(F.col("__above").isNotNull() & (above.isNotNull() | F.col("citation_label").isNotNull()), F.concat_ws(" > ", above, "citation_label"))
    meet = lambda part, known: part.join(known, up == F.col("__up"), "left").select(*fragments.columns, path.alias("citation_path"))
    below, roots = fragments.where(up.isNotNull()), fragments.where(up.isNull()).withColumn("citation_path", F.col("citation_label"))
    if known.count() <= FREQUENT_UP:
        return roots.unionByName(meet(below, F.broadcast(known)))
    counts = below.groupBy(up.alias("__up")).count()
    often = written(counts.where(F.col("count") * FREQUENT_UP > below.count()).select("__up"))
    if often.isEmpty():
        return roots.unionByName(meet(below, known))
    rare = below.join(F.broadcast(often), up == F.col("__up"), "left_anti")
    much = below.join(F.broadcast(often), up == F.col("__up"), "left_semi")
    return roots.unionByName(meet(rare, known)).unionByName(meet(much, F.broadcast(known.join(F.broadcast(often), "__up", "left_semi"))))


def ancestor_chain(fragments: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(fragment_id, ancestors): ids of all ancestors of fragments that have some, the root first; with ``of`` only of its fragment_id."""
    chains = _climb(fragments, F.array("fragment_id"), of).where("up is null and size(held) > 1")
    return chains.select("fragment_id", F.slice("held", F.lit(1), F.size("held") - 1).alias("ancestors"))


#: One in so many fragments is looked at for frequent paths; a path that is seen so often there is frequent.
SAMPLED, SEEN = 100, 50


def downgrade_duplicate_paths(fragments: DataFrame) -> DataFrame:
    """Paths that occur more than once in a document become null, uncertain, with confidence 0.6 at most.

    Fragments are written once and moved once, by document and path. Those of paths that a sample shows to be
    frequent are not moved: what it has seen twice is a duplicate. Whatever it misses is counted with the others.
    """
    fragments = written(fragments)
    place = ["document_id", "citation_path"]
    pathed = fragments.where("citation_path is not null")
    seen = written(pathed.select(*place).sample(1 / SAMPLED, 1).groupBy(*place).count().where(F.col("count") >= SEEN).select(*place))
    frequent = F.broadcast(seen)
    n = F.count(F.lit(1)).over(Window.partitionBy(*place))
    rest = pathed.join(frequent, place, "left_anti").withColumn("__twice", n > 1)
    parts = [rest, pathed.join(frequent, place, "left_semi").withColumn("__twice", F.lit(True)), fragments.where("citation_path is null").withColumn("__twice", F.lit(False))]
    twice = F.col("__twice")
    return (
        functools.reduce(DataFrame.unionByName, parts)
        .withColumn("duplicate_citation_path", F.when(twice, F.col("citation_path")))
        .withColumn("parse_status", F.when(twice, "uncertain").otherwise(F.col("parse_status")))
        .withColumn("confidence", F.when(twice, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence")))
        .withColumn("citation_path", F.when(~twice, F.col("citation_path")))
        .drop("__twice")
    )


def uncovered_blocks(blocks: DataFrame, covered: DataFrame) -> DataFrame:
    """Fallback fragments for blocks that nothing holds: ``covered`` has (document_id, reading_order)."""
    exempt = F.col("is_boilerplate") | F.col("block_type").isin("header", "footer") | ~F.col("raw_text").rlike(r"\S")
    left = blocks.where(~exempt).join(covered.select("document_id", "reading_order").distinct(), ["document_id", "reading_order"], "left_anti")
    return left.select("document_id", "reading_order", F.lit("prose").alias("fragment_type"), F.lit("uncertain").alias("parse_status"), F.lit(0.4).alias("confidence"), F.col("raw_text").alias("text"))


def grouped_tables(blocks: DataFrame) -> DataFrame:
    """Cells of runs of table blocks that follow each other on a page; columns part at two spaces or a pipe."""
    w = Window.partitionBy("document_id", "page_number").orderBy("reading_order")
    runs = blocks.where("block_type = 'table_region'").withColumn("run", F.col("reading_order") - F.row_number().over(w))
    first = Window.partitionBy("document_id", "page_number", "run")
    rows = runs.withColumn("table_start", F.min("reading_order").over(first)).withColumn("row_index", F.col("reading_order") - F.col("table_start"))
    return rows.select("document_id", "page_number", "table_start", "row_index", F.posexplode(F.split(F.trim("raw_text"), r"\s{2,}|\s*\|\s*")).alias("col_index", "text")).select(
        "document_id", "page_number", "table_start", "row_index", F.col("col_index").cast("long").alias("col_index"), "text"
    )


def linearize_tables(cells: DataFrame) -> DataFrame:
    """(table_id, text): cells joined by `` | ``, rows by `` ; ``, in order."""
    rows = cells.groupBy("table_id", "row_index").agg(F.sort_array(F.collect_list(F.struct("col_index", "text"))).alias("c"))
    lines = rows.select("table_id", "row_index", F.array_join(F.transform("c", lambda x: x["text"]), " | ").alias("line"))
    whole = lines.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row_index", "line"))).alias("r"))
    return whole.select("table_id", F.array_join(F.transform("r", lambda x: x["line"]), " ; ").alias("text"))


def header_cells(cells: DataFrame) -> DataFrame:
    """Cells under header row 0, with the header of their column and the label of their row; blanks go."""
    heads = cells.where("row_index = 0").select("table_id", "col_index", F.col("text").alias("col_header_path"))
    labels = cells.where("col_index = 0 and row_index > 0").select("table_id", "row_index", F.col("text").alias("row_header_path"))
    body = cells.where("row_index > 0").where(F.trim("text") != "")
    return body.join(heads, ["table_id", "col_index"], "left").join(labels, ["table_id", "row_index"], "left")


# The reference grammar.
REFERENCES = (
    (r"(?i)\b(?:section|sections|subsection|subsections)\s+(\d+(?:\.\d+){0,5})\s+to\s+(\d+(?:\.\d+){0,5})\s+inclusive\b", "range"),
    (r"(?i)\b(?:section|sections|subsection|subsections)\s+(\d+(?:\.\d+){0,5})\b(?!\s+to\s+\d)", "single"),
    (r"(?i)\bSchedule\s+([A-Z]|\d+)\b", "schedule"),
    (r"(?i)\b(?:provided\s+in|provided\s+by|subject\s+to|except\s+as\s+provided\s+in)\s+(\d+(?:\.\d+){0,5})\b", "single"),
)


def _references(text: Column, pattern: str, kind: str) -> Column:
    """What one pattern finds in a text: array<struct<raw, target>>."""
    alone = pattern.replace(r"(?!\s+to\s+\d)", "")

    def found(raw: Column) -> Column:
        first = F.regexp_extract(raw, alone, 1)
        target = {"range": F.concat_ws(" to ", first, F.regexp_extract(raw, pattern, 2)), "schedule": F.concat(F.lit("Schedule "), F.upper(first))}.get(kind, first)
        return F.struct(raw.alias("raw"), target.alias("target"))

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def detect_references(fragments: DataFrame) -> DataFrame:
    """(document_id, fragment_id, raw, target), each once per row; a range names both ends.

    All patterns look at a text in one pass, and at equal texts once.
    """
    found = F.array_distinct(F.concat(*[_references(F.col("text"), pattern, kind) for pattern, kind in REFERENCES]))
    read = read_once(fragments.select("document_id", "fragment_id", "text"), "text", lambda rows: rows.select("*", F.explode(found).alias("r")))
    return read.select("document_id", "fragment_id", "r.raw", "r.target")


def resolve_references(refs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``refs`` plus target_fragment_id, status and confidence; of equal labels in a document the last counts."""
    labels = fragments.where("citation_label is not null").groupBy("document_id", F.col("citation_label").alias("label")).agg(F.max_by("fragment_id", "reading_order").alias("target_fragment_id"))
    start = F.regexp_extract("target", r"^(.*?)(?: to .*)?$", 1)
    joined = refs.withColumn("label", start).join(labels, ["document_id", "label"], "left").drop("label")
    hit = F.col("target_fragment_id").isNotNull()
    return joined.withColumn("status", F.when(hit, "resolved").otherwise("unresolved")).withColumn("confidence", F.when(hit, 0.85).otherwise(0.65))


# Fragments that may stand at a root, and blocks that no fragment needs to hold.
ROOT_TYPES = ("part", "schedule", "appendix", "section", "heading", "prose")
LOOSE_BLOCKS = ("table_region", "header", "footer")


def _unaccounted(blocks: DataFrame) -> DataFrame:
    """Blocks that a fragment or table should hold and none does."""
    return blocks.where(~F.col("is_boilerplate") & ~F.col("block_type").isin(*LOOSE_BLOCKS) & ~F.col("accounted"))


def findings(fragments: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame, refs: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """(rule, severity, object_id): one small query a rule, put together.

    ``fragments`` has citation_path; ``blocks``: block_id, block_type, is_boilerplate, accounted
    (whether a fragment or table holds it); ``refs``: ref_id, raw, status, target_fragment_id;
    ``page_counts``: document_id, page_count.
    """
    fragments = written(fragments)  # each rule reads the columns it looks at
    ids = fragments.select(F.col("fragment_id").alias("parent_fragment_id"))
    paths = fragments.where("citation_path is not null").groupBy("document_id", "citation_path").agg(F.count(F.lit(1)).alias("n"), F.min("fragment_id").alias("fragment_id"))
    rules = [
        ("unaccounted_block", "error", _unaccounted(blocks).select("block_id")),
        ("missing_parent", "error", fragments.where("parent_fragment_id is not null").join(ids, "parent_fragment_id", "left_anti").select("fragment_id")),
        ("odd_root", "warning", fragments.where(F.col("parent_fragment_id").isNull() & ~F.col("fragment_type").isin(*ROOT_TYPES)).select("fragment_id")),
        ("page_range", "error", fragments.where("page_end < page_start").select("fragment_id")),
        ("duplicate_path", "error", paths.where("n > 1").select("fragment_id")),
        ("cycle", "error", cycles(fragments).select("fragment_id")),
        ("orphan_cell", "error", cells.join(tables.select("table_id"), "table_id", "left_anti").select("table_id")),
        ("table_without_cells", "warning", tables.join(cells.select("table_id").distinct(), "table_id", "left_anti").select("table_id")),
        ("blank_reference", "error", refs.where(~F.col("raw").rlike(r"\S")).select("ref_id")),
        ("reference_without_target", "error", refs.where("status = 'resolved' and target_fragment_id is null").select("ref_id")),
    ]
    if page_counts is not None:
        beyond = fragments.join(page_counts, "document_id").where("page_start < 1 or page_end > page_count")
        rules.append(("beyond_pages", "error", beyond.select("fragment_id")))
    parts = [rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(rows.columns[0]).cast("long").alias("object_id")) for rule, severity, rows in rules]
    return functools.reduce(DataFrame.unionByName, parts)


def cycles(fragments: DataFrame) -> DataFrame:
    """Fragments from which walking up the parents comes back to them, however long the way.

    Pointers double until a round leaves as many ends as the one before. The ends of longer ways are
    among those of shorter ones, so that equal counts mean that a step up maps the ends onto
    themselves: they are the fragments of cycles. Rounds are as many as the logarithm of the longest
    way to a cycle, whatever the number of fragments.
    """
    linked = fragments.where("parent_fragment_id is not null").select("fragment_id", F.col("parent_fragment_id").alias("up"))
    # A fragment of a cycle is the parent of another, so that those without children, most of a tree, take no part.
    parents = linked.select(F.col("up").alias("fragment_id")).distinct()
    state = written(linked.join(parents, "fragment_id", "left_semi"))
    ends = written(state.select("up").distinct())
    n, before = ends.count(), None
    while n and n != before:
        above = state.select(F.col("fragment_id").alias("up"), F.col("up").alias("next"))
        state = written(state.join(above, "up").select("fragment_id", F.col("next").alias("up")))
        ends = written(state.select("up").distinct())
        n, before = ends.count(), n
    return ends.select(F.col("up").alias("fragment_id"))


def ingest_status(runs: DataFrame) -> DataFrame:
    """``runs`` (errors, warnings) plus status."""
    return runs.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "completed_with_warnings").otherwise("completed"))


# Weights of the page risk score.
RISK_WEIGHTS = {"uncertain": 3, "odd_roots": 2, "duplicates": 4, "tables": 2, "unresolved": 1, "unaccounted": 5}


def open_references(fragments: DataFrame, known: DataFrame) -> DataFrame:
    """(document_id, page_start, page_end, unresolved): how many references in ``fragments`` have no target in ``known``, for each range of pages.

    Equal texts of a document are read and resolved once, and meet the ranges that hold them by text.
    """
    ranges = written(fragments.groupBy("document_id", "page_start", "page_end", "text").agg(F.count(F.lit(1)).alias("times")))
    texts = written(ranges.select("document_id", "text").distinct().withColumn("fragment_id", F.monotonically_increasing_id()))
    refs = resolve_references(detect_references(texts), known)
    counts = refs.where("status <> 'resolved'").groupBy("fragment_id").agg(F.count(F.lit(1)).alias("n"))
    open_texts = texts.join(counts, "fragment_id").select(F.col("document_id").alias("__document"), F.col("text").alias("__text"), "n")
    held = (F.col("text") == F.col("__text")) & F.col("document_id").eqNullSafe(F.col("__document"))
    return ranges.join(open_texts, held).groupBy("document_id", "page_start", "page_end").agg(F.sum(F.col("n") * F.col("times")).alias("unresolved"))


def page_risk(fragments: DataFrame, refs: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, page, score, reasons): weighted counts of what may be wrong on each page that holds anything.

    Fragments count on all their pages, with their unresolved references; ``fragments`` has a
    boolean duplicate, ``refs`` (fragment_id, status) or what ``open_references`` gives, ``blocks`` (document_id, page, block_type,
    is_boilerplate, accounted, fallback), ``tables`` (document_id, page). Fragments are counted for each
    range of pages before they count on the pages.
    """
    place = ["document_id", "page"]
    odd = F.col("parent_fragment_id").isNull() & ~F.col("fragment_type").isin(*ROOT_TYPES)
    if "unresolved" in refs.columns:
        open_refs, with_refs = refs, fragments
    else:
        open_refs = refs.where("status <> 'resolved'").groupBy("fragment_id").agg(F.count(F.lit(1)).alias("n"))
        with_refs = fragments.join(open_refs, "fragment_id", "left")
    n = F.col("n") if with_refs is not fragments else F.lit(None).cast("long")
    by_range = with_refs.groupBy("document_id", "page_start", "page_end").agg(
        F.count_if(F.col("parse_status") == "uncertain").alias("uncertain"), F.count_if(odd).alias("odd_roots"), F.count_if("duplicate").alias("duplicates"), F.sum(n).alias("unresolved")
    )
    if with_refs is fragments:
        by_range = by_range.unionByName(open_refs, allowMissingColumns=True)
    counted = ["uncertain", "odd_roots", "duplicates", "unresolved"]
    on_pages = by_range.select("document_id", *counted, F.explode(F.sequence("page_start", "page_end")).alias("page"))
    by_fragment = on_pages.groupBy(*place).agg(*[F.sum(c).alias(c) for c in counted])
    lost = ~F.col("is_boilerplate") & ~F.col("block_type").isin(*LOOSE_BLOCKS) & ~F.col("accounted")
    by_block = blocks.groupBy(*place).agg(F.count_if("fallback").alias("fallback"), F.count_if(lost).alias("unaccounted"))
    by_table = tables.groupBy(*place).agg(F.count(F.lit(1)).alias("tables"))
    joined = by_fragment.join(by_block, place, "full").join(by_table, place, "full")
    texts = {
        "uncertain": "uncertain fragments", "odd_roots": "unusual root fragments", "duplicates": "duplicate citation path downgrades", "tables": "tables present",
        "unresolved": "unresolved cross-references", "fallback": "fallback-sensitive blocks", "unaccounted": "unaccounted non-boilerplate blocks",
    }
    counts = joined.fillna(0, list(texts))
    fallback = F.when(F.col("fallback") > 0, F.greatest(F.lit(1), F.floor(F.col("fallback") / 2))).otherwise(0)
    score = sum((F.col(c) * weight for c, weight in RISK_WEIGHTS.items()), fallback)
    reasons = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {said}"))) for c, said in texts.items()]))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("low structural risk"))).otherwise(reasons)
    return counts.select(*place, score.cast("long").alias("score"), reasons.alias("reasons"))


def audit_sample(risk: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` riskiest pages of each document, ties by page."""
    w = Window.partitionBy("document_id").orderBy(F.desc("score"), "page")
    return risk.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merge_ranges(ranges: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Overlapping or touching [start, end] ranges merged: gaps and islands over one sort of the different ranges, so that no order is open."""
    ranges = ranges.select(*keys, "start", "end").distinct()
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("start") > F.coalesce(F.max("end").over(before) + 1, F.lit(-1)), 1).otherwise(0)
    marked = ranges.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(upto))
    return marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def document_summary(blocks: DataFrame, fragments: DataFrame, refs: DataFrame) -> DataFrame:
    """Counts of blocks, fragments and references of each document, 0 where there are none."""
    parts = [df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name)) for name, df in (("blocks", blocks), ("fragments", fragments), ("refs", refs))]
    out = parts[0].join(parts[1], "document_id", "full").join(parts[2], "document_id", "full")
    return out.fillna(0, ["blocks", "fragments", "refs"])


def export_documents(blocks: DataFrame) -> DataFrame:
    """(document_id, json): the blocks of each document in reading order as one JSON array."""
    parts = blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", "page_number", "raw_text"))).alias("b"))
    return parts.select("document_id", F.to_json("b").alias("json"))


def document_outline(fragments: DataFrame, max_fragments: int = 250, full: bool = False, width: int = 180) -> DataFrame:
    """The first fragments of each document in order, with long texts cut."""
    w = Window.partitionBy("document_id").orderBy("depth", "reading_order", "fragment_id")
    ranked = fragments.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_fragments)
    text: Column = F.col("text")
    if not full:
        text = F.when(F.length("text") > width, F.concat(F.rtrim(F.substring("text", 1, width - 1)), F.lit("..."))).otherwise(text)
    return ranked.withColumn("text", text)


def image_captions(images: DataFrame, fragments: DataFrame) -> DataFrame:
    """Each image's fragment: one whose pages hold the image's page, schedules first, then the smallest id.

    A page equi-join on the exploded pages of fragments takes the place of a range join.
    """
    pages = fragments.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"), F.struct((F.col("fragment_type") != "schedule").alias("o"), F.col("fragment_id")).alias("k"))
    best = pages.groupBy("document_id", "page_number").agg(F.min("k").alias("k"))
    return images.join(best, ["document_id", "page_number"], "left").withColumn("fragment_id", F.col("k.fragment_id")).drop("k")
