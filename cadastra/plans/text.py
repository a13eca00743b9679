"""Queries over text blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import blocks as B
from cadastra.plans.base import query

_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    "src_text_pages",
    r"""WITH pages AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS p, generate_subscripts(string_split(text, chr(12)), 1) AS page FROM {documents}),
        lines AS (SELECT doc_id, page, unnest(string_split(p, chr(10))) AS l, generate_subscripts(string_split(p, chr(10)), 1) - 1 AS line FROM pages)
        SELECT doc_id AS document_id, page AS page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS reading_order,
               trim(l) AS raw_text, line * 12 AS y0 FROM lines WHERE regexp_matches(l, '\S')""",
)
def src_text_pages(t):
    return B.text_to_blocks(t.documents)


@query("src_file_identity", "SELECT doc_id, sha256(text) AS sha256, 'text/plain' AS mime_type FROM {documents}")
def src_file_identity(t):
    from cadastra.sources.files import file_identity

    files = t.documents.select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return file_identity(files).select("doc_id", "sha256", "mime_type")


@query("normalize_text", rf"SELECT doc_id, {_NORM} AS normalized FROM {{documents}}")
def normalize_text(t):
    return t.documents.select("doc_id", B.normalize_text(F.col("text")).alias("normalized"))


@query("strip_page_prefix", r"""SELECT fragment_id, trim(regexp_replace(text, '^\s*PAGE\s+([A-Z"(])', '\1')) AS stripped FROM {d_clauses}""")
def strip_page_prefix(t):
    return t.d_clauses.select("fragment_id", B.strip_page_prefix(F.col("text")).alias("stripped"))


_WORDS = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"


@query(
    "topic_heading",
    rf"""SELECT fragment_id, NOT regexp_matches(text, '[.;:]') AND len({_WORDS}) BETWEEN 1 AND 8 AND regexp_matches(text, '\pL')
               AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[[:lower:]]'))) = 0 AS is_heading FROM {{d_clauses}}""",
)
def topic_heading(t):
    return t.d_clauses.select("fragment_id", B.topic_heading(F.col("text")).alias("is_heading"))


_UNITS = "square metres|square metre|square feet|square foot|percent|metres|sq\\. ft|metre|sq ft|sq\\.ft|foot|feet|m2|m²|ft|%|m"


@query(
    "requirement_value",
    rf"""SELECT fragment_id, regexp_matches(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))),
               '^\(?\s*\d[\d,./]*\s*({_UNITS})[ .;,:]*(except.*|central.*|on-site.*|onsite.*|\(.*)?$') AS is_value FROM {{d_clauses}}""",
)
def requirement_value(t):
    return t.d_clauses.select("fragment_id", B.requirement_value(F.col("text")).alias("is_value"))


_RULES = {"part": "part", "schedule": "schedule", "appendix": "appendix", "np": "numeric_paren", "pn": "paren_numeric", "nu": "numeric", "sc": "subclause", "cl": "clause"}


def _m(rule: str) -> str:
    return f"regexp_matches(n, '{B.CITATIONS[_RULES[rule]]}')"


def _x(rule: str, group: int) -> str:
    return f"regexp_extract(n, '{B.CITATIONS[_RULES[rule]]}', {group})"


_DEPTH = f"(length({_x('nu', 1)}) - length(replace({_x('nu', 1)}, '.', '')) + 1)"
_NU = f"({_m('nu')} AND NOT regexp_matches(n, '^\\d+(?:\\.\\d+){{0,5}}/'))"
CITATION_SQL = f"""
    SELECT *, CASE WHEN {_m("part")} THEN 'part' WHEN {_m("schedule")} THEN 'schedule' WHEN {_m("appendix")} THEN 'appendix' WHEN {_m("np")} THEN 'section'
                WHEN {_m("pn")} THEN 'subsection' WHEN {_NU} THEN CASE WHEN {_DEPTH} = 1 THEN 'section' ELSE 'subsection' END
                WHEN {_m("sc")} THEN 'subclause' WHEN {_m("cl")} THEN 'clause' END AS kind,
           CASE WHEN {_m("part")} THEN 'Part ' || upper({_x("part", 1)}) WHEN {_m("schedule")} THEN 'Schedule ' || upper({_x("schedule", 1)})
                WHEN {_m("appendix")} THEN 'Appendix ' || upper({_x("appendix", 1)}) WHEN {_m("np")} THEN {_x("np", 1)}
                WHEN {_m("pn")} THEN '(' || {_x("pn", 1)} || ')' WHEN {_NU} THEN {_x("nu", 1)}
                WHEN {_m("sc")} THEN '(' || lower({_x("sc", 1)}) || ')' WHEN {_m("cl")} THEN lower({_x("cl", 1)}) END AS label,
           CASE WHEN {_m("part")} OR {_m("schedule")} OR {_m("appendix")} THEN 1 WHEN {_m("np")} THEN 2 WHEN {_m("pn")} THEN 3
                WHEN {_NU} THEN CASE WHEN {_DEPTH} <= 2 THEN {_DEPTH} + 1 ELSE 3 + least({_DEPTH} - 2, 2) END WHEN {_m("sc")} THEN 6 WHEN {_m("cl")} THEN 5 END AS level
    FROM (SELECT *, {_NORM} AS n FROM {{source}})"""


@query("citation_label", f"SELECT fragment_id, kind, label, CAST(level AS INT) AS level FROM ({CITATION_SQL.replace('{source}', '{d_clauses}')})")
def citation_label(t):
    c = B.citation(F.col("text"))
    return t.d_clauses.withColumn("c", c).select("fragment_id", F.col("c.type").alias("kind"), "c.label", "c.level")


@query("classify_block")
def classify_block(t):
    return t.d_clauses.select("fragment_id", B.classify_block(F.col("text")).alias("block_type"))


@query("detect_table_like", r"""SELECT fragment_id, contains(text, '|') OR contains(text, chr(9)) AS is_table FROM {d_clauses}""")
def detect_table_like(t):
    return t.d_clauses.select("fragment_id", B.table_like(F.col("text")).alias("is_table"))


@query(
    "boilerplate",
    r"""WITH k AS (SELECT *, lower(trim(regexp_replace(raw_text, '\s+', ' ', 'g'))) AS key FROM {d_blocks}),
        e AS (SELECT *, key <> '' AND length(key) <= 120 AND NOT regexp_matches(raw_text, '(?i)^\s*(?:\([a-z]\)|\([ivxlcdm]+\)|[-*•])\s+')
                     AND NOT regexp_matches(key, '^(part|schedule|appendix)\s+([a-z]|\d+)\b|^\d+\b|^\(\d+(\.\d+)*\)\s|^\([ivxlcdm]{2,}\)\s|^\([a-z]{1,3}\)\s') AS ok FROM k),
        c AS (SELECT document_id, key, count(*) AS n FROM e WHERE ok GROUP BY document_id, key),
        p AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM k GROUP BY document_id)
        SELECT e.document_id, reading_order, coalesce(ok AND least(pages, 2) >= 2 AND n >= least(pages, 2), false) AS is_boilerplate,
            CASE WHEN coalesce(ok AND least(pages, 2) >= 2 AND n >= least(pages, 2), false) THEN 'footer' END AS block_type
        FROM e JOIN p USING (document_id) LEFT JOIN c ON c.document_id = e.document_id AND c.key = e.key AND ok""",
)
def boilerplate(t):
    return B.boilerplate(t.d_blocks).select("document_id", "reading_order", "is_boilerplate", "block_type")


@query(
    "profile_rules",
    r"""WITH k AS (SELECT fragment_id, page_number, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\b([A-Z]{1,4})-\s+(\d[A-Z]?)\b', '\1-\2', 'g') AS n FROM {d_clauses}),
        s AS (SELECT *, regexp_matches(n, '(?i)^(\(\d+(?:\.\d+)?\)|district,\s+any main building|setback as specified on Schedule 18\.?|not exceed the maximum required building height specified on Schedule 15\.?)') AS rule,
            starts_with(n, 'Regional Centre Land Use By-law |') AS banner FROM k)
        SELECT fragment_id, n AS normalized_text, CASE WHEN banner THEN true WHEN rule THEN false ELSE page_number <= 6 OR fragment_id % 5 = 0 END AS is_boilerplate,
               CASE WHEN banner THEN 'footer' WHEN rule THEN CASE WHEN starts_with(n, '(') THEN 'list_item' ELSE 'paragraph' END WHEN page_number <= 6 THEN 'footer'
                 ELSE CASE fragment_id % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' ELSE 'unknown' END END AS block_type FROM s""",
)
def profile_rules(t):
    k = F.col("fragment_id")
    kind = F.when(k % 3 == 0, "heading").when(k % 3 == 1, "list_item").otherwise("unknown")
    blocks = t.d_clauses.withColumnRenamed("text", "raw_text").withColumn("block_type", kind).withColumn("is_boilerplate", k % 5 == 0)
    return B.profile_rules(blocks).select("fragment_id", "normalized_text", "is_boilerplate", "block_type")


_LINES = """SELECT document_id, CAST(floor(reading_order / 5) AS BIGINT) AS reading_order, string_agg(text, chr(10) ORDER BY reading_order, fragment_id) AS raw_text
    FROM {d_clauses} GROUP BY document_id, CAST(floor(reading_order / 5) AS BIGINT)"""


def _multi_line(t):
    """Five-line blocks out of the clauses."""
    lines = t.d_clauses.withColumn("block", F.floor(F.col("reading_order") / 5).cast("long"))
    parts = lines.groupBy("document_id", "block").agg(F.sort_array(F.collect_list(F.struct("reading_order", "fragment_id", "text"))).alias("p"))
    return parts.select("document_id", F.col("block").alias("reading_order"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("raw_text"))


@query(
    "citation_split",
    f"""WITH b AS ({_LINES}),
        lines AS (SELECT document_id, reading_order, unnest(string_split(raw_text, chr(10))) AS text, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line FROM b),
        c AS (SELECT *, CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS starts FROM ({CITATION_SQL.replace("{source}", "lines")})),
        s AS (SELECT *, CASE WHEN sum(starts) OVER (PARTITION BY document_id, reading_order) > 1
                        THEN greatest(sum(starts) OVER (PARTITION BY document_id, reading_order ORDER BY line) - 1, 0) ELSE 0 END AS segment FROM c)
        SELECT document_id, reading_order, CAST(segment AS BIGINT) AS segment, string_agg(text, chr(10) ORDER BY line) AS text FROM s GROUP BY document_id, reading_order, segment""",
)
def citation_split(t):
    return B.split_at_citations(_multi_line(t))


@query(
    "definition_split",
    rf"""WITH b AS ({_LINES}), n AS (SELECT *, len(regexp_extract_all(raw_text, '(?m)^\s*["“][^"\n]{{{{2,80}}}}?["”]\s+means\b')) AS starts FROM b),
        p AS (SELECT document_id, reading_order, list_filter(list_transform(CASE WHEN starts < 2 THEN [raw_text] ELSE
            string_split(regexp_replace(raw_text, '(?m)(^\s*["“][^"\n]{{{{2,80}}}}?["”]\s+means\b)', chr(1) || '\1', 'g'), chr(1)) END, lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS parts FROM n)
        SELECT document_id, reading_order, unnest(range(0, len(parts))) AS segment, unnest(parts) AS text FROM p""".replace("{{", "{").replace("}}", "}"),
)
def definition_split(t):
    return B.split_at_definitions(_multi_line(t)).select("document_id", "reading_order", F.col("segment").cast("long").alias("segment"), "text")


@query(
    "toc_split",
    """SELECT document_id, segment, text FROM (SELECT document_id, CASE WHEN fragment_id % 5 = 2 THEN concat('ZM-', fragment_id % 40, chr(10)) ELSE '' END || text AS text,
              row_number() OVER (PARTITION BY document_id ORDER BY reading_order, text) - 1 AS segment,
              count(*) OVER (PARTITION BY document_id) AS n FROM {d_clauses} WHERE fragment_id % 24 = 19) WHERE n > 1""",
)
def toc_split(t):
    """Contents of all documents; a fifth of the entries has its code on a line of its own before it."""
    code = F.when(F.col("fragment_id") % 5 == 2, F.concat(F.lit("ZM-"), (F.col("fragment_id") % 40).cast("string"), F.lit("\n"))).otherwise("")
    entries = t.d_clauses.where("fragment_id % 24 = 19").withColumn("text", F.concat(code, "text"))
    parts = entries.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", "text"))).alias("p"))
    blocks = parts.select("document_id", F.lit(0).alias("reading_order"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("raw_text"))
    return B.split_toc(blocks).select("document_id", F.col("segment").cast("long").alias("segment"), "text")


#: Without the look-ahead that the pattern itself has, which DuckDB does not know.
_COMPOUND = r"^(\d+[A-Z]*(?:\([0-9A-Za-z]+\))*[A-Z]?)(?:\s+(.*))?$"
_APART = B.SPLIT_COMPOUND


@query(
    "compound_label",
    rf"""WITH l AS (SELECT fragment_id, (o.o_custkey % 300) || CASE fragment_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'DB(1)' WHEN 2 THEN '(3)(a)' WHEN 3 THEN '(2)(iv)' WHEN 4 THEN ' I' WHEN 5 THEN ' AB of' WHEN 6 THEN 'R'
                WHEN 7 THEN '(3)A' ELSE ' A' END || CASE WHEN fragment_id % 2 = 0 THEN ' Yards' ELSE ' yards' END AS n FROM {{d_clauses}} c JOIN orders o ON o.o_orderkey = c.fragment_id),
        j AS (SELECT *, regexp_matches(n, '{_APART}') AND (length(regexp_extract(n, '{_APART}', 2)) >= 2 OR regexp_matches(regexp_extract(n, '{_APART}', 3), '^[A-Z]')) AS joins FROM l),
        c AS (SELECT fragment_id, n, CASE WHEN joins THEN regexp_extract(n, '{_APART}', 1) || regexp_extract(n, '{_APART}', 2) WHEN regexp_matches(n, '{_COMPOUND}') THEN regexp_extract(n, '{_COMPOUND}', 1) END AS label FROM j),
        k AS (SELECT fragment_id, label, regexp_extract_all(label, '\(([0-9A-Za-z]+)\)', 1) AS tokens FROM c WHERE label IS NOT NULL AND NOT regexp_matches(label, '^\d+$'))
        SELECT fragment_id, label, CAST(2 + len(tokens) + CASE WHEN regexp_matches(label, '\)[A-Z]$') THEN 1 ELSE 0 END AS INT) AS level,
               CASE WHEN regexp_matches(tokens[-1], '^[a-z]$') THEN 'clause' WHEN regexp_matches(tokens[-1], '(?i)^[ivxlcdm]+$') THEN 'subclause'
                 WHEN len(tokens) = 0 THEN 'section' ELSE 'subsection' END AS kind FROM k""",
)
def compound_label(t):
    """Labels in which letters and parentheses follow a number; bare numbers give no row."""
    forms = ["", "DB(1)", "(3)(a)", "(2)(iv)", " I", " AB of", "R", "(3)A", " A"]
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("fragment_id") % 9 + 1).cast("int"))
    title = F.when(F.col("fragment_id") % 2 == 0, " Yards").otherwise(" yards")
    numbers = t.orders.select(F.col("o_orderkey").alias("fragment_id"), (F.col("o_custkey") % 300).cast("string").alias("number"))
    text = F.concat("number", form, title)
    return numbers.withColumn("c", B.compound_citation(B.normalize_text(text))).where("c is not null").select("fragment_id", "c.label", "c.level", F.col("c.type").alias("kind"))


@query(
    "pipe_tables",
    r"""WITH r AS (SELECT document_id, reading_order, unnest(string_split(raw_text, ';')) AS r, generate_subscripts(string_split(raw_text, ';'), 1) - 1 AS row_index
                   FROM {d_blocks} WHERE contains(raw_text, '|')),
        c AS (SELECT document_id, reading_order, row_index, unnest(string_split(r, '|')) AS c, generate_subscripts(string_split(r, '|'), 1) - 1 AS col_index FROM r WHERE contains(r, '|'))
        SELECT document_id, reading_order, row_index, col_index, trim(c) AS text FROM c""",
)
def pipe_tables(t):
    return B.pipe_cells(t.d_blocks)


@query(
    "caption_pick",
    r"""WITH l AS (SELECT document_id, page_number, reading_order, regexp_replace(text, '^Restaurant use \| (\d+).*$', 'Table \1: Uses') AS t FROM {d_clauses}),
        n AS (SELECT *, lead(t) OVER (PARTITION BY document_id, page_number ORDER BY reading_order) AS nxt FROM l),
        c AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order) AS r FROM n WHERE regexp_matches(t, '^\s*Table\s+\d+\s*:'))
        SELECT document_id, page_number, concat_ws(' ', trim(t), CASE WHEN NOT regexp_matches(nxt, '^\s*Table\s+\d+\s*:') THEN trim(nxt) END) AS caption FROM c WHERE r = 1""",
)
def caption_pick(t):
    lines = t.d_clauses.select("document_id", "page_number", "reading_order", F.regexp_replace("text", r"^Restaurant use \| (\d+).*$", "Table $1: Uses").alias("raw_text"))
    return B.captions(lines)


@query(
    "query_terms",
    r"""SELECT question_id, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(question, '[^\pL\pN\s]', ' ', 'g'), '\s+', ' ', 'g'))), ' '),
               lambda w: length(w) > 1 AND NOT list_contains(['what','are','the','for','with','that','this','from','into','can','how','many','does','zone','uses','use'], w)) AS terms
        FROM {d_requests}""",
)
def query_terms(t):
    from cadastra.operators.questions import query_terms as terms

    return t.d_requests.select("question_id", terms(F.col("question")).alias("terms"))
