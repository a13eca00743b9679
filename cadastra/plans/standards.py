"""The query of the standard lookup and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import standards as S
from cadastra.plans.base import query
from cadastra.sources.lineage import written


def _points(rules: tuple[tuple[str, float], ...]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0 END" for c, v in rules)


def _marked(text: str) -> str:
    return f"(len(list_filter(marks, lambda m: contains(regexp_replace(lower({text}), '[- ]', '', 'g'), m))) > 0)"


def _zoned(text: str) -> str:
    return f"coalesce(contains(regexp_replace(upper({text}), '[- ]', '', 'g'), regexp_replace(upper(zone), '[- ]', '', 'g')), false)"


_MARKS = ", ".join(f"('{s}', [{', '.join(repr(m) for m in S.markers(s))}])" for s in S.STANDARD_MARKERS)
_WORDS = " OR ".join(f"contains(lower(text), '{w}')" for w in ("requirements", "yard", "height", "frontage", "lot area"))

GET_STANDARD = rf"""
    WITH mk AS (SELECT * FROM (VALUES {_MARKS}) AS v(standard, marks)),
    call AS (SELECT question_id, document_id, zone, standard_type AS standard, lower(use_type) AS use_low, lower(area_context) AS area_low FROM {{d_standard_calls}} WHERE standard_type IS NOT NULL),
    b AS MATERIALIZED (SELECT *, upper(text) AS up, trim(regexp_replace(upper(text), '\s+', ' ', 'g')) AS clean FROM {{d_zoning}}),
    z AS (SELECT DISTINCT document_id, zone FROM call WHERE zone IS NOT NULL),
    hits AS (SELECT z.document_id, zone, page_number, CASE WHEN replace(clean, '-', '') = replace(zone, '-', '') || ' ZONE' THEN 1 WHEN contains(clean, '{S.BUILT_FORM}') THEN 2
                    WHEN regexp_matches(up, '{S.ZONE_HEADING}') THEN 3 ELSE 4 END AS tier
             FROM z JOIN b ON z.document_id = b.document_id AND contains(replace(up, '-', ''), replace(zone, '-', ''))),
    pages AS (SELECT DISTINCT document_id, zone, tier, page_number FROM hits JOIN (SELECT document_id, zone, min(tier) AS tier FROM hits GROUP BY ALL) USING (document_id, zone, tier)),
    sec AS (SELECT document_id, zone, tier, list_sort(list(page_number))[:3] AS first_pages, min(page_number) AS start FROM pages GROUP BY ALL),
    heads AS (SELECT document_id, page_number AS head FROM b WHERE contains(clean, '{S.BUILT_FORM}') OR regexp_full_match(clean, '{S.ZONE_HEADING}')),
    s AS MATERIALIZED (SELECT *, least(start + 15, coalesce(head - 1, start + 15)) AS last FROM (SELECT sec.*, (SELECT min(head) FROM heads h WHERE h.document_id = sec.document_id AND head > start) AS head FROM sec)),
    r AS MATERIALIZED (SELECT call.*, marks, tier, first_pages, start, last FROM call JOIN mk USING (standard) LEFT JOIN s USING (document_id, zone)),
    hit AS (SELECT r.*, table_id, page_start AS page, t.text AS table_text, lower(t.text) AS t FROM r JOIN {{d_zoning_tables}} t ON t.document_id = r.document_id
            WHERE (start IS NULL OR page_start BETWEEN start AND last OR standard = 'accessory_structure') AND {_marked("t.text")}
              AND NOT (standard = 'parking' AND contains(lower(t.text), 'parking lots and parking structures existing'))
              AND NOT (standard = 'accessory_structure' AND contains(lower(t.text), 'deleted') AND NOT contains(lower(t.text), 'may be located'))),
    around AS (SELECT h.document_id, h.page, h.zone, reading_order, text, row_number() OVER (PARTITION BY h.document_id, h.page, h.zone ORDER BY reading_order) AS n
               FROM (SELECT DISTINCT document_id, page, zone FROM hit) h JOIN b ON b.document_id = h.document_id AND b.page_number = h.page WHERE {_WORDS} OR {_zoned("text")}),
    context AS (SELECT document_id, page, zone, string_agg(text, ' ' ORDER BY reading_order) AS context FROM around WHERE n <= 5 GROUP BY ALL),
    shown AS (SELECT s.document_id, zone, page_number, reading_order, text, row_number() OVER (PARTITION BY s.document_id, zone ORDER BY page_number, reading_order) AS n
              FROM s JOIN b ON b.document_id = s.document_id AND page_number BETWEEN start AND least(last, start + 2)
              WHERE clean IN (zone || ' ZONE', replace(zone, '-', '') || ' ZONE') OR (length(clean) < 120 AND (contains(lower(text), 'multiple dwelling zone') OR contains(lower(text), 'general residential')))
                 OR (contains(lower(text), 'where any building') AND contains(lower(text), 'shall comply with the following requirements'))),
    intro AS (SELECT document_id, zone, string_agg(text, ' ' ORDER BY page_number, reading_order) AS intro FROM shown WHERE n <= 8 GROUP BY ALL),
    placed AS (SELECT *, lower(text) AS c, regexp_matches(table_text, '\d') AS has_digit FROM (
               SELECT hit.*, lower(coalesce(context, '')) AS p, trim(concat_ws(' ', CASE WHEN standard <> 'accessory_structure' THEN intro END, context, table_text)) AS text
               FROM hit LEFT JOIN context ON context.document_id = hit.document_id AND context.page = hit.page AND context.zone IS NOT DISTINCT FROM hit.zone
               LEFT JOIN intro ON intro.document_id = hit.document_id AND intro.zone = hit.zone)),
    found AS (SELECT question_id, 'table' AS stage, tier, table_id AS source_table_id, NULL::BIGINT AS source_fragment_id, page,
                     4 + {_marked("text")}::INT + {_zoned("text")}::INT + coalesce(list_contains(first_pages, page), false)::INT + {_points(S.TABLE_POINTS)} AS base_score, text
              FROM placed WHERE (zone IS NULL OR standard = 'accessory_structure' OR {_zoned("text")}) AND (use_low IS NULL OR standard = 'parking' OR contains(c, use_low))),
    said AS (SELECT r.question_id, r.document_id, r.standard, r.zone, r.marks, r.tier, r.start, r.last, fragment_id, reading_order, page_number AS page, text, lower(text) AS c FROM r JOIN b ON b.document_id = r.document_id),
    both_ AS MATERIALIZED (
        SELECT *, 'rule' AS stage, 3.5 + {_points(S.RULE_POINTS)} AS base_score FROM said WHERE start IS NOT NULL AND page BETWEEN start AND last AND {_marked("text")}
        UNION ALL SELECT *, 'accessory', 4.0 + {_points(S.ACCESSORY_POINTS)} FROM said
        WHERE standard = 'accessory_structure' AND (contains(c, 'accessory building') OR contains(c, 'accessory structure') OR contains(c, 'footprint'))),
    kids AS (SELECT *, row_number() OVER (PARTITION BY parent_fragment_id ORDER BY fragment_id) AS n FROM b WHERE parent_fragment_id IS NOT NULL),
    near AS (SELECT o.question_id, o.stage, o.fragment_id, string_agg(b.text, ' ' ORDER BY b.reading_order) AS joined FROM both_ o JOIN b ON b.document_id = o.document_id AND b.reading_order BETWEEN o.reading_order AND o.reading_order + 8 GROUP BY ALL),
    beside AS (SELECT o.* REPLACE (lower(joined) AS c), joined, regexp_matches(lower(joined), '{S.MEASURE}') AS has_measure FROM both_ o JOIN near USING (question_id, stage, fragment_id)),
    uses AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY page, reading_order) AS n FROM (
                SELECT said.*, list_filter(string_split(regexp_replace(use_low, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2) AS terms FROM said JOIN call USING (question_id) WHERE said.standard = 'parking' AND use_low IS NOT NULL)
             WHERE len(list_filter(terms, lambda w: contains(c, w))) > 0),
    every AS (
        SELECT * FROM found
        UNION ALL SELECT question_id, stage, tier, NULL, fragment_id, page, base_score, text FROM both_
        UNION ALL SELECT question_id, 'child', tier, NULL, kids.fragment_id, kids.page_number, base_score - 0.05, kids.text FROM both_ JOIN kids ON kids.parent_fragment_id = both_.fragment_id WHERE stage = 'rule' AND n <= 8 AND regexp_matches(kids.text, '{S.CHILD_VALUE}')
        UNION ALL SELECT question_id, 'near', tier, NULL, fragment_id, page, base_score - 0.03 + {_points(S.NEAR_POINTS)} + CASE WHEN {_zoned("joined")} THEN 0.35 ELSE 0 END, joined FROM beside WHERE {_marked("joined")} OR regexp_matches(joined, '\d')
        UNION ALL SELECT question_id, 'parking', tier, NULL, reading_order, page, 5.0 + {_points(S.PARKING_POINTS)} + {_zoned("text")}::INT, text FROM uses
        WHERE n <= 50 AND len(list_filter(terms, lambda w: NOT contains(c, w))) = 0 AND (contains(c, 'parking') OR contains(c, 'accommodation'))),
    each AS (SELECT question_id, stage, source_table_id, source_fragment_id, max(round(base_score, 6)) AS base_score, any_value(tier) AS tier, any_value(page) AS page, arg_max(text, round(base_score, 6)) AS text FROM every GROUP BY question_id, stage, source_table_id, source_fragment_id)
    SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY base_score DESC, CASE stage WHEN 'table' THEN 0 WHEN 'rule' THEN 1 WHEN 'child' THEN 2 WHEN 'near' THEN 3 WHEN 'accessory' THEN 4 ELSE 5 END,
           coalesce(source_table_id, source_fragment_id)))::INT AS rank, stage, tier, source_table_id, source_fragment_id, page, base_score, text
    FROM each QUALIFY rank <= 10"""


@query("get_standard", GET_STANDARD)
def get_standard(t):
    """Calls of all customers, each about the by-law of one customer."""
    lines = written(t.d_zoning)  # derived once; blocks, fragments and tables read it
    fragments = lines.select("document_id", "fragment_id", "parent_fragment_id", F.col("page_number").alias("page_start"), "reading_order", "text")
    return S.get_standard(t.d_standard_calls, lines, t.derived("d_zoning_tables", d_zoning=lines), fragments)
