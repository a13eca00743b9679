"""Queries of question understanding and planning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from cadastra.operators import questions as Q
from cadastra.operators import semantic as S
from cadastra.plans.base import query


def listed(words: Iterable[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def holds(t: str, words: Iterable[str]) -> str:
    return f"(len(list_filter([{listed(words)}], lambda w: contains({t}, w))) > 0)"


def named(t: str, words: dict[str, tuple[str, ...]]) -> str:
    cases = ", ".join(f"CASE WHEN {holds(t, w)} THEN '{name}' END" for name, w in words.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def use_phrases(q: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({q}), '[^a-z0-9 -]+', ' ', 'g'), '{Q.USE_PHRASE}', 1)"


def normal_zone(z: str) -> str:
    u = rf"regexp_replace(upper({z}), '\s+', '', 'g')"
    misread = " ".join(f"WHEN replace({u}, '-', '') IN ('L{c.replace('-', '')}', 'I{c.replace('-', '')}') THEN '{c}'" for c in S.KNOWN_ZONES)
    return rf"CASE {misread} WHEN contains({u}, '-') THEN {u} ELSE regexp_replace(regexp_replace({u}, '^([A-Z]{{1,4}})(\d[A-Z]?)$', '\1-\2'), '^([A-Z]{{1,4}})(\d[A-Z])([A-Z])$', '\1-\2-\3') END"


def zones_in(t: str) -> str:
    return rf"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({t}, '{S.ZONE}'), lambda z: NOT regexp_full_match(z, '(?i)(m\s*2|m²)')), lambda z: {normal_zone('z')})))"


def normal_use(u: str) -> str:
    name = rf"replace(lower(regexp_replace(regexp_replace(trim({u}), '^[.,;:]+|[.,;:]+$', '', 'g'), '\s+', ' ', 'g')), ' - ', '-')"
    aliases = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in S.USE_ALIASES.items())
    return f"(CASE {name} {aliases} ELSE {name} END)"


def standards_in(t: str) -> str:
    found = f"list_filter([{listed(S.STANDARDS)}], lambda w: contains(lower({t}), w))"
    maximal = f"list_filter({found}, lambda a: len(list_filter({found}, lambda b: b <> a AND contains(b, a))) = 0)"
    return f"list_transform(list_sort(list_transform({maximal}, lambda w: {{'n': -length(w), 'w': w}})), lambda s: s.w)"


def contexts_in(t: str) -> str:
    word = "regexp_replace(regexp_replace(lower(c), '^interior', 'internal'), '([^s])$', '\\1s')"
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({t}, '{S.CONTEXT}'), lambda c: {word})))"


def _stop_free(p: str, stops: tuple[str, ...], form: str | None = None) -> str:
    """The words of a phrase from the first that is no stop word."""
    words = rf"string_split_regex({p}, '\s+')"
    stop = f"x IN ({listed(stops)})" + (f" OR regexp_full_match(x, '{form}')" if form else "")
    return f"{words}[coalesce(nullif(list_position(list_transform({words}, lambda x: NOT ({stop})), true), 0), 1000):]"


def first_use(q: str) -> str:
    bare = f"list_transform({use_phrases(q)}, lambda p: {_stop_free('p', Q.PLAN_STOPS)})"
    return f"array_to_string(list_filter({bare}, lambda w: len(w) > 0 AND len(w) <= 5 AND array_to_string(w, ' ') NOT IN ({listed(Q.NOT_USES)}))[1], ' ')"


def shortest_use(q: str) -> str:
    stop_free = _stop_free("p", Q.FACT_STOPS, r"([a-z]{1,4}-?\d[a-z]?|\d+)")
    joined = f"array_to_string({stop_free}, ' ')"
    names = f"list_filter(list_transform({use_phrases(q)}, lambda p: {normal_use(joined)}), lambda n: n <> '' AND n NOT IN ({listed(Q.NOT_USES)}))"
    size = "len(string_split(n, ' '))"
    return f"list_transform(list_sort(list_transform({names}, lambda n, i: {{'words': {size}, 'chars': length(n), 'place': i, 'name': n}})), lambda s: s.name)[1]"


_KNOWN = ", ".join(f"CASE WHEN regexp_matches(upper(question), '(^|[^A-Z0-9]){c}($|[^A-Z0-9])') THEN '{c}' END" for c in sorted(S.KNOWN_ZONES, key=len, reverse=True))
_GENERIC = rf"regexp_extract(upper(question), '{Q.PLAN_ZONE}', ['a', 'b', 'c'])"
ZONE = f"coalesce({_KNOWN}, {zones_in('question')}[1], CASE WHEN {_GENERIC}.b <> '' THEN {_GENERIC}.a || '-' || {_GENERIC}.b || CASE WHEN {_GENERIC}.c <> '' THEN '-' || {_GENERIC}.c ELSE '' END END)"

_T = "replace(lower(question), '-', ' ')"
_ALIASES = " ".join(f"WHEN {holds(_T, a)} OR {holds(f'''replace({_T}, ' ', '')''', [x.replace(' ', '') for x in a])} THEN '{name}'" for name, a in Q.STANDARD_ALIASES.items())
STANDARD = f"""CASE WHEN contains({_T}, 'backyard suite') THEN NULL WHEN contains({_T}, 'accessory') AND {holds(_T, ('building', 'structure'))} THEN 'accessory_structure'
    WHEN contains({_T}, 'parking') THEN 'parking' WHEN contains({_T}, 'open space') THEN 'open_space' WHEN {holds(_T, ('density', 'persons per acre', 'dwelling units'))} THEN 'density'
    {_ALIASES} WHEN {holds(_T, ('setback', 'yard'))} THEN 'setback' END"""

NORMAL = r"trim(regexp_replace(lower(question), '\s+', ' ', 'g'))"
UNDERSTOOD = rf"""question_id, question, {named(NORMAL, Q.TOPICS)} AS topics,
    list_concat(list_concat({named(NORMAL, {w: (w,) for w in Q.LEGAL_TERMS})}, {named(NORMAL, Q.DIMENSIONS)}), CASE WHEN {holds(NORMAL, Q.STORY_WORDS)} THEN ['maximum height'] ELSE [] END) AS concepts,
    {named(NORMAL, Q.SECTION_TYPES)} AS section_types,
    list_transform(regexp_extract_all(upper(question), '{Q.ZONE_WORD}', 1), lambda z: replace(z, '-', '')) AS zones,
    regexp_extract_all({NORMAL}, '{Q.USE_WORD}', 1) AS uses, regexp_extract_all(question, '{Q.CITATION}', 1) AS citations,
    {holds(NORMAL, Q.TOPICS['definition'])} OR starts_with({NORMAL}, 'what is') AS needs_definitions"""

_LOW = "lower(question)"
_ASKS = holds(_LOW, Q.PERMISSION_WORDS)
USE = rf"""CASE WHEN contains({_LOW}, 'accessory structure') AND {holds(_LOW, ('permit', 'permitted', 'allowed', 'can '))} THEN 'accessory structure or use'
    WHEN regexp_matches({_LOW}, '\boffice\s+use\b') THEN 'office use' WHEN {holds(_LOW, ('single-unit dwelling', 'single unit dwelling'))} AND {_ASKS} THEN 'single-unit dwelling use'
    WHEN contains({_LOW}, 'townhouse') AND {_ASKS} THEN 'townhouse dwelling use' WHEN contains({_LOW}, 'shipping container') THEN 'shipping container'
    WHEN contains({_LOW}, 'backyard suite') THEN 'backyard suite use' WHEN contains({_LOW}, 'daycare') THEN 'daycare use' WHEN contains({_LOW}, 'day care') THEN 'day care facility'
    WHEN {_ASKS} THEN {first_use(_LOW)} END"""


@query("zone_code", f"SELECT question_id, {ZONE} AS zone FROM {{d_inquiries}}")
def zone_code(t):
    return t.d_inquiries.select("question_id", Q.zone_code(F.col("question")).alias("zone"))


@query("standard_type", f"SELECT question_id, {STANDARD} AS standard FROM {{d_inquiries}}")
def standard_type(t):
    return t.d_inquiries.select("question_id", Q.standard_type(F.col("question")).alias("standard"))


@query("use_name", f"SELECT question_id, {first_use('question')} AS first, {shortest_use('question')} AS shortest FROM {{d_inquiries}}")
def use_name(t):
    q = F.col("question")
    return t.d_inquiries.select("question_id", Q.use_name(q).alias("first"), Q.use_name(q, "shortest").alias("shortest"))


@query("understand_question", f"SELECT {UNDERSTOOD} FROM {{d_inquiries}}")
def understand_question(t):
    return Q.understand(t.d_inquiries)


_TERM_TEXT = "trim(regexp_replace(lower(question), '[^a-z0-9 -]+', ' ', 'g'))"
_TERM = " ".join(f"WHEN starts_with({_TERM_TEXT}, '{p}') THEN nullif({normal_use(f'substr({_TERM_TEXT}, {len(p) + 1})')}, '')" for p in Q.TERM_PREFIXES)


def _entities(kind: str, names: str) -> str:
    return f"list_transform({names}, lambda n: '{kind}:' || n)"


@query(
    "semantic_request",
    rf"""WITH e AS (SELECT *, {_LOW} AS low, {zones_in('question')} AS zones, {standards_in('question')} AS standards, {contexts_in('question')} AS contexts,
            list_sort(list_distinct(regexp_extract_all(question, '\[\d+\]'))) AS markers, contains({_LOW}, 'define') OR starts_with({_LOW}, 'what is ') AS defines FROM {{d_inquiries}})
        SELECT question_id, list_filter([
            CASE WHEN {holds('low', Q.REQUEST_PERMISSION_WORDS)} OR (contains(low, 'condition') AND {holds('low', ('apply', 'applies', 'permitted', 'allowed'))}) THEN 'permission' END,
            CASE WHEN contains(low, 'parking') THEN 'parking_standard' END, CASE WHEN len(contexts) > 0 THEN 'requirement' END,
            CASE WHEN len(standards) > 0 OR {holds('low', Q.REQUEST_STANDARD_WORDS)} THEN 'dimensional_standard' END,
            CASE WHEN len(markers) > 0 THEN 'condition_definition' END, CASE WHEN defines THEN 'definition' END], lambda x: x IS NOT NULL) AS relation_types,
            flatten([{_entities('zone', 'zones')}, {_entities('standard', 'standards')}, {_entities('development_context', 'contexts')}, {_entities('condition_ref', 'markers')},
                list_filter({_entities('use', f'[{shortest_use("question")}]')}, lambda x: x IS NOT NULL),
                CASE WHEN defines AND len(zones) = 0 AND len(standards) = 0 THEN list_filter({_entities('defined_term', f'[CASE {_TERM} END]')}, lambda x: x IS NOT NULL) ELSE [] END]) AS entities FROM e""",
)
def semantic_request(t):
    return Q.semantic_request(t.d_inquiries).select("question_id", "relation_types", F.transform("entities", lambda e: F.concat(e["type"], F.lit(":"), e["name"])).alias("entities"))


def _call(when: str, tool: str, **args: str) -> str:
    fields = ", ".join(f"'{a}': {args.get(a, 'NULL::VARCHAR')}" for a in ("zone", "standard_type", "use_type", "area_context", "argument"))
    return f"CASE WHEN {when} THEN {{'tool': '{tool}', {fields}}} END"


_WIDE = f"question || ' ' || use || ' {Q.PERMISSION_TABLES}'"
_CALLS = ",\n            ".join(
    (
        _call("use IS NOT NULL AND asks", "search_context", argument=_WIDE),
        _call("standard IS NOT NULL AND zone IS NOT NULL", "get_standard", zone="zone", standard_type="standard", use_type="use", area_context="area"),
        _call("permission", "search_context", argument=_WIDE),
        _call("zone IS NOT NULL AND (permission OR dimension)", "get_zone_context", zone="zone"),
        _call("dimension AND (zone IS NULL OR wide)", "search_context", argument="question"),
        _call("intent = 'retrieve_section'", "get_section", argument="citation"),
        _call("intent = 'lookup_definition'", "get_definitions", argument="term"),
        _call("intent = 'general_context_search'", "search_context", argument="question"),
        _call("zone IS NOT NULL AND NOT (permission OR dimension)", "get_zone_context", zone="zone"),
        _call("standard = 'parking' AND NOT permission AND NOT (dimension AND (zone IS NULL OR wide))", "search_context", argument="question"),
    )
)


@query(
    "retrieval_plan",
    rf"""WITH b AS (SELECT question_id, question, {ZONE} AS zone, {STANDARD} AS standard, {USE} AS use, regexp_extract(question, '{Q.PLAN_CITATION}', 1) AS citation,
            CASE WHEN contains({_LOW}, 'south end') THEN 'South End' END AS area, {_ASKS} AS asks, {holds(_LOW, Q.CONTEXT_WORDS)} AS wide,
            trim(regexp_replace(regexp_replace({_LOW}, '^(what is|what does|define)\s+', ''), '^[ ?]+|[ ?]+$', '', 'g')) AS term, starts_with({_LOW}, 'what is') OR contains({_LOW}, 'define') AS defines FROM {{d_inquiries}}),
        i AS (SELECT *, CASE WHEN coalesce(use = 'backyard suite use', false) OR (use IS NOT NULL AND asks) THEN 'lookup_use_permission' WHEN standard = 'parking' THEN 'lookup_parking_requirement'
            WHEN standard IS NOT NULL THEN 'lookup_dimensional_standard' WHEN citation <> '' THEN 'retrieve_section' WHEN defines THEN 'lookup_definition' ELSE 'general_context_search' END AS intent FROM b),
        k AS (SELECT *, intent = 'lookup_use_permission' AS permission, intent IN ('lookup_parking_requirement', 'lookup_dimensional_standard') AS dimension FROM i),
        c AS (SELECT question_id, intent, list_filter([{_CALLS}], lambda x: x IS NOT NULL) AS calls FROM k),
        s AS (SELECT question_id, intent, unnest(calls) AS call, generate_subscripts(calls, 1) - 1 AS step FROM c)
        SELECT question_id, intent, step::BIGINT AS step, call.tool AS tool, call.zone AS zone, call.standard_type AS standard_type, call.use_type AS use_type, call.area_context AS area_context, call.argument AS argument FROM s""",
)
def retrieval_plan(t):
    return Q.retrieval_plan(t.d_inquiries)
