"""Queries over the usage ledger and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.operators import chat as C
from cadastra.operators import ledger as L
from cadastra.plans.base import query

AS_OF = "2001-08-01 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def _credits(t):
    return _ntz(t.d_credits, "purchased_at")


def _cases(t):
    return _ntz(t.d_cases, "opened_at", "last_activity")


@query("tier_distribution", "SELECT tier, source, state, count(*) AS n FROM {d_credits} GROUP BY tier, source, state")
def tier_distribution(t):
    return L.tier_distribution(t.d_credits)


@query("tier_cube", "SELECT tier, state, count(*) AS n FROM {d_credits} GROUP BY CUBE (tier, state)")
def tier_cube(t):
    return L.tier_cube(t.d_credits)


@query("upgrade_funnel", "SELECT event_type, count(*) AS n FROM {d_usage} WHERE starts_with(event_type, 'upgrade_') GROUP BY event_type")
def upgrade_funnel(t):
    return L.upgrade_funnel(t.d_usage)


@query(
    "credit_balance",
    """SELECT user_id, tier, count(*) FILTER (WHERE state = 'available') AS available, count(*) FILTER (WHERE state = 'reserved') AS reserved, count(*) FILTER (WHERE state = 'consumed') AS consumed
       FROM (SELECT DISTINCT user_id FROM {d_credits}) CROSS JOIN (SELECT unnest(['quick', 'standard', 'complex']) AS tier) LEFT JOIN d_credits USING (user_id, tier) GROUP BY user_id, tier""",
)
def credit_balance(t):
    return L.credit_balance(t.d_credits)


@query(
    "case_list",
    "SELECT * FROM (SELECT user_id, case_id, tier, row_number() OVER (PARTITION BY user_id ORDER BY last_activity DESC, case_id) AS rank FROM {d_cases} WHERE status = 'open') WHERE rank <= 2",
)
def case_list(t):
    return L.case_list(t.d_cases, status="open", n=2).select("user_id", "case_id", "tier", "rank")


_REQUESTS = "SELECT c_custkey AS request_id, c_custkey % 150 AS user_id, concat('key-', CAST(c_custkey % 60 AS VARCHAR)) AS match_key, CASE c_custkey % 3 WHEN 0 THEN 'quick' WHEN 1 THEN 'standard' ELSE 'complex' END AS tier FROM {customer}"


def _requests(t):
    k = F.col("c_custkey")
    tier = F.when(k % 3 == 0, "quick").when(k % 3 == 1, "standard").otherwise("complex")
    return t.customer.select(k.alias("request_id"), (k % 150).alias("user_id"), F.concat(F.lit("key-"), (k % 60).cast("string")).alias("match_key"), tier.alias("tier"), _as_of().alias("as_of"))


@query(
    "case_match",
    f"""WITH r AS ({_REQUESTS}), m AS (SELECT request_id, case_id, row_number() OVER (PARTITION BY request_id ORDER BY last_activity DESC, case_id DESC) AS rank
            FROM r JOIN {{d_cases}} c ON c.user_id = r.user_id AND c.match_key = r.match_key
            WHERE last_activity BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}')
        SELECT r.request_id, case_id FROM r LEFT JOIN m ON m.request_id = r.request_id AND rank = 1""",
)
def case_match(t):
    return L.case_match(_requests(t), _cases(t))


@query(
    "fifo_claim",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY request_id) AS k FROM ({_REQUESTS})),
        c AS (SELECT *, row_number() OVER (PARTITION BY user_id, tier ORDER BY purchased_at, credit_id) AS k FROM {{d_credits}} WHERE state = 'available')
        SELECT request_id, r.user_id, r.tier, credit_id, CASE WHEN credit_id IS NULL THEN 'no_available_credit' ELSE 'claimed' END AS status
        FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.tier = r.tier AND c.k = r.k""",
)
def fifo_claim(t):
    return L.fifo_claim(_requests(t).drop("match_key", "as_of"), t.d_credits)


@query(
    "credit_reuse",
    """WITH s AS (SELECT request_id AS session_id, request_id % 500 AS case_id, user_id, tier FROM (""" + _REQUESTS + """)),
        o AS (SELECT session_id, min(credit_id) AS own FROM {d_credits} WHERE state = 'reserved' AND session_id IS NOT NULL GROUP BY session_id),
        c AS (SELECT case_id, min(credit_id) AS reserved FROM d_credits WHERE state = 'reserved' AND session_id IS NULL GROUP BY case_id),
        f AS (SELECT user_id, tier, arg_min(credit_id, (purchased_at, credit_id)) AS oldest FROM d_credits WHERE state = 'available' GROUP BY user_id, tier)
        SELECT s.session_id, s.case_id, s.user_id, s.tier, coalesce(own, reserved, oldest) AS credit_id,
               CASE WHEN own IS NOT NULL THEN 'session' WHEN reserved IS NOT NULL THEN 'case' WHEN oldest IS NOT NULL THEN 'fifo' ELSE 'none' END AS source
        FROM s LEFT JOIN o USING (session_id) LEFT JOIN c USING (case_id) LEFT JOIN f USING (user_id, tier)""",
)
def credit_reuse(t):
    r = _requests(t).select(F.col("request_id").alias("session_id"), (F.col("request_id") % 500).alias("case_id"), "user_id", "tier")
    return L.credit_reuse(r, t.d_credits)


_EVENTS = "SELECT event_id, user_id * 7 % 15000 AS credit_id, ts, CASE event_type WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'consume' WHEN 'error' THEN 'refund' ELSE 'note' END AS event FROM {events}"


@query(
    "credit_transitions",
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY credit_id ORDER BY ts, event_id) AS k FROM ({_EVENTS})),
        f(credit_id, k, state, applied) AS (
            SELECT credit_id, 0::BIGINT, state, 0 FROM {{d_credits}}
            UNION ALL
            SELECT f.credit_id, e.k, n.s, f.applied + CASE WHEN n.s <> f.state THEN 1 ELSE 0 END FROM f JOIN e ON e.credit_id = f.credit_id AND e.k = f.k + 1,
            LATERAL (SELECT CASE WHEN f.state = 'available' AND e.event = 'reserve' THEN 'reserved' WHEN f.state = 'reserved' AND e.event = 'consume' THEN 'consumed'
                                 WHEN f.state = 'reserved' AND e.event = 'refund' THEN 'available' ELSE f.state END AS s) n)
        SELECT credit_id, arg_max(state, k) AS final_state, arg_max(applied, k)::BIGINT AS applied FROM f GROUP BY credit_id""",
)
def credit_transitions(t):
    e = F.col("event_type")
    event = F.when(e == "click", "reserve").when(e == "purchase", "consume").when(e == "error", "refund").otherwise("note")
    events = t.events.select("event_id", (F.col("user_id") * 7 % 15000).alias("credit_id"), F.col("ts").cast("timestamp").alias("ts"), event.alias("event"))
    return L.credit_transitions(t.d_credits, events).select("credit_id", "final_state", "applied")


@query(
    "sweep_expired",
    f"""WITH i AS (SELECT case_id FROM {{d_cases}} WHERE status = 'open' AND last_activity < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)
        SELECT case_id, NULL::BIGINT AS credit_id, 'closed' AS action FROM i
        UNION ALL SELECT case_id, credit_id, 'refunded' FROM {{d_credits}} WHERE state = 'reserved' AND case_id IN (SELECT case_id FROM i)""",
)
def sweep_expired(t):
    return L.sweep_expired(_cases(t), t.d_credits, _as_of())


@query(
    "sweep_abandoned",
    f"""SELECT credit_id, case_id FROM {{d_credits}} c WHERE state = 'reserved' AND purchased_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
        AND NOT EXISTS (SELECT 1 FROM {{d_cases}} k WHERE k.case_id = c.case_id AND last_activity >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)""",
)
def sweep_abandoned(t):
    return L.sweep_abandoned(_credits(t), _cases(t), _as_of())


@query(
    "sweep_orphans",
    """SELECT credit_id, case_id, tier FROM {d_credits} c WHERE state = 'reserved' AND session_id IS NULL
       AND EXISTS (SELECT 1 FROM d_credits s WHERE s.state = 'reserved' AND s.session_id IS NOT NULL AND s.case_id = c.case_id AND s.tier = c.tier)""",
)
def sweep_orphans(t):
    return L.sweep_orphans(t.d_credits)


@query("issue_credits", "SELECT l_orderkey AS purchase_id, l_linenumber, unit FROM (SELECT l_orderkey, l_linenumber, unnest(range(1, (l_quantity % 5)::INT + 1)) AS unit FROM {lineitem})")
def issue_credits(t):
    p = t.lineitem.select(F.col("l_orderkey").alias("purchase_id"), "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("quantity"))
    return L.issue_credits(p).select("purchase_id", "l_linenumber", "unit")


@query(
    "starter_grants",
    """SELECT user_id, unit, 'starter' AS source FROM (SELECT c_custkey AS user_id FROM {customer} WHERE c_custkey NOT IN (SELECT user_id FROM {d_credits})), (SELECT unnest([1, 2, 3]) AS unit)""",
)
def starter_grants(t):
    return L.starter_grants(t.customer.select(F.col("c_custkey").alias("user_id")), t.d_credits)


@query(
    "offer_matrix",
    """WITH t AS (SELECT p_type AS tier, CAST(floor(min(p_retailprice) * 100) AS BIGINT) AS unit_cents FROM {part} GROUP BY p_type),
        k AS (SELECT p_size AS quantity, p_size * 25 AS discount_bp FROM {part} GROUP BY p_size)
        SELECT tier, quantity, unit_cents * quantity AS list_cents, CAST(floor(unit_cents * quantity * (10000 - discount_bp) / 10000) AS BIGINT) AS price_cents,
               round(floor(unit_cents * quantity * (10000 - discount_bp) / 10000) * 1.37 / 100, 2)::DOUBLE AS display_price FROM t, k""",
)
def offer_matrix(t):
    tiers = t.part.groupBy(F.col("p_type").alias("tier")).agg(F.floor(F.min("p_retailprice") * 100).alias("unit_cents"))
    packs = t.part.select(F.col("p_size").alias("quantity"), (F.col("p_size") * 25).alias("discount_bp")).distinct()
    return L.offer_prices(tiers, packs)


@query(
    "rate_limit",
    """SELECT event_id, recent, recent > 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM {d_usage})""",
)
def rate_limit(t):
    return L.rate_limit(t.d_usage, "1 hour", 2).select("event_id", "recent", "limited")


@query("usage_rollup", "SELECT session_id, sum(tokens)::BIGINT AS tokens, count(*) AS calls, max(event_id) AS last_event FROM {d_usage} GROUP BY session_id")
def usage_rollup(t):
    last = t.d_usage.groupBy("session_id").agg(F.max("event_id").alias("last_event"))
    return L.usage_rollup(t.d_usage).join(last, "session_id").select("session_id", "tokens", "calls", "last_event")


@query("event_dedupe", "SELECT DISTINCT l_orderkey AS event_id FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F')")
def event_dedupe(t):
    return L.event_dedupe(t.lineitem.select(F.col("l_orderkey").alias("event_id")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id")))


@query(
    "purchase_normalize",
    """SELECT event_id, k % 7 AS price_id, CASE WHEN k % 7 < 5 THEN 'pack-' || (k % 7) END AS pack, CASE WHEN k % 7 >= 5 THEN 'unknown price' END AS note
       FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events} WHERE event_type = 'purchase')""",
)
def purchase_normalize(t):
    k = F.from_json("props", "k bigint")["k"]
    rows = t.events.where("event_type = 'purchase'").select("event_id", (k % 7).alias("price_id"))
    prices = t.events.select((F.col("user_id") % 5).alias("price_id")).distinct().withColumn("pack", F.concat(F.lit("pack-"), F.col("price_id").cast("string")))
    return rows.join(prices, "price_id", "left").select("event_id", "price_id", "pack", F.when(F.col("pack").isNull(), "unknown price").alias("note"))


@query(
    "settle_turns",
    """WITH s AS (SELECT session_id, bool_or(has_tool_use) AS tools, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_text, sum(length(text) // 4)::BIGINT AS tokens FROM {d_turns} GROUP BY session_id)
       SELECT session_id, CASE WHEN tools AND coalesce(trim(last_text) <> '', false) THEN 'consume' ELSE 'refund' END AS action, tokens FROM s""",
)
def settle_turns(t):
    return C.settle_turns(t.d_turns)


@query("circuit_trips", "SELECT session_id, sum(length(text))::BIGINT // 4 AS tokens, sum(length(text))::BIGINT // 4 > 1500 AS tripped FROM {d_turns} GROUP BY session_id")
def circuit_trips(t):
    return C.circuit_trips(t.d_turns, 1500)


@query(
    "session_summary",
    """SELECT session_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_text, count_if(role = 'user') AS user_turns, count_if(role = 'assistant' AND trim(text) <> '') AS answers
       FROM {d_turns} GROUP BY session_id""",
)
def session_summary(t):
    return C.session_summary(t.d_turns)


@query(
    "session_title",
    r"""WITH f AS (SELECT session_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS q, 'Lot ' || session_id AS a FROM {d_turns} WHERE role = 'user' GROUP BY session_id)
        SELECT session_id, a || ' · ' || CASE WHEN length(q) > 60 THEN rtrim(q[1:59]) || '…' ELSE q END AS title FROM f""",
)
def session_title(t):
    first = t.d_turns.where("role = 'user'").groupBy("session_id").agg(F.min_by("text", "turn").alias("q"))
    return first.select("session_id", C.session_title(F.concat(F.lit("Lot "), F.col("session_id").cast("string")), F.col("q")).alias("title"))


@query(
    "history_compact",
    """WITH a AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)
                          + CASE WHEN role = 'user' THEN 0 ELSE 1 END AS age FROM {d_turns})
       SELECT session_id, turn, CASE WHEN has_tool_use AND age > 2 THEN '[' || tool_name || ' result omitted]' ELSE text END AS text FROM a""",
)
def history_compact(t):
    return C.history_compact(t.d_turns).select("session_id", "turn", "text")


@query(
    "tool_call_join",
    """SELECT u.tool_id, u.session_id, r.text AS result FROM {d_turns} u LEFT JOIN d_turns r ON r.session_id = u.session_id AND r.turn = u.turn + 1 WHERE u.tool_id IS NOT NULL""",
)
def tool_call_join(t):
    uses = t.d_turns.where("tool_id is not null").select("tool_id", "session_id")
    results = t.d_turns.select(F.concat(F.lit("call-"), F.col("session_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string")).alias("tool_id"), F.col("text").alias("result"))
    return C.tool_calls(uses, results).select("tool_id", "session_id", "result")


@query(
    "latest_parcel_context",
    """SELECT session_id, arg_max(text[1:20], turn) AS location, max(turn) AS turn FROM {d_turns} WHERE tool_name = 'search' AND has_tool_use GROUP BY session_id""",
)
def latest_parcel_context(t):
    return C.latest_context(t.d_turns.withColumn("location", F.when(F.col("has_tool_use"), F.substring("text", 1, 20))))


@query(
    "cited_sources",
    r"""WITH c AS (SELECT session_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS citation FROM {d_turns}),
        f AS (SELECT session_id, citation, min(turn) AS turn FROM c GROUP BY session_id, citation)
        SELECT session_id, citation, turn, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, citation) AS rank FROM f) WHERE rank <= 6""",
)
def cited_sources(t):
    c = t.d_turns.select("session_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("citation"))
    return C.cited_sources(c).select("session_id", "citation", "turn", "rank")


@query("cache_milestones", "SELECT session_id, turn, role = 'assistant' AND row_number() OVER (PARTITION BY session_id, role ORDER BY turn) <= 2 AS milestone FROM {d_turns}")
def cache_milestones(t):
    return C.cache_milestones(t.d_turns).select("session_id", "turn", "milestone")


@query(
    "tool_label",
    """SELECT session_id, turn, CASE tool_name WHEN 'search' THEN 'Search: ' ELSE 'Look up: ' END || CASE WHEN length(text) > 80 THEN text[1:79] || '…' ELSE text END AS label FROM {d_turns}""",
)
def tool_label(t):
    return t.d_turns.select("session_id", "turn", C.tool_label(F.col("tool_name"), F.col("text")).alias("label"))


@query("terms_current", "SELECT c_custkey AS user_id, c_custkey IN (SELECT user_id FROM {events} WHERE event_type = 'signup') AS accepted FROM {customer}")
def terms_current(t):
    return L.terms_current(t.customer.select(F.col("c_custkey").alias("user_id")), t.events.select("user_id", F.col("event_type").alias("version")), "signup")


_INVITES = """SELECT o_orderkey AS invite_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'approved' ELSE 'rejected' END AS status,
    'User' || (o_custkey % 400) || CASE WHEN o_orderkey % 2 = 0 THEN '@Example.org' ELSE '@example.ORG' END AS email, o_orderdate AS decided_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS redeemed_at FROM {orders}"""


def _invites(t):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "approved").otherwise("rejected")
    at = F.col("o_orderdate").cast("timestamp")
    email = F.concat(F.lit("User"), (F.col("o_custkey") % 400).cast("string"), F.when(k % 2 == 0, "@Example.org").otherwise("@example.ORG"))
    return t.orders.select(k.alias("invite_id"), status.alias("status"), email.alias("email"), at.alias("decided_at"), F.when(k % 3 == 0, at).alias("redeemed_at"))


@query("invite_queue", f"SELECT invite_id, status, CASE status WHEN 'pending' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END AS queue FROM ({_INVITES})")
def invite_queue(t):
    return L.invite_queue(_invites(t)).select("invite_id", "status", "queue")


@query("invite_expired", f"SELECT invite_id FROM ({_INVITES}) WHERE status = 'approved' AND redeemed_at IS NULL AND decided_at + INTERVAL 14 DAY < TIMESTAMP '{AS_OF}'")
def invite_expired(t):
    return L.invite_expired(_invites(t), _as_of()).select("invite_id")


@query(
    "invite_transitions",
    f"""WITH i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(email) ORDER BY invite_id) AS rank FROM ({_INVITES})) WHERE rank = 1),
        d AS (SELECT event_id % 15000 AS invite_id, arg_min(CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END, event_id) AS decision FROM {{events}} GROUP BY 1)
        SELECT i.invite_id, CASE WHEN status = 'pending' AND decision IS NOT NULL THEN decision ELSE status END AS status FROM i LEFT JOIN d USING (invite_id)""",
)
def invite_transitions(t):
    d = t.events.select((F.col("event_id") % 15000).alias("invite_id"), F.when(F.col("event_id") % 2 == 0, "approved").otherwise("rejected").alias("decision"), F.timestamp_seconds("event_id").alias("decided_at"))
    return L.invite_transitions(_invites(t), d).select("invite_id", "status")


_FEED = """SELECT user_id * 11 % 2000 AS user_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS kind, event_id AS ts,
    CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END AS name, CASE WHEN event_id % 4 = 0 THEN 'e' || event_id END AS email FROM {events}"""


@query(
    "profile_cdc",
    f"""WITH f AS (SELECT user_id, arg_max(kind, ts) AS last, arg_max(email, ts) FILTER (WHERE email IS NOT NULL) AS e, arg_max(name, ts) FILTER (WHERE name IS NOT NULL) AS n,
                   bool_or(kind = 'created') AS created FROM ({_FEED}) GROUP BY user_id),
        u AS (SELECT c_custkey AS user_id, c_name AS name, NULL::VARCHAR AS email FROM {{customer}})
        SELECT coalesce(u.user_id, f.user_id) AS user_id, coalesce(e, email) AS email, coalesce(n, name) AS name FROM u FULL JOIN f ON u.user_id = f.user_id
        WHERE (u.user_id IS NOT NULL OR coalesce(created, false)) AND coalesce(last, '') <> 'deleted'""",
)
def profile_cdc(t):
    k, e = F.col("event_id"), F.col("event_type")
    feed = t.events.select(
        (F.col("user_id") * 11 % 2000).alias("user_id"),
        F.when(e == "signup", "created").when(e == "error", "deleted").otherwise("updated").alias("kind"),
        k.alias("ts"),
        F.when(k % 3 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("e"), k.cast("string"))).alias("email"),
    )
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("email"))
    return L.profile_changes(users, feed)


@query(
    "payload_contact",
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey WHEN c_custkey % 3 = 1 THEN 'a' || c_custkey ELSE 'f' || c_custkey END AS email,
              CASE WHEN c_custkey % 2 = 0 THEN c_name || ' X' ELSE c_name END AS name FROM {customer}""",
)
def payload_contact(t):
    k = F.col("c_custkey").cast("string")
    mod = F.col("c_custkey") % 3
    emails = F.when(mod == 2, "").otherwise(F.concat(F.lit('"emails":[{"id":"1","email":"a'), k, F.lit('"},{"id":"2","email":"b'), k, F.lit('"}],')))
    primary = F.when(mod == 0, '"primary_id":"2",').otherwise("")
    last = F.when(F.col("c_custkey") % 2 == 0, "X").otherwise(" ")
    payload = F.concat(F.lit("{"), emails, primary, F.lit('"email":"f'), k, F.lit('","first_name":"'), F.col("c_name"), F.lit('","last_name":"'), last, F.lit('"}'))
    return t.customer.select(F.col("c_custkey").alias("user_id"), C.payload_contact(payload).alias("c")).select("user_id", "c.email", "c.name")


@query(
    "contact_backfill",
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'own' END AS email_before, CASE WHEN c_custkey % 2 = 0 THEN s_name ELSE 'own' END AS email,
              CASE WHEN c_custkey % 3 = 0 THEN s_name ELSE c_name END AS name FROM {customer} LEFT JOIN {supplier} ON s_suppkey = c_custkey""",
)
def contact_backfill(t):
    k = F.col("c_custkey")
    users = t.customer.select(k.alias("user_id"), F.when(k % 2 == 0, "").otherwise("own").alias("email"), F.when(k % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    return L.contact_backfill(users, t.supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("email"), F.col("s_name").alias("name")))
