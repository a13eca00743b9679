"""Usage ledger: cases, prepaid credits with a state machine, usage events, sweeps, rate limits.

All times are columns or an explicit ``as_of``; nothing reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("available", "reserved", "consumed")
TIERS = ("quick", "standard", "complex")
FUNNEL = ("upgrade_offered", "upgrade_accepted", "upgrade_declined", "upgrade_expired")


def tier_distribution(credits: DataFrame) -> DataFrame:
    return credits.groupBy("tier", "source", "state").agg(F.count(F.lit(1)).alias("n"))


def tier_cube(credits: DataFrame) -> DataFrame:
    """Counts for all combinations of tier and state, with subtotals."""
    return credits.cube("tier", "state").agg(F.count(F.lit(1)).alias("n"))


def upgrade_funnel(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(*FUNNEL)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def credit_balance(credits: DataFrame, tiers: Sequence[str] = TIERS) -> DataFrame:
    """One row per user and tier with a count for each state, 0 where there is none."""
    spark = credits.sparkSession
    names = spark.createDataFrame([(t,) for t in tiers], "tier string")
    counts = credits.groupBy("user_id", "tier").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    users = credits.select("user_id").distinct()
    return users.crossJoin(F.broadcast(names)).join(counts, ["user_id", "tier"], "left").fillna(0, list(STATES))


def case_list(cases: DataFrame, status: str | None = None, tier: str | None = None, n: int = 50) -> DataFrame:
    """The ``n`` newest cases of each user."""
    kept = cases
    if status:
        kept = kept.where(F.col("status") == status)
    if tier:
        kept = kept.where(F.col("tier") == tier)
    w = Window.partitionBy("user_id").orderBy(F.desc("last_activity"), "case_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def case_match(requests: DataFrame, cases: DataFrame, days: int = 30) -> DataFrame:
    """Each request's newest case with its user and key that was active in the ``days`` before it.

    ``requests`` has request_id, user_id, match_key and as_of.
    """
    joined = requests.join(cases.select("user_id", "match_key", "case_id", "last_activity"), ["user_id", "match_key"], "left")
    inside = (F.col("last_activity") >= F.col("as_of") - F.expr(f"interval {days} days")) & (F.col("last_activity") <= F.col("as_of"))
    best = F.max(F.when(inside, F.struct("last_activity", "case_id")))
    return joined.groupBy("request_id").agg(best.alias("b")).select("request_id", F.col("b.case_id").alias("case_id"))


def fifo_claim(requests: DataFrame, credits: DataFrame) -> DataFrame:
    """The k-th request of a user and tier takes the k-th oldest available credit: ranks join equally.

    ``requests`` has request_id, user_id and tier; status says whether a credit was there.
    """
    by = ["user_id", "tier"]
    asked = requests.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("request_id")))
    free = credits.where("state = 'available'").select(*by, "credit_id", F.row_number().over(Window.partitionBy(*by).orderBy("purchased_at", "credit_id")).alias("k"))
    return asked.join(free, [*by, "k"], "left").select("request_id", *by, "credit_id", F.when(F.col("credit_id").isNull(), "no_available_credit").otherwise("claimed").alias("status"))


def credit_reuse(sessions: DataFrame, credits: DataFrame) -> DataFrame:
    """A session's own active credit, else its case's reserved one, else the oldest available of its user and tier."""
    active = credits.where("state = 'reserved'")
    own = active.where("session_id is not null").groupBy("session_id").agg(F.min("credit_id").alias("own"))
    case = active.where("session_id is null").groupBy("case_id").agg(F.min("credit_id").alias("reserved"))
    free = credits.where("state = 'available'").groupBy("user_id", "tier").agg(F.min_by("credit_id", F.struct("purchased_at", "credit_id")).alias("oldest"))
    joined = sessions.join(own, "session_id", "left").join(case, "case_id", "left").join(free, ["user_id", "tier"], "left")
    kind = F.when(F.col("own").isNotNull(), "session").when(F.col("reserved").isNotNull(), "case").when(F.col("oldest").isNotNull(), "fifo").otherwise("none")
    return joined.select("session_id", "case_id", "user_id", "tier", F.coalesce("own", "reserved", "oldest").alias("credit_id"), kind.alias("source"))


def transition(state: Column, event: Column) -> Column:
    """Next state; events that do not fit the state leave it."""
    return (
        F.when((state == "available") & (event == "reserve"), "reserved")
        .when((state == "reserved") & (event == "consume"), "consumed")
        .when((state == "reserved") & (event == "refund"), "available")
        .otherwise(state)
    )


def credit_transitions(credits: DataFrame, events: DataFrame) -> DataFrame:
    """``credits`` with final_state and applied: its events folded in order of (ts, event_id).

    A credit's history is one small array; the fold is a higher-order function, so it stays in the JVM.
    """
    history = events.groupBy("credit_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event"))).alias("h"))
    joined = credits.join(history, "credit_id", "left")
    start = F.struct(F.col("state").alias("state"), F.lit(0).alias("applied"))

    def step(acc: Column, e: Column) -> Column:
        after = transition(acc["state"], e["event"])
        return F.struct(after.alias("state"), (acc["applied"] + F.when(after != acc["state"], 1).otherwise(0)).alias("applied"))

    folded = joined.withColumn("f", F.aggregate(F.coalesce("h", F.array().cast("array<struct<ts:timestamp,event_id:bigint,event:string>>")), start, step))
    return folded.select(*credits.columns, F.col("f.state").alias("final_state"), F.col("f.applied").cast("long").alias("applied"))


def sweep_expired(cases: DataFrame, credits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Audit rows: open cases idle over ``days`` close, their reserved credits are refunded."""
    idle = cases.where((F.col("status") == "open") & (F.col("last_activity") < as_of - F.expr(f"interval {days} days"))).select("case_id")
    closed = idle.select("case_id", F.lit(None).cast("long").alias("credit_id"), F.lit("closed").alias("action"))
    refunds = credits.where("state = 'reserved'").join(idle, "case_id", "left_semi").select("case_id", "credit_id", F.lit("refunded").alias("action"))
    return closed.unionByName(refunds)


def sweep_abandoned(credits: DataFrame, cases: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Reserved credits older than ``hours`` whose case had no activity since then."""
    cutoff = as_of - F.expr(f"interval {hours} hours")
    busy = cases.where(F.col("last_activity") >= cutoff).select("case_id")
    return credits.where((F.col("state") == "reserved") & (F.col("purchased_at") < cutoff)).join(busy, "case_id", "left_anti").select("credit_id", "case_id")


def sweep_orphans(credits: DataFrame) -> DataFrame:
    """Reserved credits without a session where another active credit of the case and tier has one."""
    orphan = credits.where("state = 'reserved' and session_id is null").select("credit_id", "case_id", "tier")
    sibling = credits.where("state = 'reserved' and session_id is not null").select("case_id", "tier").distinct()
    return orphan.join(sibling, ["case_id", "tier"], "left_semi").select("credit_id", "case_id", "tier")


def issue_credits(purchases: DataFrame) -> DataFrame:
    """One row for each purchased unit."""
    return purchases.where("quantity > 0").withColumn("unit", F.explode(F.sequence(F.lit(1), F.col("quantity").cast("int"))))


def starter_grants(users: DataFrame, credits: DataFrame, n: int = 3) -> DataFrame:
    """``n`` credits for each user that has none."""
    fresh = users.select("user_id").distinct().join(credits.select("user_id").distinct(), "user_id", "left_anti")
    return fresh.withColumn("unit", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("source", F.lit("starter"))


def offer_prices(tiers: DataFrame, packs: DataFrame, rate: float = 1.37) -> DataFrame:
    """tiers × packs with list price, discounted price in cents (integer basis points) and a second currency."""
    both = tiers.crossJoin(packs)
    listed = F.col("unit_cents") * F.col("quantity")
    price = F.floor(listed * (10000 - F.col("discount_bp")) / 10000)
    return both.select("tier", "quantity", listed.alias("list_cents"), price.cast("long").alias("price_cents"), F.round(price * rate / 100, 2).alias("display_price"))


def rate_limit(events: DataFrame, window: str = "60 seconds", limit: int = 10) -> DataFrame:
    """Each event with the number of its user's events in the trailing window, and whether that passes the limit.

    A range window over microseconds; per user it holds just the window's rows.
    """
    seconds = int(window.split()[0]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[window.split()[1].rstrip("s")]
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("limited", F.col("recent") > limit)


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Tokens and calls of each session."""
    return usage.groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last_ts"))


def event_dedupe(events: DataFrame, processed: DataFrame, key: str = "event_id") -> DataFrame:
    """Events not yet processed, each key once."""
    return events.dropDuplicates([key]).join(processed.select(key), key, "left_anti")


def terms_current(users: DataFrame, acceptances: DataFrame, version: str) -> DataFrame:
    """Users with whether they accepted the live version."""
    ok = acceptances.where(F.col("version") == version).select("user_id").distinct().withColumn("accepted", F.lit(True))
    return users.join(ok, "user_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def invite_queue(invites: DataFrame) -> DataFrame:
    """Pending first, then approved, then the rest; the newest first within each."""
    order = F.when(F.col("status") == "pending", 0).when(F.col("status") == "approved", 1).otherwise(2)
    return invites.withColumn("queue", order)


def invite_expired(invites: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Approved invites past their expiry that were not redeemed."""
    return invites.where((F.col("status") == "approved") & F.col("redeemed_at").isNull() & (F.col("decided_at") + F.expr(f"interval {days} days") < as_of))


def invite_transitions(invites: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pending invites take the first decision on them; others stay; one invite per address."""
    first = decisions.groupBy("invite_id").agg(F.min_by("decision", "decided_at").alias("decision"), F.min("decided_at").alias("at"))
    w = Window.partitionBy(F.lower("email")).orderBy("invite_id")
    single = invites.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    joined = single.join(first, "invite_id", "left")
    takes = (F.col("status") == "pending") & F.col("decision").isin("approved", "rejected")
    return joined.withColumn("status", F.when(takes, F.col("decision")).otherwise(F.col("status"))).withColumn("expires_at", F.when(takes & (F.col("decision") == "approved"), F.col("at") + F.expr("interval 14 days"))).drop("decision", "at")


def profile_changes(users: DataFrame, feed: DataFrame) -> DataFrame:
    """Users after a feed of created, updated and deleted events: absent fields keep their value,
    updates of unknown users are ignored, a deletion removes the user."""
    known = feed.groupBy("user_id").agg(
        F.max_by("kind", "ts").alias("last"),
        F.max_by("email", F.when(F.col("email").isNotNull(), F.col("ts"))).alias("new_email"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ts"))).alias("new_name"),
        F.bool_or(F.col("kind") == "created").alias("created"),
    )
    joined = users.withColumn("known", F.lit(True)).join(known, "user_id", "full")
    kept = joined.where((F.coalesce("known", F.lit(False)) | F.coalesce("created", F.lit(False))) & (F.coalesce("last", F.lit("")) != "deleted"))
    return kept.select("user_id", F.coalesce("new_email", "email").alias("email"), F.coalesce("new_name", "name").alias("name"))


def contact_backfill(users: DataFrame, directory: DataFrame) -> DataFrame:
    """Blank addresses and names filled from a directory, with the values before."""
    d = directory.select("user_id", F.col("email").alias("d_email"), F.col("name").alias("d_name"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return users.join(d, "user_id", "left").select("user_id", F.col("email").alias("email_before"), F.coalesce(blank(F.col("email")), F.col("d_email")).alias("email"), F.coalesce(blank(F.col("name")), F.col("d_name")).alias("name"))
