"""Conversation analytics: settlement, summaries, compaction, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settle_turns(turns: DataFrame) -> DataFrame:
    """Per session consume or refund: it qualifies with a tool use and a last assistant text that is not blank."""
    last = F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn")))
    per = turns.groupBy("session_id").agg(F.bool_or("has_tool_use").alias("tools"), last.alias("last_text"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"))
    ok = F.col("tools") & F.coalesce(F.trim("last_text") != "", F.lit(False))
    return per.select("session_id", F.when(ok, "consume").otherwise("refund").alias("action"), F.col("tokens").cast("long").alias("tokens"))


def circuit_trips(turns: DataFrame, budget: int = 150_000) -> DataFrame:
    """Sessions with their characters over four, and whether that passes the budget."""
    per = turns.groupBy("session_id").agg(F.floor(F.sum(F.length("text")) / 4).cast("long").alias("tokens"))
    return per.withColumn("tripped", F.col("tokens") > budget)


def session_summary(turns: DataFrame) -> DataFrame:
    """First user text, number of user turns, number of assistant turns with text."""
    user = F.col("role") == "user"
    return turns.groupBy("session_id").agg(
        F.min_by("text", F.when(user, F.col("turn"))).alias("first_text"),
        F.count_if(user).alias("user_turns"),
        F.count_if((F.col("role") == "assistant") & (F.trim("text") != "")).alias("answers"),
    )


def session_title(anchor: Column, question: Column) -> Column:
    """Anchor up to 40 characters and question up to 60, cut with an ellipsis, else a fixed text."""

    def cut(c: Column, n: int) -> Column:
        text = F.trim(F.regexp_replace(c, r"\s+", " "))
        return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)

    parts = F.concat_ws(" · ", F.nullif(cut(anchor, 40), F.lit("")), F.nullif(cut(question, 60), F.lit("")))
    return F.when(parts == "", "New conversation").otherwise(parts)


def history_compact(turns: DataFrame, keep_recent: int = 2) -> DataFrame:
    """Turns where older tool turns are one line by tool name; the last ``keep_recent`` user turns stay whole.

    A running count of user turns from the end tells how old a turn is.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    age = F.sum((F.col("role") == "user").cast("int")).over(w) + F.when(F.col("role") == "user", 0).otherwise(1)
    old = F.col("has_tool_use") & (F.col("age") > keep_recent)
    return turns.withColumn("age", age).withColumn("text", F.when(old, F.concat(F.lit("["), F.col("tool_name"), F.lit(" result omitted]"))).otherwise(F.col("text")))


def tool_calls(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Tool uses with their results by id."""
    return uses.join(results.select("tool_id", "result"), "tool_id", "left")


def cited_sources(citations: DataFrame, n: int = 6) -> DataFrame:
    """The first ``n`` different citations of each session, in order of first use."""
    first = citations.groupBy("session_id", "citation").agg(F.min("turn").alias("turn"))
    w = Window.partitionBy("session_id").orderBy("turn", "citation")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cache_milestones(turns: DataFrame, n: int = 2) -> DataFrame:
    """Turns with whether they are among the first ``n`` of the assistant."""
    w = Window.partitionBy("session_id", "role").orderBy("turn")
    return turns.withColumn("milestone", (F.col("role") == "assistant") & (F.row_number().over(w) <= n))


def latest_context(calls: DataFrame) -> DataFrame:
    """The newest search with a location in each session."""
    return calls.where("tool_name = 'search' and location is not null").groupBy("session_id").agg(F.max_by("location", "turn").alias("location"), F.max("turn").alias("turn"))


def tool_label(name: Column, argument: Column) -> Column:
    """Short label of a tool call; the argument is cut at 80 characters."""
    cut = F.when(F.length(argument) > 80, F.concat(F.substring(argument, 1, 79), F.lit("…"))).otherwise(argument)
    return F.concat(F.when(name == "search", "Search: ").when(name == "lookup", "Look up: ").otherwise("Tool: "), F.coalesce(cut, F.lit("")))


def payload_contact(payload: Column) -> Column:
    """struct(email, name) of a JSON payload: the primary address by id, else the first, else the flat field."""
    p = F.from_json(payload, "primary_id string, emails array<struct<id:string,email:string>>, email string, first_name string, last_name string")
    primary = F.get(F.filter(p["emails"], lambda e: e["id"] == p["primary_id"]), 0)["email"]
    name = F.concat_ws(" ", F.nullif(F.trim(p["first_name"]), F.lit("")), F.nullif(F.trim(p["last_name"]), F.lit("")))
    return F.struct(F.coalesce(primary, F.get(p["emails"], 0)["email"], p["email"]).alias("email"), F.nullif(name, F.lit("")).alias("name"))
