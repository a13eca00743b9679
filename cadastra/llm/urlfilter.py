"""URL filter: rules first, then a character language-model ratio (operator 3).

Smoothed variable-order Markov models of accepted and rejected urls: the probability of a symbol
after its four predecessors, each order smoothed by the next lower one. N-gram counts are tables
that grow with the urls; the distinct 5-grams of all urls join them once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.work import staged

ORDER, STRENGTH, SYMBOLS = 5, 2.0, 256
#: Share of all symbols' probability for each class, so that a symbol that neither has seen speaks for none.
UNSEEN = 0.01
#: Stands before each url, so that its first symbols have predecessors too.
PAD = "\x01" * (ORDER - 1)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null where none does.

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with its path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def unruled_part(url: Column, host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The url without scheme, last host label, and the host labels and path segments that any rule names.

    The models see this part alone. Otherwise they would learn the text of the rules that label
    their examples. Without ``://`` it is the whole url.
    """
    labels = sorted({x for h, _, _ in rules for x in h.split(".") if x})
    segments = sorted({x for _, p, _ in rules for x in p.split("/") if x})
    inner = F.slice(F.split(host, r"\."), F.lit(1), F.size(F.split(host, r"\.")) - 1)
    left = F.concat(
        F.array_join(F.filter(inner, lambda x: ~x.isin(labels)), "."),
        F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin(segments)), "/"),
        F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1),
    )
    return F.when(F.instr(url, "://") > 0, left).otherwise(F.coalesce(url, F.lit("")))


def left_out(url: Column) -> Column:
    """Whether a url is kept out of the counts to set the cut: three of sixteen, by its digest."""
    return F.substring(F.md5(url.cast("binary")), 1, 1).isin("0", "1", "2")


def gram_ratios(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, ratio) of distinct 5-grams ``asked`` (gram): log of the accepted over the rejected probability of the last symbol.

    ``counted`` has gram, accepted long and rejected long, the numbers of each 5-gram in both
    classes. p_1 = (1 - UNSEEN) * count / all + UNSEEN / SYMBOLS, and
    p_n = (count + STRENGTH * p_(n-1)) / (count of the context + STRENGTH) above.
    """
    kinds = ("accepted", "rejected")
    lower = None
    for n in range(1, ORDER + 1):
        counts = counted.groupBy(F.right("gram", F.lit(n)).alias("gram")).agg(*[F.sum(k).alias(k) for k in kinds])
        totals = counts.groupBy(F.left("gram", F.lit(n - 1)).alias("context")).agg(*[F.sum(k).alias(f"all_{k}") for k in kinds])
        want = asked.select(F.right("gram", F.lit(n)).alias("gram")).distinct().withColumn("context", F.left("gram", F.lit(n - 1)))
        found = want.join(counts, "gram", "left").join(totals, "context", "left")
        if lower is not None:
            found = found.withColumn("suffix", F.right("gram", F.lit(n - 1))).join(lower.withColumnRenamed("gram", "suffix"), "suffix")
        count = {k: F.coalesce(k, F.lit(0)) for k in kinds}
        whole = {k: F.coalesce(f"all_{k}", F.lit(0)) for k in kinds}
        if n == 1:
            p = {k: (1 - UNSEEN) * count[k] / F.greatest(whole[k], F.lit(1)) + UNSEEN / SYMBOLS for k in kinds}
        else:
            p = {k: (count[k] + STRENGTH * F.col(f"p_{k}")) / (whole[k] + STRENGTH) for k in kinds}
        lower = found.select("gram", *[p[k].alias(f"p_{k}") for k in kinds])
    return lower.select("gram", F.log(F.col("p_accepted") / F.col("p_rejected")).alias("ratio"))


def url_scores(texts: DataFrame) -> DataFrame:
    """(part, url_score) of distinct ``texts`` (part, accepted long, rejected long: how often the models learn it).

    The score is the mean ratio over the symbols, to four decimals: a log-likelihood difference
    normalised by length.
    """
    grams = texts.where(F.length("part") > 0).select(
        "part", "accepted", "rejected", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda i: F.substring(F.concat(F.lit(PAD), F.col("part")), i, F.lit(ORDER)))).alias("gram")
    )
    counted = staged(grams.where("accepted > 0 or rejected > 0").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-counts")
    ratios = gram_ratios(counted, grams.select("gram").distinct())
    return grams.select("part", "gram").join(ratios, "gram").groupBy("part").agg(F.round(F.avg("ratio"), 4).alias("url_score"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", false_rejects: float = 0.05) -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, url_score double and verdict (allow or block).

    The models learn from the urls that the rules decide, and see the parts that no rule names
    (``unruled_part``). Where no rule fits, the verdict is allow if the score reaches the cut, the
    ``false_rejects`` quantile of the accepted urls that were left out of the counts. Null and empty urls, and all urls where a class has no example or none is left out, are
    allowed; the score of an empty part is 0. Columns of ``pages`` with the new names are replaced;
    repeated rows count as often and give repeated results; an empty table stays empty.
    """
    new = ("host", "path", "rule", "verdict", "url_score")
    kept = [c for c in pages.columns if c.lower() not in new]
    link, host, path = F.col(f"`{url}`").cast("string"), F.col("host"), F.col("path")
    parsed = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(f"`{url}`").cast("string")).alias("host"), url_path(F.col(f"`{url}`").cast("string")).alias("path"))
    rule, verdict = matching_rule(host, path, rules)
    ruled = parsed.withColumn("rule", rule).withColumn("__ruled", verdict).withColumn("__part", unruled_part(link, host, path, rules))
    taught = F.col("__ruled").isNotNull() & ~left_out(link)
    texts = ruled.groupBy(F.col("__part").alias("part")).agg(
        F.count_if(taught & (F.col("__ruled") == "allow")).alias("accepted"), F.count_if(taught & (F.col("__ruled") == "block")).alias("rejected"), F.count_if((F.col("__ruled") == "allow") & left_out(link)).alias("held")
    )
    texts = staged(texts, "url-parts")
    seen = texts.agg(F.sum("accepted"), F.sum("rejected")).first()
    if not seen[0] or not seen[1]:
        return ruled.withColumn("url_score", F.lit(0.0)).withColumn("verdict", F.coalesce("__ruled", F.lit("allow"))).drop("__ruled", "__part")
    scores = staged(texts.join(url_scores(texts), "part", "left").select(F.col("part").alias("__of"), "held", F.coalesce("url_score", F.lit(0.0)).alias("url_score")), "url-scores")
    # Scores have four decimals, so the quantile holds some ten thousands of different values.
    cut = scores.where("held > 0").agg(F.round(F.expr(f"percentile(url_score, {false_rejects}, held)"), 6)).first()[0]
    scored = ruled.join(scores.drop("held"), F.col("__part") == F.col("__of")).drop("__of", "__part")
    empty = F.coalesce(F.length(link), F.lit(0)) == 0
    by_model = F.when(empty | (F.col("url_score") >= F.lit(cut)) | F.lit(cut is None), "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("__ruled", by_model)).drop("__ruled")
