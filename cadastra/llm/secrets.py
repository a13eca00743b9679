"""Secret scan: broad candidates, then a random forest that removes false positives (operator 4)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.textarrays import slices

#: A candidate: 12 or more characters of a key alphabet (that hold a digit), or any value that is assigned to a credential's name.
RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}={0,2}")
ASSIGNED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|credential)s?[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"',;]+)", re.IGNORECASE)
_DIGIT = re.compile("[0-9]")
#: Range of the hashes that pick labelled findings, far above any number of them.
RANGE = 1 << 53
NEAR = 40
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Neighbouring words that speak for a credential, and words that speak for another kind of number.
CREDENTIAL_WORDS = frozenset("auth authorization bearer credential credentials key passphrase passwd password private pwd secret token".split())
OTHER_WORDS = frozenset("account article build card checksum commit digest hash id isbn md5 order page phone sha tel uuid version".split())
FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "distinct", "entropy", "letter_to_digit", "digit_to_letter",
    "case_changes", "longest_run", "hex", "dictionary", "slashes", "path_depth", "path_test",
    "credential_before", "credential_near", "other_before", "assigned", "quoted", "words_before", "words_after",
)


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of all candidates in their order; a run that lies in an assigned value is that value."""
    values = [m.span(1) for m in ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
    spans = set(values)
    ends = iter(sorted(values))
    value = next(ends, None)
    for m in RUN.finditer(text):
        a, b = m.span()
        while value is not None and value[1] <= a:
            value = next(ends, None)
        if (value is None or a < value[0] or b > value[1]) and _DIGIT.search(m.group()):
            spans.add((a, b))
    return sorted(spans)


def _features(text: str, start: int, end: int, path: str, dictionary: frozenset[str]) -> list[float]:
    s = text[start:end]
    n = len(s)
    kinds = "".join("d" if c.isdigit() else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "s" for c in s)
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    run = longest = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    words_before = [w.lower() for w in _WORD.findall(before)]
    words_after = [w.lower() for w in _WORD.findall(after)]
    near = words_before[-3:] + words_after[:2]
    glue = before.rstrip("\"' \t")
    covered = sum(len(w) for w in _WORD.findall(s) if w.lower() in dictionary)
    return [
        float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n, len(set(s)) / n,
        -sum(c / n * math.log2(c / n) for c in Counter(s).values()),
        (pairs["l", "d"] + pairs["u", "d"]) / n, (pairs["d", "l"] + pairs["d", "u"]) / n, (pairs["l", "u"] + pairs["u", "l"]) / n,
        longest / n, float(all(c in "0123456789abcdefABCDEF" for c in s)), covered / n, s.count("/") / n,
        float(path.count("/")), float("test" in path or "example" in path),
        float(any(w in CREDENTIAL_WORDS for w in words_before[-1:])), float(any(w in CREDENTIAL_WORDS for w in near)),
        float(any(w in OTHER_WORDS for w in words_before[-2:])), float(glue[-1:] in ("=", ":") and glue != ""),
        float(before[-1:] in ("\"", "'") and before != ""),
        sum(w in dictionary for w in words_before) / max(len(words_before), 1), sum(w in dictionary for w in words_after) / max(len(words_after), 1),
    ]


def secret_candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, dictionary: frozenset[str] = frozenset()) -> DataFrame:
    """One row per candidate: doc_id long, start int, end int (code points), candidate, before, features array<double>.

    Null and empty texts have none. ``path`` names a column that tells where a text is from.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(path).cast("string") if path else F.lit("")).alias("path")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                for d, t, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")), strict=True):
                    for a, b in candidate_spans(t or ""):
                        rows.append((d, a, b, t[a:b], t[max(0, a - NEAR) : a], _features(t, a, b, p or "", dictionary)))
                names = ["doc_id", "start", "end", "candidate", "before", "features"]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(*columns).mapInArrow(find, "doc_id long, start int, end int, candidate string, before string, features array<double>")


def train_secret_forest(labelled: DataFrame, sample_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (features array<double>, is_secret boolean).

    Fitted on a bounded sample: ``sample_rows`` findings at most in expectation, half of each
    class, picked by a hash of the row. None where a class is missing.
    """
    rows = labelled.where("features is not null and is_secret is not null")
    sizes = {r["is_secret"]: r["n"] for r in rows.groupBy("is_secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / 2 / n)))])
    kept = rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(RANGE)) < F.ceil(share[F.col("is_secret")] * RANGE))
    weight = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(1.0 / max(min(n, sample_rows / 2), 1)))])
    data = kept.select(array_to_vector("features").alias("features"), F.col("is_secret").cast("double").alias("label"), (weight[F.col("is_secret")] * 1000).alias("weight"))
    if data.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=32, seed=seed, weightCol="weight").fit(data.coalesce(2))


def scan_secrets(candidates: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """``candidates`` plus score double (the forest's probability) and is_secret boolean.

    Without a model nothing is known to be false, so all candidates stay with score 1. Repeated
    rows give repeated findings; ties at the threshold count as secrets; an empty table stays empty.
    """
    if model is None:
        return candidates.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    ready = candidates.withColumn("__vector", array_to_vector("features"))
    model = model.setFeaturesCol("__vector").setProbabilityCol("__p").setRawPredictionCol("").setPredictionCol("")
    scored = model.transform(ready).withColumn("score", vector_to_array("__p")[1])
    return scored.drop("__vector", "__p").withColumn("is_secret", F.col("score") >= threshold)


def common_words(docs: DataFrame, text: str = "text", share: float = 0.001) -> frozenset[str]:
    """A dictionary for the coverage features: every word of three letters or more that ``share`` of the
    different texts hold, and two of them at least.

    All documents are counted, copies of a text once. ``share`` bounds the dictionary, whatever the
    number of texts, by their mean number of different words divided by it. Texts meet their copies
    by digests, with their different words instead of themselves.
    """
    some = docs.where(F.length(text) > 0)
    same = [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.length(text).alias("n")]
    # As one string, which takes less than half of what an array of short strings takes.
    words = some.select(*same, F.array_join(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), 1)), " ").alias("ws"))
    once = words.groupBy("h1", "h2", "n").agg(F.first("ws").alias("ws")).where("ws <> ''").select(F.explode(F.split("ws", " ")).alias("w"))
    least = max(2.0, share * some.select(*same).distinct().count())
    found = once.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return frozenset(r["w"] for r in found.select("w").collect())
