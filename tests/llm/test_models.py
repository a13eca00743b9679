"""The learned operators: plain versions of their formulas, held-out accuracy, defined results for odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.llm import langid, quality, queries, secrets, urlfilter

SF = "/root/testdata/sf0.01"


def test_url_rules(spark):
    urls = ["http://a.com/x", "http://A.COM/", "http://a.com", "http://notcom/x", "https://example.com/en/1", "https://www.example.com/en/?q", "http://b.example.com/en/", "http://x.net/es/1#f", "http://net/fr/", "ftp://x.net/de/", "no scheme", "", None, "http://?q", "x://h/p://q/", "http://u@a.com:80/p"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    want = {0: ("com/", "allow"), 1: ("com/", "allow"), 2: (None, None), 3: (None, None), 4: ("example.com/en/", "block"), 5: ("www.example.com/en/", "allow"), 6: ("example.com/en/", "block"), 7: ("net/es/", "block"), 8: ("net/fr/", "block"), 9: (None, None), 15: (None, None)}
    for i, (rule, verdict) in want.items():
        assert got[i]["rule"] == rule
        assert verdict is None or got[i]["verdict"] == verdict
    for i, u in enumerate(urls[:9]):
        parts = urlsplit(u)
        assert (got[i]["host"], got[i]["path"]) == (parts.netloc.lower(), parts.path)
    assert (got[10]["host"], got[11]["path"], got[12]["host"]) == ("", "", "")
    assert got[14]["host"] == "h" and got[14]["path"] == "/p://q/"
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert urlfilter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def url_ratio(counts, text):
    """Mean log ratio by the formula; counts: per class a Counter of 5-grams with four marks before each url."""

    def log_p(grams, gram):
        p = 0.99 * sum(c for g, c in grams.items() if g[4] == gram[4]) / sum(grams.values()) + 0.01 / urlfilter.SYMBOLS
        for n in range(2, 6):
            of, same = Counter(), Counter()
            for g, c in grams.items():
                of[g[5 - n :]] += c
                same[g[5 - n : 4]] += c
            p = (of[gram[5 - n :]] + 2 * p) / (same[gram[5 - n : 4]] + 2)
        return math.log(p)

    padded = urlfilter.PAD + text
    return np.mean([log_p(counts[0], padded[i : i + 5]) - log_p(counts[1], padded[i : i + 5]) for i in range(len(text))])


def test_url_model_is_the_formula(spark):
    texts = [("blog/a1", 3, 0), ("blog/b2", 1, 0), ("casino/x", 0, 2), ("casino-é", 0, 1), ("blog/casino", 0, 0), ("?", 0, 0), ("", 1, 1)]
    got = {r["part"]: r["url_score"] for r in urlfilter.url_scores(spark.createDataFrame(texts, "part string, accepted long, rejected long")).collect()}
    counts = [Counter(), Counter()]
    for t, a, r in texts:
        for i in range(len(t)):
            for k, c in enumerate((a, r)):
                counts[k][(urlfilter.PAD + t)[i : i + 5]] += c
    assert set(got) == {t for t, _, _ in texts if t}
    for t, score in got.items():
        assert score == pytest.approx(url_ratio(counts, t), abs=6e-5)
    assert got["blog/a1"] > 0 > got["casino/x"]


def test_url_models_do_not_see_the_rules(spark):
    urls = ["https://www.blog.example.net/en/x/1.html?q#f", "http://example.com", "no scheme", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    part = urlfilter.unruled_part(F.col("url"), urlfilter.url_host(F.col("url")), urlfilter.url_path(F.col("url")), queries.URL_RULES)
    assert [r["part"] for r in df.select(part.alias("part")).collect()] == ["blog/x/1.html?q#f", "", "no scheme", ""]


def test_url_verdicts_of_other_urls(spark):
    bad = [(i, f"http://casino{i}.example.com/en/{i}", "x") for i in range(60)]
    good = [(100 + i, f"http://blog{i}.com/post/{i}", "x") for i in range(200)]
    other = [(900 + i, f"http://casino{i}.org/en/{i}", "x") for i in range(20)] + [(950 + i, f"http://blog{i}.org/post/{i}", "x") for i in range(20)] * 2
    df = spark.createDataFrame([*bad, *good, *other, (999, "http://" + "a" * 20_000, "x")], "page_id long, url string, url_score string")
    rows = urlfilter.filter_urls(df, queries.URL_RULES).collect()
    assert len(rows) == len(bad) + len(good) + len(other) + 1
    blocked = {r["page_id"] for r in rows if r["verdict"] == "block"}
    assert {i for i, _, _ in bad} <= blocked and not blocked & {i for i, _, _ in good}
    assert len(blocked & set(range(900, 920))) >= 18 and len(blocked & set(range(950, 970))) <= 3


def test_quality_keeps_clean_and_rejects_junk(spark):
    docs = queries.table(spark, SF, "documents")
    out = quality.score_quality(docs, queries.trusted_ids(spark, SF)).join(queries.table(spark, SF, "labels"), "doc_id").toPandas()
    clean = out[(out.quality == 1) & (out.toxic == 0)]
    junk = out[(out.quality == 0) & (out.toxic == 0)]
    assert clean.kept.mean() > 0.97 and junk.kept.mean() < 0.1
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "some text", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality.score_quality(odd, odd.select("doc_id").limit(0)).collect()}
    assert got == {1: False, 2: False, 3: True}
    got = {r["doc_id"]: r["kept"] for r in quality.score_quality(odd, odd.select("doc_id")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_language_held_out(spark):
    out = queries.op10_language_id(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_language_odd_rows(spark):
    train = spark.createDataFrame([row for i in range(60) for row in ((f"der die das und ist {i}", "de"), (f"the and of is to {i}", "en"), (None, "fr"), ("x", None))], "text string, lang string")
    model = langid.train_language_id(train)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "THE OF", "x"), (5, "é", "x"), (6, "und das ist " * 30_000, "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(df, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[6][0] == "de" and got[5][0] in ("de", "en")
    assert {r["lang_pred"] for r in langid.language_id(df, None).collect()} == {"und"}
    assert langid.language_id(df.limit(0), model).count() == 0
    assert langid.train_language_id(train.limit(0)) is None


def test_averaged_embeddings_do_not_depend_on_the_batch():
    table = np.random.default_rng(1).normal(size=(langid.SIZE, 3)).astype(np.float32)
    texts = ["abc", "", "Été à la", None, "z"]
    together = langid.averaged(pa.array(texts), table)
    alone = np.concatenate([langid.averaged(pa.array([t], pa.string()), table) for t in texts])
    assert together == pytest.approx(alone)


def test_secrets(spark):
    rows = [(i, f"text {i} password=7602ad27cf5550de{i:02x} and order 4565410125667{i:03d} AKIAMD62HKU6VBLCC{i:03d} end", "s") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, None, None), (101, "", "s"), (102, "1" * 5000, "s")], "doc_id long, text string, source string")
    found = secrets.secret_candidates(df, path="source")
    model = secrets.train_secret_forest(queries.labelled_findings(found))
    kept = secrets.scan_secrets(found, model).where("is_secret").collect()
    assert len(kept) == 120
    for r in kept:
        assert re.fullmatch(r"7602ad27cf5550de..|AKIA.*", r["candidate"])
    assert secrets.train_secret_forest(queries.labelled_findings(found).where("is_secret")) is None
    assert secrets.scan_secrets(found, None).where("is_secret").count() == found.count()
    assert secrets.secret_candidates(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select(*corpus_pipeline.COLUMNS)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.staged(stage(spark, docs, "/root/testdata/sf0.001"), f"t-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
        assert docs.where("n_chars <> length(text)").isEmpty()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    assert corpus_pipeline.jaccard_join(docs.select("doc_id", "text")).where("component_id <> doc_id").isEmpty()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == sizes[-1]
