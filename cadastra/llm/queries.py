"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.bpe import bpe_encode_decode
from cadastra.llm.decontaminate import contamination
from cadastra.llm.embeddedup import embedding_dedup
from cadastra.llm.jaccardjoin import jaccard_join
from cadastra.llm.langid import held_out, language_id, train_language_id
from cadastra.llm.linededup import line_dedup
from cadastra.llm.merkle import leaf_hash, merkle_manifest, proof_text
from cadastra.llm.quality import score_quality
from cadastra.llm.secrets import common_words, scan_secrets, secret_candidates, train_secret_forest
from cadastra.llm.spelling import spelling_groups, word_counts
from cadastra.llm.substringdedup import substring_dedup
from cadastra.llm.topk import top_k_products
from cadastra.llm.urlfilter import filter_urls
from cadastra.llm.work import small_batches, staged

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """The content of a published vocabulary file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_encode_decode(docs, tokenizer_json(), keep_ids=False, keep_decoded=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language_id(docs.where(~held_out(docs["doc_id"])).select("text", "lang"))
    out = language_id(docs.select("doc_id", "text", held_out(docs["doc_id"]).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_rejected")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs, size=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "n_links")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1, digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98)
    return out.select("vec_id", "n_links", "component_id", "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, window=50, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "url_score")


def labelled_findings(candidates: DataFrame) -> DataFrame:
    """Labels for findings whose nature their form tells: issued key formats and values assigned to a
    credential's name are secrets; digit strings and plain words with a number are not."""
    issued = F.col("candidate").rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$")
    assigned = F.col("before").rlike(r"(?i)(password|passwd|secret|token|api_?key)\W{1,4}$")
    harmless = F.col("candidate").rlike(r"^[0-9]+$|^[a-z]+[0-9]{1,2}$")
    label = F.when(issued | assigned, True).when(harmless, False)
    return candidates.withColumn("is_secret", label).where("is_secret is not null")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each finding that the forest keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = staged(secret_candidates(docs, path="source", dictionary=common_words(docs)), "findings")
    kept = scan_secrets(found, train_secret_forest(labelled_findings(found))).where("is_secret")
    return kept.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("secret_sha256"), "score")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def toxic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds."""
    docs = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = docs.select("doc_id", F.explode(F.arrays_zip("item_ids", "item_distances", "item_ends")).alias("hit"))
    return hits.select("doc_id", F.col("hit.item_ids").alias("item_id"), F.col("hit.item_distances").alias("distance"), F.col("hit.item_ends").alias("end_word"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_quality(docs, trusted_ids(spark, sf_dir), toxic_ids=toxic_ids(spark, sf_dir)).select("doc_id", "lang", "perplexity", "max_perplexity", "kept")


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf with its proof, folded anew from what a checker has: a third of the texts come to it in lower case."""
    docs = table(spark, sf_dir, "documents").select(*LEAF)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_hash(*[lower if c == "text" else F.col(c) for c in LEAF]))
    out = merkle_manifest(docs, LEAF, tampered=tampered)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_groups(word_counts(docs, min_length=7, min_count=2, spoil=31), factor=10)


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_top_k": op13_top_k,
}


def _url_sql() -> str:
    """The rules, models and cut of op3 in SQL."""
    host = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = r"coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
    ranked = sorted(URL_RULES, key=lambda r: -len(r[0]) - len(r[1]))
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in ranked]
    rule = " ".join(c + f"'{h}{p}'" for c, (h, p, _) in zip(cases, ranked, strict=True))
    ruled = " ".join(c + f"'{v}'" for c, (_, _, v) in zip(cases, ranked, strict=True))
    orders = []
    for n in range(1, 6):
        orders.append(f"c{n} AS (SELECT right(g, {n}) AS g, sum(a) AS a, sum(r) AS r FROM c GROUP BY 1)")
        orders.append(f"t{n} AS (SELECT left(g, {n - 1}) AS x, sum(a) AS a, sum(r) AS r FROM c{n} GROUP BY 1)")
        join = f"JOIN p{n - 1} l ON l.g = right(w.g, {n - 1})" if n > 1 else ""
        count, whole = f"coalesce(c{n}.%s, 0)", f"coalesce(t{n}.%s, 0)"
        p = f"({count} + 2.0::DOUBLE * l.%s) / ({whole} + 2.0::DOUBLE)" if n > 1 else f"0.99::DOUBLE * {count} / greatest({whole}, 1) + 0.01::DOUBLE / 256"
        orders.append(
            f"p{n} AS (SELECT w.g, {p.replace('%s', 'a')} AS a, {p.replace('%s', 'r')} AS r"
            f" FROM (SELECT DISTINCT right(g, {n}) AS g FROM grams) w LEFT JOIN c{n} ON c{n}.g = w.g LEFT JOIN t{n} ON t{n}.x = left(w.g, {n - 1}) {join})"
        )
    return rf"""
        WITH parsed AS (SELECT page_id, url, {host} AS host, {path} AS path FROM pages),
        ruled AS (
            SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled, substr(md5(url), 1, 1) IN ('0', '1', '2') AS held,
                   CASE WHEN contains(url, '://') THEN
                       array_to_string(list_filter(string_split(host, '.')[1:len(string_split(host, '.')) - 1], lambda x: x NOT IN ('com', 'example', 'net', 'www')), '.')
                       || array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('en', 'es', 'fr')), '/')
                       || regexp_extract(url, '^.*?://[^?#]*(.*)$', 1, 's') ELSE coalesce(url, '') END AS part
            FROM parsed),
        texts AS (
            SELECT part, count(*) FILTER (WHERE ruled = 'allow' AND NOT held) AS a, count(*) FILTER (WHERE ruled = 'block' AND NOT held) AS r
            FROM ruled GROUP BY part),
        grams AS (SELECT part, a, r, substr(repeat(chr(1), 4) || part, i, 5) AS g FROM (SELECT *, unnest(range(1, length(part) + 1)) AS i FROM texts)),
        c AS (SELECT g, sum(a) AS a, sum(r) AS r FROM grams WHERE a > 0 OR r > 0 GROUP BY g),
        {", ".join(orders)},
        scores AS (SELECT part, round(avg(ln(p5.a / p5.r)), 4) AS url_score FROM grams JOIN p5 USING (g) GROUP BY part),
        scored AS (SELECT ruled.*, coalesce(url_score, 0.0) AS url_score FROM ruled LEFT JOIN scores USING (part)),
        cut AS (SELECT round(quantile_cont(url_score, 0.05), 6) AS cut FROM scored WHERE ruled = 'allow' AND held)
        SELECT page_id, host, path, rule, url_score,
               coalesce(ruled, CASE WHEN coalesce(url, '') = '' OR url_score >= cut OR cut IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM scored, cut"""


#: The 256 remainders of a byte-wise CRC-32, from its polynomial.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL; ``tab`` is a column of _CRC_TABLE in scope."""
    bytes_ = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295::BIGINT] || {bytes_}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}, '-')"


_MERKLE = f"""
        WITH RECURSIVE crc AS ({_CRC_TABLE}),
        leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({" || ".join(_field(c) for c in LEAF)}) AS leaf,
                   CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({" || ".join(_field(c) for c in LEAF[:-1])} ||
                       {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered
            FROM documents, crc),
        placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS i FROM leaves),
        nodes(grp, level, i, hash, n) AS (
            SELECT grp, 0, i, leaf, count(*) OVER (PARTITION BY grp) FROM placed
            UNION ALL
            SELECT grp, level + 1, i // 8, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 7) // 8
            FROM nodes WHERE n > 1 GROUP BY grp, level, i // 8),
        subroots AS (SELECT grp, hash, row_number() OVER (ORDER BY grp) - 1 AS i FROM nodes WHERE n = 1),
        tops(level, i, hash, n) AS (
            SELECT 0, i, hash, count(*) OVER () FROM subroots
            UNION ALL
            SELECT level + 1, i // 8, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 7) // 8
            FROM tops WHERE n > 1 GROUP BY level, i // 8),
        runs AS (
            SELECT grp, level, i // 8 AS run, list(hash ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
            UNION ALL
            SELECT s.grp, h.level + t.level, t.run, t.hs
            FROM (SELECT level, i // 8 AS run, list(hash ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY ALL) t
            JOIN (SELECT grp, i FROM subroots) s ON s.i // (8 ** (t.level + 1))::BIGINT = t.run
            JOIN (SELECT grp, max(level) AS level FROM nodes GROUP BY grp) h ON h.grp = s.grp),
        heights AS (SELECT grp, max(level) AS height FROM nodes GROUP BY grp),
        folds(doc_id, leaf, grp, level, i, top, folded, proof) AS (
            SELECT doc_id, leaf, p.grp, 0, p.i, s.i, coalesce(tampered, leaf), ''
            FROM placed p JOIN subroots s ON s.grp = p.grp
            UNION ALL
            SELECT doc_id, leaf, f.grp, f.level + 1, CASE WHEN f.level < height THEN f.i // 8 ELSE 0 END, CASE WHEN f.level < height THEN top ELSE top // 8 END,
                   sha256(array_to_string(hs[:k], '') || folded || array_to_string(hs[k + 2:], '')),
                   proof || array_to_string(hs[:k], '') || array_to_string(hs[k + 2:], '')
            FROM (SELECT f.*, height, CASE WHEN f.level < height THEN f.i ELSE top END % 8 AS k, CASE WHEN f.level < height THEN f.i ELSE top END // 8 AS run
                  FROM folds f JOIN heights h ON h.grp = f.grp) f
            JOIN runs r ON r.grp = f.grp AND r.level = f.level AND r.run = f.run)
        SELECT doc_id, leaf, s.hash AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM folds f JOIN subroots s ON s.grp = f.grp, (SELECT hash AS root FROM tops WHERE n = 1) t
        QUALIFY row_number() OVER (PARTITION BY f.grp, doc_id, leaf ORDER BY level DESC) = 1"""


#: Pairs at one edit meet on the word with one place left open (a replaced letter) or without one letter.
_SPELLING = f"""
        WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
        runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
        hashed AS (SELECT run, n, {_crc32("(doc_id || ':' || run)")} AS h FROM runs, crc WHERE length(run) >= 7),
        words AS MATERIALIZED (
            SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        cuts AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM places),
        pairs AS (
            SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.a || x.b = y.word
            UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.a || x.b = y.word),
        best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY word),
        named AS (SELECT p.word, n_near, most, min(other) AS other FROM pairs p JOIN best b ON b.word = p.word AND b.most = p.n GROUP BY ALL),
        forms AS (
            SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN other END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
            FROM words w LEFT JOIN named b ON b.word = w.word),
        walk(word, root, step) AS (
            SELECT word, word, 0 FROM forms
            UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN forms ON forms.word = root WHERE form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) r ON r.word = f.word"""


ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _MERKLE,
    "op12_spelling_variants": _SPELLING,
    "op13_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10""",
    "op3_url_filter": _url_sql(),
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
               AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(a, b) AS (
            SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
               vec_id <= coalesce(low.b, vec_id) AS kept
        FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN degree ON degree.a = vec_id""",
    "op2_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n
            FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
        windows AS (
            SELECT doc_id, i, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h
            FROM words QUALIFY i + 49 <= n),
        firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
        hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > first),
        marked AS (
            SELECT words.doc_id, words.i, w, max(CASE WHEN hits.i IS NOT NULL THEN hits.i END)
                     OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
            FROM words LEFT JOIN hits ON words.doc_id = hits.doc_id AND words.i = hits.i),
        kept AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
                   string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS k
            FROM marked GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM documents LEFT JOIN kept USING (doc_id)""",
    "op5_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS s
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
               coalesce(degree.n, 0) AS n_links
        FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
        LEFT JOIN degree ON degree.a = d.doc_id""",
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, i, l,
                   translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
                  FROM documents)),
        frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
               sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY doc_id""",
}
