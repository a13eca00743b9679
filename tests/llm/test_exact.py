"""The exact operators against brute force on small tables, with nulls, empties, ties and clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from cadastra.llm.bpe import Encoder, Vocabulary, bpe_encode_decode
from cadastra.llm.decontaminate import contamination, myers_end
from cadastra.llm.embeddedup import embedding_dedup
from cadastra.llm.jaccardjoin import jaccard_join
from cadastra.llm.linededup import Mph, build_mph, line_dedup
from cadastra.llm.queries import tokenizer_json
from cadastra.llm.substringdedup import substring_dedup
from cadastra.llm.work import connected_components

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3), (2, None)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(260):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 0.5])
        rows.append((i, [float(x) for x in np.float32(v * rng.choice([1, 7.5]))], i % 3 if i % 17 else None))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1), (305, [float("inf")] + [1.0] * 15, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1)]
    return rows + [(400 + i, rows[1][1], 1) for i in range(30)] + [(None, rows[1][1], 1), (1, rows[1][1], 1)]


@pytest.mark.parametrize("block", [8, 2048])
def test_embedding_dedup(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup(df, block=block).collect()}
    assert embedding_dedup(df).count() == len(rows)
    good = {i: (np.array(v, float), lab) for i, v, lab in rows if i is not None and v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(sorted(good), 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    comp = components({i for i, _, _ in rows if i is not None}, links)
    assert links
    for i, _, _ in rows:
        n = sum(i in e for e in links)
        assert got[i] == ((n, comp[i], comp[i] == i) if i is not None else (0, None, True))
    assert embedding_dedup(df.limit(0)).count() == 0


def passages(seed, pieces=14, docs=60, vocabulary=400):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(8, 60))] for _ in range(pieces)]
    out = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(pool)) if rng.random() < 0.7 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = f"e{rng.randrange(10**6)}"
            words += part[rng.randrange(0, 4) :]
        out.append(" ".join(words))
    return out + [out[0]] * 12 + ["", "a b", "x " * 90, "x " * 75]


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 20), (3, 14), (4, 5), (5, 50)])
def test_substring_dedup(spark, seed, window):
    rows = [(i, t, i) for i, t in enumerate(passages(seed))] + [(900, None, 0), (901, " \t\n", 0), (None, passages(seed)[0], 0), (3, passages(seed)[0], 7)]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n_words long, at int, nodes string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup(df, window=window).collect())
    first = {}
    for i, t, _ in rows:
        if i is not None:
            w = SEP.findall(t or "")
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t, _ in rows:
        w = SEP.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        want.append((i if i is not None else -1, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)


def shingles(t, size):
    w = SEP.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()


@pytest.mark.parametrize(("seed", "size", "num", "den", "dealing"), [(1, 4, 85, 100, {}), (2, 5, 4, 5, {"block": 8}), (3, 2, 1, 2, {"block": 4, "hot_blocks": 3, "bucket_rows": 20}), (4, 1, 3, 5, {"hot_blocks": 1, "block": 8}), (5, 3, 1, 1, {"block": 2})])
def test_jaccard_join(spark, seed, size, num, den, dealing):
    rng = random.Random(seed)
    base = passages(seed, docs=30)
    texts = list(base)
    for t in base[:20]:
        for _ in range(5):
            w = t.split()
            for _ in range(rng.randrange(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(["Zed", "new", "w1"])
            texts.append(" ".join(w[: len(w) - rng.randrange(0, 3)]))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(800, None, 1), (801, " ", 1), (802, "One", 1), (803, "one", 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in jaccard_join(df, size=size, num=num, den=den, **dealing).collect()}
    sets = {i: shingles(t, size) for i, t, _ in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = components(set(sets), links)
    for i, s in sets.items():
        assert got[i] == (len(s), sum(i in e for e in links), comp[i]), i
    assert got[None][2] is None
    assert jaccard_join(df.limit(0)).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, keep_first):
    rng = random.Random(1)
    pool = [f"Line {i}" for i in range(8)] + ["", "  Line 1\t", "line 2", "É"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 9))), "s") for i in range(80)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "\n\n", "s"), (None, "Line 1\nx", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup(df, min_docs=10, min_chars=1, keep_first=keep_first).collect())
    key = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s.strip(" \t\n\r\x0b\x0c"))
    held = {}
    for i, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault(k, []).append(10**9 if i is None else i)
    drop = {k: min(v) for k, v in held.items() if len(v) >= 10}
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in drop or (keep_first and drop[key(x)] == i)]
        want.append((-1 if i is None else i, len(lines), len(lines) - len(left), "\n".join(left)))
    assert drop and got == sorted(want)
    assert line_dedup(df.limit(0)).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    at = Mph(build_mph(keys)).index(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))


def edit(pattern, text):
    row = list(range(len(pattern) + 1))
    best = (len(pattern), 0)
    for j, w in enumerate(text):
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, (row[-1], j + 1))
    return best


def test_myers_is_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 120))]
        assert myers_end(p, t) == edit(p, t)


def test_contamination(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 30)))) for i in range(12)] + [(50, None), (51, "too short"), (52, "")]
    docs = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            part = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["new"], ["x", "y"]]) or part[k : k + 1]
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((d, ", ".join(w).upper() if d % 3 == 0 else " ".join(w), "c"))
    docs += [(100, None, "c"), (101, "", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["item_distances"], strict=True)) for r in contamination(df, bench).collect()}
    for d, t, _ in docs:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        want = {}
        for i, text in items:
            p = re.findall(r"[a-z0-9]+", (text or "").lower())
            if p and edit(p, w)[0] <= int(0.2 * len(p)):
                want[i] = edit(p, w)[0]
        assert got[d] == want, d
    assert any(got.values())
    assert all(r["item_ids"] == [] for r in contamination(df, bench.limit(0)).collect())


def test_bpe(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "'s", "'ll", "1", "\n", "\t", "é", "中", "\U0001f600", "\u0301", "\xa0", "\x1c", "²", "<|endoftext|>", "_", "-", "A", "the", " of"]
    texts = ["", None, "a" * 3000, " " * 500] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in bpe_encode_decode(df, tokenizer_json()).collect():
        t = texts[r["doc_id"]] or ""
        ids = reference.encode(t, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == reference.decode(ids, skip_special_tokens=False) == t
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    encoder = Encoder(Vocabulary(tokenizer_json()))
    odd = [np.array([i], "<u4").tobytes() for i in (0, 94, 200, 255, 50256, 30000)]
    assert [encoder.decode(p) for p in odd] == [reference.decode([int(np.frombuffer(p, "<u4")[0])], skip_special_tokens=False) for p in odd]
    assert bpe_encode_decode(df.limit(0), tokenizer_json()).count() == 0
