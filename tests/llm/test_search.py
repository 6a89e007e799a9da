"""Exact top-k search, periodic runs and ranked lexical search against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import periods, queries, ranked, topk
from test_llm import clashing

VECTORS = "vec_id long, embedding array<double>"


def brute_top_k(queries, rows, k):
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(256 * x) for x in v) else [math.floor(256 * x) for x in v]
    out = []
    have = [(i, whole(v)) for i, v in rows]
    for q, v in queries:
        u = whole(v)
        if q is None or u is None:
            continue
        score = lambda w, u=u: min(max(sum(a * b for a, b in zip(u, w, strict=True)), -(1 << 63)), (1 << 63) - 1)
        hits = sorted(((-score(w), i is None, i or 0) for i, w in have if w is not None and len(w) == len(u) and i != q))[:k]
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(hits)]
    return sorted(out, key=repr)


def found_top_k(spark, queries, rows, k):
    df = topk.top_k(clashing(spark.createDataFrame(queries, VECTORS)), clashing(spark.createDataFrame(rows, VECTORS)), k)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("dims", [1, 7, 24])
def test_top_k_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "FIRST_ROWS", 20)
    monkeypatch.setattr(topk, "GROWTH", 8)
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "FIRST_TILE", 4)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 12)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(6, dims))
    vectors = centres[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, dims))
    vectors[::3] = vectors[0]  # one vector is a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    asked = [r for r in rows if r[0] % 20 == 0]
    assert found_top_k(spark, asked, rows, 5) == brute_top_k(asked, rows, 5)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [1.0, 0.5]), (6, [1.0, 0.5]), (7, [-1.0, 0.0]), (None, [1.0, 0.5]), (8, [1.0, 0.5, 0.0]),
            (9, [1e30, 1e30]), (10, [-1e30, 1e200]), (11, [1e307, 1.0]), (12, [])]
    got = found_top_k(spark, rows, rows, 3)
    assert got == brute_top_k(rows, rows, 3)
    assert found_top_k(spark, rows, rows, 99) == brute_top_k(rows, rows, 99)
    assert [x for x in got if x[0] == 2] == [(2, 1, 12, 0)] and not [x for x in got if x[0] in (1, 3, 4, 5, None)]
    assert found_top_k(spark, [], rows, 3) == [] and found_top_k(spark, rows, [], 3) == []


def test_top_k_bounds_prune():
    """No pair that reaches the floor is lost at any resolution, and smooth vectors lose most others at the first ones."""
    rng = np.random.default_rng(3)
    smooth = np.cumsum(rng.normal(size=(300, 64)), axis=1).round()
    r = topk.Resolutions(smooth)
    assert [x.shape[1] for x in r.levels] == [8, 16, 32, 64]
    products = smooth @ smooth.T
    floor = np.sort(products, axis=1)[:, -5]
    i, j = topk.survivors(r, r, floor, np.ones((300, 300), dtype=bool))
    assert {*zip(*np.nonzero(products >= floor[:, None]), strict=True)} <= {*zip(i, j, strict=True)}
    assert len(i) < 0.05 * 300 * 300


def brute_runs(words):
    """Every maximal stretch of every period, those of a smaller period of the same stretch taken out."""
    n, by = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            b = i
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - b >= q and i - b + q >= 12:
                by.setdefault((b - q, i), q)
    return sorted(((s, e - s, q) for (s, e), q in by.items()), key=lambda r: (r[0], r[2]))


def period_words(rng):
    """Texts of few words, of nested periods, of common lines with a number before each, and of prose with a repeated passage."""
    kind = rng.randrange(5)
    if kind == 0:
        return rng.choices("ab", k=rng.randrange(0, 120))
    if kind == 1:
        unit = rng.choices("abc", k=rng.randrange(1, 20))
        return rng.choices("abcd", k=rng.randrange(9)) + unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))] + rng.choices("abcd", k=rng.randrange(9))
    if kind == 2:
        inner = (["a"] * rng.randrange(1, 14) + ["b"]) * rng.randrange(1, 5) + ["c"]
        return inner * rng.randrange(1, 6)
    if kind == 3:
        line = [f"l{k}" for k in range(rng.randrange(3, 9))]
        return [w for k in range(rng.randrange(2, 12)) for w in (f"n{rng.randrange(3)}", *line)]
    words = [f"w{rng.randrange(40)}" for _ in range(150)]
    a = rng.randrange(100)
    return words[:a] + words[a : a + 20] * rng.randrange(1, 4) + words[a + 20 :]


def test_periods_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        many = [period_words(rng) for _ in range(rng.randrange(1, 8))]
        runs, collapsed = periods._texts([" ".join(w).encode() for w in many])
        for words, got, text in zip(many, runs, collapsed, strict=True):
            want = brute_runs(words)
            assert got == want, (words, got, want)
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert text.decode().split() == [w for i, w in enumerate(words) if i not in gone]


def test_periods_stay_sparse():
    """One word, a line behind ever new numbers, and nested periods: openings and diagonals don't grow with the square."""
    for words in (["a"] * 60_000, [w for k in range(6000) for w in (f"n{k}", *"abcdefghi")], (["a"] * 50 + ["b"]) * 1200):
        _, numbers = np.unique(words, return_inverse=True)
        place, _ = periods.openings(numbers)
        assert len(place) < 20 * len(words)
        assert len(periods._texts([" ".join(words).encode()])[0][0]) in (0, 1, 1201)


def test_periods_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 20_000), (4, "word " * 20_000), (None, "a b c d e f " * 2), (6, "é\u00a0x \x0b" * 12), (7, "a b c d e " * 2)]
    for some in (rows, []):
        docs = clashing(spark.createDataFrame(some, "doc_id long, text string")).withColumn("runs", F.lit(1)).withColumn("Collapsed", F.lit("x"))
        out = periods.periodic_runs(docs)
        assert set(out.columns) == {c for c in docs.columns if c not in ("runs", "Collapsed")} | {"runs_input", "Collapsed_input", "runs", "collapsed"}
        got = sorted(((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=repr)
        long = (4, [(0, 20_000, 1)], "word")
        assert got == ([] if not some else sorted([(1, [], ""), (2, [], ""), (3, [], ""), long, long, (0, [(0, 12, 6)], "a b c d e f"), (6, [(0, 12, 1)], "é\u00a0x"), (7, [], "a b c d e a b c d e")], key=repr))


def test_periods_query(spark):
    import zlib

    import pyarrow.parquet as pq

    rows = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    planted = 0
    got = queries.QUERIES["op12_periods"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        want = brute_runs(words) if n < 4000 else None
        if want is None:
            continue
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert planted > 5


def brute_search(items, docs, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    have = [(i, Counter(find(t))) for i, t in docs if find(t)]
    n_docs, n_terms = len(have), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in have:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(find(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def searched(spark, items, docs, k, **given):
    item_df = clashing(spark.createDataFrame(items, "item_id long, text string"))
    df = ranked.ranked_search(item_df, clashing(spark.createDataFrame(docs, "doc_id long, text string")), k, **given)
    assert df.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("short", [1, 16, 10**9])
def test_search_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(ranked, "SEGMENT_BYTES", 4000)
    monkeypatch.setattr(ranked, "SHORT_SHARE", short)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 4)
    rng = random.Random(short)
    vocabulary = [f"{'Tß'[k % 2]}{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    docs = [(i, "-".join(rng.choices(vocabulary, weights, k=rng.choice([3, 40, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # a third of all rows are copies
    items = [(i, " ".join(rng.choices(vocabulary, k=12)) + " common T0 t2") for i in range(12)] + [(99, docs[7][1])]
    assert searched(spark, items, docs, 10) == brute_search(items, docs, 10)


def test_search_edges(spark):
    docs = [(1, None), (2, ""), (3, " -- "), (4, "Alpha beta"), (4, "alpha BETA"), (None, "alpha"), (5, "gamma " * 20_000), (6, "ÀLPHA alpha_beta")]
    items = [(1, "alpha beta"), (1, "gamma"), (2, None), (3, "nowhere"), (4, "\u00c0lpha"), (5, "!"), (None, "beta")]
    assert searched(spark, items, docs, 3) == brute_search(items, docs, 3)
    assert searched(spark, [], docs, 3) == [] and searched(spark, items, [], 3) == []
    assert searched(spark, items, docs[:3], 3) == []
    one = [(7, "only one document")]
    assert searched(spark, [(1, "document")], one, 3) == brute_search([(1, "document")], one, 3)


def test_search_skips_blocks():
    """Blocks that can't reach the k-th best score are not looked into; an index can be searched again."""
    rng = random.Random(2)
    own = ranked.Writer()
    for i in range(3000):
        own.add(i, f"common {'rare' if i < 12 else ''} {rng.randrange(10**6)}".encode())
    n_terms = sum(own.sizes)
    segment = ranked.Segment(own.row().to_pylist()[0], {b"common": 0, b"rare": 1}, 3000, n_terms)
    hits = ranked.Hits(10)
    assert ranked.evaluate(segment, [(0, 1), (1, 5000)], hits) == 1
    assert hits.ids.tolist() == list(range(10))
