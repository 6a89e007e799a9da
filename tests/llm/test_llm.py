"""Training-data operators against brute force, round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loam.llm import chat, decontam, jaccard, langid, mixing, pii, quality, queries, repeats, secrets, shared, urlfilter
from parity import compare

SF = "/root/testdata/sf0.001"
EDGE = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "en", None), (4, "one", "en", "b"), (4, "one", "en", "b"),
    (None, "no id here but some words to read", None, "b"), (5, "word " * 20_000, "de", "c"), (6, "word " * 20_000, "de", "c"),
]


#: Names used inside the operators or added by them.
CLASHES = ("m", "failed_rule", "keys", "th", "host", "category", "listed", "n_active", "findings", "language", "leaks", "_leaks", "pii", "_pii", "_id",
           "_th", "_terms", "repeats", "size", "ix", "at", "k", "branch", "pos", "n", "shard", "slot", "seg", "_seg", "_day", "day", "spans")


def clashing(df):
    for i, c in enumerate(CLASHES):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(i))
    return df


def edge(spark, rows=EDGE):
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))


def passed(before, after, added=()):
    """All columns of the input are there, those named like an added one under another name."""
    return {f"{c}_input" if c in added else c for c in before.columns} | set(added) == set(after.columns)


def texts(seed=1, n=60):
    """Random word texts with copies, near copies, a line in a third of them and moved passages."""
    rng = random.Random(seed)
    vocab = ["w" + str(i) for i in range(400)]
    line = " ".join(rng.choices(vocab, k=14))
    out = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.choice([3, 30, 120, 300]))
        t = " ".join(words)
        if out and i % 5 == 0:
            t = rng.choice(out)
        elif out and i % 7 == 0:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 3 == 0:
            t += "\n" + line
        if i % 9 == 0:
            t = "É " + t + " ß"
        out.append(t)
    return list(enumerate(out))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF) > 0


@pytest.mark.parametrize("rows", [EDGE, []])
def test_edges(spark, rows):
    docs = edge(spark, rows)
    n = len(rows)
    report = quality.quality_report(docs)
    assert passed(docs, report, ("m", "failed_rule"))
    assert not n or [r.failed_rule for r in report.orderBy("doc_id").collect()] == ["short"] * 6 + ["repeats"] * 2
    assert quality.quality_filter(docs).columns == docs.columns
    found = pii.find_pii(docs)
    assert found.count() == n and passed(docs, found, ("pii",))
    clean = pii.sanitise(docs)
    assert sorted(clean.columns) == sorted(docs.columns) and sorted(map(repr, clean.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    scanned = secrets.find_secrets(docs)
    assert scanned.count() == n and passed(docs, scanned, ("findings",))
    told = langid.identify(docs, langid.train(docs))
    assert passed(docs, told, ("language",))
    found = {(r.doc_id, r.language.lang) for r in told.collect()}
    assert not n or {(1, "und"), (2, "und"), (3, "und"), (5, "de")} <= found
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert not n or near == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 5), 6: (1, 5)}
    stay = jaccard.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and stay.count() == max(0, n - 1)
    cut = repeats.repeated_passages(docs).collect()
    assert len(cut) == n and (not n or {r.doc_id: r.repeats.n_removed for r in cut}[6] == 100_000)
    placed, _, spans = mixing.mix(docs)
    taken = mixing.taken_words(placed, spans).collect()
    assert len(taken) == n and all(r.taken <= 2 * r.size for r in taken)
    mixed = mixing.mixed_texts(docs).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()
    want = defaultdict(int)
    for r in taken:
        want[r.doc_id] += r.taken
    assert {r.doc_id: r.n for r in mixed} == {d: k for d, k in want.items() if k}
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "item_id long, text string")
    assert passed(docs, decontam.with_leaks(docs, bench), ("leaks",))
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert not n or decontam.decontaminate(docs, bench).count() == n - 2
    assert decontam.decontaminate(docs, bench.limit(0)).count() == n


@pytest.mark.parametrize("n", [0, 6])
def test_url_edges(spark, n):
    long_url = "http://x.example/" + "a" * 100_000
    rows = [(1, None, 5), (2, "", 5), (3, long_url, 5), (3, long_url, 5), (4, "http://x.example/q", None), (5, "http://x.example/q", 5)][:n]
    caps = clashing(spark.createDataFrame(rows, "id long, url string, fetch_day long"))
    entries = spark.createDataFrame([("d:x.example", 1, "add", None), ("d:x.example", None, "add", "y"), (None, 1, "add", "z")], "key string, day long, action string, category string")
    for log in (entries, entries.limit(0)):
        got = urlfilter.url_filter(caps, log)
        assert passed(caps, got, ("host", "n_active", "listed", "category"))
        listed = sorted(r.id for r in got.collect() if r.listed)
        assert got.count() == n and listed == ([3, 3, 5] if n and log is entries else [])


def test_mix_is_exact_and_repeats(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    run = lambda: mixing.mix(docs, block=16, shard_words=700)
    placed, per, spans = run()
    quota = {r.source: r.quota for r in per.collect()}
    rows = spans.collect()
    got = defaultdict(int)
    for r in rows:
        got[r.source] += r.n
    assert dict(got) == quota and len({r.shard for r in rows}) > 10
    units = spans.groupBy("shard").agg(F.countDistinct("ix", "slot").alias("u")).collect()
    assert max(r.u for r in units) - min(r.u for r in units) <= 1
    assert sorted(rows) == sorted(run()[2].collect())
    texts = mixing.mixed_texts(docs, block=16, shard_words=700)
    parts = texts.withColumn("part", F.spark_partition_id()).collect()
    by_part = defaultdict(list)
    for r in parts:
        by_part[r.part].append((r.shard, r.slot))
    assert all(v == sorted(v) for v in by_part.values()) and len({(r.shard, r.part) for r in parts}) == len({r.shard for r in parts})
    big = spark.createDataFrame([("a", 0, 256 * (1 << 36), 0.0, 1)], "source string, ix int, source_size long, target double, quota long")
    r = mixing._plan(big, 256).withColumn("block", F.lit((1 << 36) - 7).cast("long")).withColumn("pos", mixing._permuted(F.col("block"))).first()
    assert r.blocks == 1 << 36 and r.pos == (((1 << 61) - 1) % r.blocks * r.block + r["add"]) % r.blocks
    assert {r.source: r.n for r in texts.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()} == quota


@pytest.mark.parametrize("common", [False, True])
def test_repeats_brute_force(spark, monkeypatch, common):
    rows = texts(3, 80)
    if common:  # common anchors, long texts in pieces, several stretches, copies of one id
        for name, value in (("PIECE", 700), ("STRETCH_BYTES", 3000)):
            monkeypatch.setattr(repeats, name, value)
        for name, value in (("HOT", 3), ("MANY", 5), ("STRETCH_KEYS", 300), ("CHUNK_BYTES", 4000)):
            monkeypatch.setattr(shared, name, value)
        line = "a line that very many of these documents hold at some place or other, as it is"
        rows = [(d, t + (line if d % 2 else "") + t[:60]) for d, t in rows] + [(200, " ".join(t for _, t in rows))]
    got = {r.doc_id: r for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen: dict[bytes, int] = {}
    for d, t in rows:
        raw = t.encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], d) < d:
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        r = got[d].repeats
        assert (r.n_removed, r.kept_sha256) == (sum(mark), hashlib.sha256(kept).hexdigest()), d


def test_repeats_compare_bytes(monkeypatch):
    blob = repeats.np.frombuffer(b"".join(bytes([65 + i % 7]) * 50 for i in range(20)), dtype="uint8")
    at = repeats.np.arange(0, 1000, 50)
    docs = repeats.np.arange(20)
    order, later = repeats._as_bytes(blob, at, repeats.np.zeros(20, dtype="uint64"), docs)  # all hashes collide
    assert sorted(order[later].tolist()) == list(range(7, 20))
    order, later = repeats._later(repeats.np.zeros(6, dtype="uint64"), repeats.np.arange(6), repeats.np.array([1, 2, 1, 2, 3, 3], dtype="uint64"))
    assert sorted(order[later].tolist()) == [2, 3, 5]


@pytest.mark.parametrize("common", [False, True])
def test_jaccard_brute_force(spark, monkeypatch, common):
    rows = texts(5, 90)
    if common:
        for name, value in (("HOT", 3), ("MANY", 5), ("STRETCH_KEYS", 300), ("CHUNK_BYTES", 4000)):
            monkeypatch.setattr(shared, name, value)
        rows = [(d, "one two three four five six seven eight " + t) for d, t in rows]
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), label[d]) for d in sets}


def test_tiling_finds_reordered_passages(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(7, f"{a} {b}")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {b} y {a} z"), (2, f"x {a[:30]}"), (3, None)], "doc_id long, text string")
    found = decontam.with_leaks(docs, bench).where(F.size("leaks") > 0).collect()
    assert [(r.doc_id, r.leaks[0].coverage, r.leaks[0].n_tiles) for r in found] == [(1, 1.0, 2)]


def _tiles(a, b, width):
    """Greedy string tiling by looking at all places of both sides again and again."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for j in range(len(a)):
            for i in range(len(b)):
                n = 0
                while j + n < len(a) and i + n < len(b) and a[j + n] == b[i + n] and free_a[j + n] and free_b[i + n]:
                    n += 1
                if n >= width and (best is None or n > best[2]):
                    best = (j, i, n)
        if best is None:
            return tiles
        tiles.append(best)
        for k in range(best[2]):
            free_a[best[0] + k] = free_b[best[1] + k] = False


def test_decontaminate_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    say = lambda v, n: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 4, 50]), rng.randrange(0, 24))) for k in range(40)] + [(99, None), (7, "Two words"), (8, "two WORDS")]
    docs = [(d, say(rng.choice([1, 2, 4, 50]), rng.randrange(0, 60))) for d in range(60)] + [(100, "two words"), (101, "Two words more"), (102, None)]
    docs += [(200 + k, f"{say(50, 9)} {t[len(t) // 2:]} {say(50, 9)} {t[:len(t) // 2]}") for k, t in items[:20]]
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(decontam, "CHUNK_DOCS", 7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.with_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    words = lambda t: (t or "").lower().split()
    some = 0
    for r in found:
        want = []
        for k, t in items:
            a, b = words(t), words(r.text)
            if 0 < len(a) < decontam.SEED:
                want += [(k, 1.0, 1)] if a == b else []
            elif a:
                tiles = _tiles(a, b, decontam.SEED)
                share = sum(x[2] for x in tiles) / len(a)
                want += [(k, share, len(tiles))] if share >= decontam.COVER else []
        assert sorted((x.item_id, x.coverage, x.n_tiles) for x in r.leaks) == sorted(want), r
        some += len(want)
    assert some > 20


def test_equal_words_tile_fast():
    began = time.perf_counter()
    assert decontam.Block([(1, "0 " * 400)]).tilings(["0 " * 20_000], 0.5) == [[(1, 1.0, 1)]]
    assert time.perf_counter() - began < 1


def _base_pii(t):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base_spans(spark):
    rng = random.Random(2)
    parts = ["a@b.co", "x_y@q-1.r.st", "a@b.c_x@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.002.3.255", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "12 4111111111111111", "+49 (30) 123.456-78", "+1", "++12345678 ", "é", " ", "\n", ".", "@", "-", "word"]
    rows = [(i, "".join(rng.choices(parts, k=12))) for i in range(300)] + [(900, "é 9" * 3000 + " 4111111111111111")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert [(s.kind, s.start, s.stop) for s in r.pii.base] == _base_pii(r.text), r.text


def test_pii_terms_follow_the_corpus(spark):
    filler = lambda i: " ".join(f"common{chr(97 + (i * k) % 26)}" for k in range(1, 9))
    rows = [(i, f"{filler(i)} report by Zorblatt at z@corp.example {filler(i + 3)}") for i in range(6)]
    rows += [(100 + i, f"report by nobody {filler(i)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("z@corp" not in t and "orblatt" not in t and "[EMAIL]" in t for d, t in clean.items() if d < 6)
    assert all("report" in t for t in clean.values())
    assert {d: t for d, t in clean.items() if d >= 100} == {d: t for d, t in rows if d >= 100}


def test_pii_terms_brute_force(spark):
    rng = random.Random(8)
    vocab = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "kappa", "omega", "it", "\u00c9tage"]
    rows = []
    for i in range(80):
        w = rng.choices(vocab, k=rng.randrange(3, 40))
        if i % 2:
            k = rng.randrange(4)
            w.insert(rng.randrange(len(w)), f"Secret{'abcd'[k]}")
            w.insert(rng.randrange(len(w)), f"p{k}@corp.example" if k % 2 else f"10.0.0.{k}")
        rows.append((i, " ".join(w)))
    rows += [(i + 1000, t) for i, t in rows[:9]] + [(5, rows[5][1])]
    held, n, n_t = {}, len(rows), defaultdict(int)
    for d, t in rows:
        for w in set(re.split(r"[^a-z\u00e9]+", t.lower())):
            n_t[w] += 1
        spans = _base_pii(t)
        if spans:
            held[d, t] = spans
    docs_of, pair_docs, contexts = defaultdict(set), defaultdict(set), defaultdict(set)
    for (d, t), spans in held.items():
        for k, a, b in spans:
            e = f"{k}:{t[a:b].lower()}"
            docs_of[e].add((d, t))
            left, right = t[max(0, a - pii.CONTEXT) : a], t[b : b + pii.CONTEXT]
            left = re.sub(r"^[A-Za-z\u00c9\u00e9]+", "", left) if a > pii.CONTEXT else left
            right = re.sub(r"[A-Za-z\u00c9\u00e9]+$", "", right) if len(right) == pii.CONTEXT else right
            terms = list(dict.fromkeys(w for w in re.split(r"[^a-z\u00e9]+", f"{left} {right}".lower()) if len(w) >= 3))
            for w in terms:
                pair_docs[e, w].add((d, t))
                contexts[e, w].add(tuple(terms))
    share = {}
    for (e, w), ds in pair_docs.items():
        ic = math.log2(n / len(docs_of[e]))
        if len(contexts[e, w]) >= pii.SUPPORT and ic > 0:
            s = math.log2(n * len(ds) / (len(docs_of[e]) * n_t[w])) / ic
            if s >= pii.GENERALISE:
                share[e, w] = s
    assert share
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = set()
        spans = held.get((r.doc_id, r.text), [])
        for e in {f"{k}:{r.text[a:b].lower()}" for k, a, b in spans}:
            for m in re.finditer(r"[A-Za-z\u00c9\u00e9]+", r.text):
                if (e, m[0].lower()) in share and not any(m.start() < b and a < m.end() for _, a, b in spans):
                    want.add((m.start(), m.end()))
        assert {(s.start, s.stop) for s in r.pii.terms} == want, r


def test_pii_terms_are_counted_before_the_join(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id long, text string")
    for terms in (F.broadcast(spark.createDataFrame([("some",)], "term string")), spark.createDataFrame([("some",)], "term string").hint("merge")):
        counted = pii.term_counts(docs, terms)
        assert [tuple(r) for r in counted.collect()] == [("some", 50)]
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("Aggregate") < plan.index("Generate")


def test_sanitise_leaves_nothing_of_overlapping_spans(spark):
    rows = [(1, "call +49 30 1234 5678 9bob@x.com now"), (2, "4111 1111 1111 1111@x.com"), (3, "+1 4111 1111 1111 1111 4111@y.org 1.2.3.4@z.net end")]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        inside = {i for _, a, b in _base_pii(t) for i in range(a, b)}
        plain = "".join(c for i, c in enumerate(t) if i not in inside)
        assert re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", got[d]) == plain, got[d]
    assert got[1] == "call [PHONE][EMAIL] now"


def _secret_rows(n=90):
    rng = random.Random(4)
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows = [(i, f"word word password={hexes(18)} then {hexes(32)} end") for i in range(n)]
    return rows + [(1000 + i, f"see mail{i}.example2.com/page{i}index and some more-words-here{i} at 0{i}71 {rng.randrange(10**15, 10**16)} end") for i in range(n)]


def _base_secrets(t):
    """The contract's patterns, one after another."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def test_secrets_base_spans_brute_force(spark):
    rng = random.Random(9)
    parts = ["password", "PassWd=", "secret", "token", "api_key", "APIKEY", ": ", "=", '"', "'", " ", "AKIA", "ABCDEF0123", "0123456789abcdef", "ff", "\u017f", "\u212a", "\n", "=ab.c", "Zz9/+"]
    rows = [(i, "".join(rng.choices(parts, k=14))) for i in range(400)] + [(900, "a1b2c3" * 9000), (901, None), (902, "")]
    for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = sorted(_base_secrets(r.text or ""), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert [(s.kind, s.start, s.stop) for s in r.findings if s.kind != "cnn"] == want, r


def test_secret_candidates():
    found = lambda t: [t[a:b] for a, b in secrets.candidates(t)]
    assert found("plain Words arestill nothing") == []
    assert found("ab12cd camelCase 123456 sixteenletterword key: hidden x='unquoted'") == ["ab12cd", "camelCase", "123456", "sixteenletterword", "hidden", "unquoted"]
    assert found("ab1 x=ab") == [] and found("") == []
    assert found("pwd=hunterxyz key=hiddenword end key:  hiddenagain auth: hunterxyz 'k' = \"letters\"") == ["hunterxyz", "hiddenword", "hiddenagain", "hunterxyz", "letters"]
    assert found("a==hunterxyz QUJDREVGR1==") == ["hunterxyz", "QUJDREVGR1"]


def test_secret_network(spark):
    """Every candidate is scored, as by hand; the report tells of rows that nothing was settled on."""
    rows = _secret_rows()
    docs = spark.createDataFrame([*rows, (5000, "left Zq8vXw2Kd0Rt5Yp9Lm3Nb7Hc right"), (5001, "nothing")], "doc_id long, text string")
    model = secrets.train(docs)
    assert model.report["recall"] >= 0.8 and model.report["precision"] >= 0.8
    for r in secrets.find_secrets(docs).collect():
        base = _base_secrets(r.text)
        want = set()
        for a, b in secrets.candidates(r.text):
            best = model.probability(secrets.codes(secrets.windows(r.text, a, b))).max()
            if best >= model.threshold and not any(s <= a and b <= e for _, s, e in base):
                want.add((a, b))
        assert {(s.start, s.stop) for s in r.findings if s.kind == "cnn"} == want, r


def test_secrets_learn_from_rare_findings(spark):
    rng = random.Random(6)
    rows = [(i, f"password={rng.getrandbits(72):018x} end, see mail{i}.example2.com/page{i}index") for i in range(60)]
    rare = spark.createDataFrame(rows, "doc_id long, text string")
    docs = rare.unionAll(spark.range(1000, 300_000).select("id", F.lit("nothing here")))
    assert secrets.train(docs) is not None
    found = secrets.labelled_findings(docs.unionAll(rare))
    assert sum(k != "" for _, k in found) == 60 and len({v for v, _ in found}) == len(found)


def test_secrets_learn_from_all_findings(spark, monkeypatch):
    """No label is cut, and blocks that learn by themselves make one good network, whatever the order of rows."""
    rng = random.Random(8)
    words = [f"see mail{i}.example{i % 7}.com/page{i}index or item{rng.randrange(10**6)}abc" for i in range(2000)]
    keys = [f"password={rng.getrandbits(72):018x} end" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(words + keys)), "doc_id long, text string")
    found = secrets.labelled_findings(docs)
    assert sum(k != "" for _, k in found) == 300 and sum(k == "" for _, k in found) == len({v for t in words for a, b in secrets.candidates(t) for v in secrets.windows(t, a, b)}) > 4000
    monkeypatch.setattr(secrets, "BLOCK_VIEWS", 900)
    monkeypatch.setattr(secrets, "ROUNDS", 2)
    first, second = secrets.train(docs), secrets.train(docs.repartition(3).orderBy(F.desc("doc_id")))
    assert first.report["recall"] >= 0.8 and first.report["precision"] >= 0.8
    assert first.report == second.report and all((first.p[k] == second.p[k]).all() for k in first.p)


def test_secrets_threshold_keeps_recall():
    rng = random.Random(7)
    x = secrets.codes(["".join(rng.choices("abcdef0123", k=88)) for _ in range(600)])
    y = (secrets.np.arange(600) < 30).astype(float)
    model = secrets.CharCNN()
    model.calibrate(x, y)
    model.set_threshold(x, y)
    assert model.recall(x[y == 1]) >= secrets.RECALL


def test_chat_tree_round_trip(spark):
    evil = "\\### a: </turn>\n \\\\ <x> #"
    rows = [("t", 1, None, "user", evil, 0.0), ("t", 2, 1, "assistant", "short", 1.0), ("t", 3, 1, "assistant", evil + "\\", 5.0),
            ("t", 4, 3, "us:er", "", 0.0), ("t", 5, 4, "assistant", "end", 0.0), ("u", 1, 9, "assistant", "orphan", 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {r.tree: r for r in chat.format_chats(messages).collect()}
    assert chat.read_back(got["t"].formatted) == [(r[3], r[4]) for r in rows if r[0] == "t" and r[1] != 2]
    learned = [chat.unescape(got["t"].formatted[s.start : s.stop]) for s in got["t"].loss]
    assert learned == [evil + "\\", "end"]
    assert chat.read_back(got["u"].formatted) == [("assistant", "orphan")]
    assert chat.format_chats(messages, per_tree=5).count() == 3
    assert chat.format_chats(messages.limit(0)).count() == 0


MESSAGES = "tree string, node long, parent long, role string, text string, score double"


def _paths(rows, per_tree):
    """Best branches of each tree by walking up from every leaf."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {}
        for r in sorted((r for r in rows if r[0] == tree and r[1] is not None), key=lambda r: (r[2] is not None, r[2] or 0, r[5] or 0.0)):
            own.setdefault(r[1], [r[2], r[5] or 0.0])
        for v in own.values():
            v[0] = v[0] if v[0] in own else None
        for v in sorted(own):
            seen, at = [], v
            while at is not None and at not in seen:
                seen.append(at)
                at = own[at][0]
            if at is not None:
                own[min(seen[seen.index(at) :])][0] = None
        inner, found = {v[0] for v in own.values()}, []
        for leaf in (v for v in own if v not in inner):
            path, at = [], leaf
            while at is not None:
                path.insert(0, at)
                at = own[at][0]
            found.append((-sum(own[v][1] for v in path), leaf, path))
        out[tree] = [p for *_, p in sorted(found)[:per_tree]]
    return out


def test_chat_branches_brute_force(spark):
    rng = random.Random(13)
    rows = []
    for t in [*map(str, range(25)), "-", None]:
        n = rng.randrange(1, 25)
        rows += [(t, v, rng.choice([None, v, 99, *range(n), *range(max(0, v - 2), v + 1)]), rng.choice(["user", "assistant", None]), rng.choice(["a", None, "</turn>"]), rng.choice([None, 0.0, 1.0, 2.0])) for v in range(n)]
    rows += [("r", 1, None, "user", "x", 0.0)] * 2 + [("r", None, 1, "user", "lost", 9.0), ("r", 2, 1, "user", "b", 0.0), ("r", 2, 1, "user", "a", 0.0)]
    for per_tree in (1, 3):
        messages = spark.createDataFrame(rows, MESSAGES)
        got = defaultdict(list)
        for r in chat.branches(messages, per_tree).orderBy("k", "branch", "pos").collect():
            got[r.k, r.branch].append(r.node)
        want = {("-" if t is None else f"={t}", i + 1): p for t, paths in _paths(rows, per_tree).items() for i, p in enumerate(paths)}
        assert got == want
    text = {r.tree: chat.read_back(r.formatted) for r in chat.format_chats(clashing(messages)).collect()}
    assert text["r"] == [("user", "x"), ("user", "a")] and len(text) == 28


def test_chat_circles_and_long_chains(spark):
    rows = [("c", 1, 2, "user", "one", 0.0), ("c", 2, 1, "user", "two", 0.0), ("c", 3, 2, "user", "three", 0.0), ("s", 4, 4, "user", "self", 0.0)]
    got = {r.tree: chat.read_back(r.formatted) for r in chat.format_chats(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == {"c": [("user", "one"), ("user", "two"), ("user", "three")], "s": [("user", "self")]}
    chain = spark.range(10_000).selectExpr("'t' AS tree", "id AS node", "id - 1 AS parent", "'user' AS role", "cast(id AS string) AS text", "0.0D AS score")
    (whole,) = chat.format_chats(chain).collect()
    assert [t for _, t in chat.read_back(whole.formatted)] == [str(i) for i in range(10_000)]


def test_linear_replies_edges(spark):
    rows = [(None, 1, "user", "n"), (1, 1, None, None), (1, 1, "a", "t"), (1, 1, "a", "t"), (1, None, "a", "first"), (2, 5, "assistant", "y" * 200_000)]
    docs = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: chat.read_back(r.formatted) for r in chat.format_chats(chat.linear_replies(docs)).collect()}
    assert got == {None: [("user", "n")], 1: [("a", "first"), ("", ""), ("a", "t"), ("a", "t")], 2: [("assistant", "y" * 200_000)]}
    assert chat.format_chats(chat.linear_replies(docs.limit(0))).count() == 0


def test_viterbi_brute_force():
    rng = langid.np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(0, 7, 4)
        scores = rng.normal(0, 4, (int(lengths.sum()), 3)).astype("float32")
        got, at = langid.viterbi(scores, lengths, 3.0), 0
        for n in lengths.tolist():
            own = scores[at : at + n].astype(float)
            worth = lambda path, own=own: sum(own[i][k] for i, k in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B905, E731
            best = max((worth(p) for p in itertools.product(range(3), repeat=n)), default=0.0)
            assert abs(worth(got[at : at + n].tolist()) - best) < 1e-6
            at += n


def test_language_letters(spark):
    docs = spark.createDataFrame([(i, "the house stands near the river", "en") for i in range(9)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    odd = ["\u00b2", "\u00bd 3 \u2460", "12 _", "x\u00b2", "\u0130stanbul near the river"]
    got = langid.label_texts(odd, model, spans=True)
    assert list(got.lang) == ["und", "und", "und", "en", "en"]
    assert got.spans[4] == [{"lang": "en", "start": 0, "stop": len(odd[4])}]


def test_language_held_out_and_mixed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    model = langid.train(docs)
    de, en = (docs.where(f"lang = '{x}' AND n_chars BETWEEN 300 AND 900").orderBy("doc_id").first().text for x in ("de", "en"))
    spans = langid.label_texts([de + " " + en, None, "123"], model, spans=True)
    assert list(spans.lang[1:]) == ["und", "und"]
    assert abs(spans.spans[0][0]["stop"] - len(de)) < 60 and {s["lang"] for s in spans.spans[0]} >= {"de", "en"}


def test_language_sample_keeps_rare_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 60)
    rows = [(i, f"plain words about nothing {i}", None) for i in range(3000)]
    rows += [(10_000 + i, f"the house stands near the river {i}", "en") for i in range(1000)]
    rows += [(20_000 + i, f"das Haus steht nahe am Fluss {i}", "de") for i in range(5)]
    rows += [(-1, "la maison est pr\u00e8s de la rivi\u00e8re", "fr")] * 200
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "fr"]
    found = langid.label_texts(["das Haus steht nahe am Fluss", "the house stands near the river", "la maison est pr\u00e8s de la rivi\u00e8re"], model)
    assert list(found.lang) == ["de", "en", "fr"]
    assert [langid.fair_share(s, 60) for s in ([5, 1000, 200], [10, 20], [70] * 100)] == [27, 50, 1]


def test_language_model_depends_on_texts_alone(spark, monkeypatch):
    """More rows than the sample takes: other ids, another order and another column leave the model as it is; languages beyond the bound aren't learned."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 30)
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    rows = [(i, f"the house number {i * 7919} near the river", "en") for i in range(300)] + [(1000 + i, f"das Haus Nummer {i * 7919} am Fluss", "de") for i in range(90)]
    rows += [(2000 + i, "an equal text", "en") for i in range(200)] + [(3000, "la maison", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = langid.train(docs)
    other = langid.train(docs.select((F.col("doc_id") * 31 + 5).alias("doc_id"), "text", "lang", F.rand(3).alias("noise")).orderBy("noise"))
    assert one.langs == other.langs == ["de", "en"] and (one.table == other.table).all()


def test_jaccard_short_texts_need_a_second_hash(spark, monkeypatch):
    """Where the keys of short texts clash, only equal texts link."""
    monkeypatch.setattr(jaccard, "MASK56", jaccard.np.uint64(0))
    rows = [(1, "alpha"), (2, "beta"), (3, "ALPHA "), (4, "alpha beta"), (5, "beta"), (6, "a b c d e"), (7, "A b c d e"), (5, "beta")]
    near = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6, 7: 6}


def test_url_intervals(spark):
    log = [("d:x.example", 10, "add", "spam"), ("d:x.example", 20, "remove", "spam"), ("d:x.example", 30, "add", "adult"), (None, 1, "add", "z")]
    entries = spark.createDataFrame(log, "key string, day long, action string, category string")
    urls = [(i, "http://u@a.X.example.:80/p?q", d) for i, d in enumerate([9, 10, 19, 20, 30, 99])] + [(7, None, 12), (8, "nonsense", 12), (9, "http://x.example", None)]
    caps = spark.createDataFrame(urls, "id long, url string, fetch_day long").withColumn("category_", F.lit(1))
    got = {r.id: (r.listed, r.category) for r in urlfilter.url_filter(caps, entries).collect()}
    assert got == {0: (False, None), 1: (True, "spam"), 2: (True, "spam"), 3: (False, None), 4: (True, "adult"), 5: (True, "adult"),
                   7: (False, None), 8: (False, None), 9: (False, None)}


def test_url_categories_of_a_key_overlap(spark):
    log = [("d:x.example", 10, "add", "spam"), ("d:x.example", 50, "add", "malware"), ("d:x.example", 60, "remove", "spam"),
           ("d:y.example", 5, "add", "adult"), ("d:y.example", 5, "add", "tracker"), ("d:y.example", 9, "remove", "adult")]
    entries = spark.createDataFrame(log, "key string, day long, action string, category string")
    urls = [(d, "http://x.example/", d) for d in (9, 10, 50, 59, 60, 99)] + [(100 + d, "http://y.example/", d) for d in (5, 9)]
    caps = spark.createDataFrame(urls, "id long, url string, fetch_day long")
    got = {r.id: (r.n_active, r.category) for r in urlfilter.url_filter(caps, entries).collect()}
    for i, url, day in urls:
        key, active = "d:" + url.split("/")[2], set()
        for k, d, action, category in log:
            if k == key and d <= day:
                (active.add if action == "add" else active.discard)(category)
        assert got[i] == (len(active), max(active, default=None)), (i, got[i], active)


def test_cascade_order_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    features = quality.lazy_features(F.col("text"))
    ways = [quality.RULES, quality.RULES[::-1]]
    kept = [{r.doc_id for r in docs.where(quality.first_failed(features, list(w)).isNull()).collect()} for w in ways]
    assert kept[0] == kept[1] == {r.doc_id for r in quality.quality_filter(docs).collect()}


def test_cascade_stops_at_the_first_rejection(spark):
    """A row that one rule rejects has no later rule looked at, in the report as in the filter; order follows rejection per cost."""
    looked = quality.Rule("looked", lambda f: F.when(f("n_bangs") >= 0, F.raise_error(F.lit("looked"))).otherwise(F.lit(False)).cast("boolean"))
    rules = (quality.RULES[0], looked)
    short = spark.createDataFrame([(i, "too few words!") for i in range(40)], "doc_id long, text string")
    lazy = quality.lazy_features(F.col("text"))
    chained = short.select(quality.first_failed(lazy, list(rules)).alias("r"))
    assert {r.r for r in chained.collect()} == {"short"}
    with pytest.raises(Exception, match="looked"):
        short.union(spark.createDataFrame([(99, "word " * 60)], "doc_id long, text string")).select(quality.first_failed(lazy, list(rules))).collect()
    rows = [(3, "12345 678 9 " * 30), (4, "a clean text of many words " * 12 + "\n- one item"), (5, "* point 1\n" * 9 + "plain line with words " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = [r for r in quality.RULES if r.name != "repeats"]
    assert {r.doc_id: r.failed_rule for r in quality.quality_report(docs, wide).collect()} == {3: "numbers", 4: None, 5: None}
    many = spark.createDataFrame([(i, f"{i} words " + "1234567 " * 60) for i in range(400)], "doc_id long, text string")
    assert quality.order_rules(many, wide)[0].name == "numbers"


def test_pipeline_small(spark):
    import corpus_pipeline
    from loam.plans.materialize import keep

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = keep(stage(spark, docs, SF), name)
        after = docs.collect()
        assert {r.doc_id for r in after} <= set(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_duplicates":
            near = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()}
            assert {r.doc_id for r in after} == set(near.values())
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r.text for i in items for r in after)
        if name == "personal_data":
            assert not any(_base_pii(r.text) for r in after)
