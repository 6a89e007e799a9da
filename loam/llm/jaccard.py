"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document is the set of its 5-word shingles. Documents link when 100 |A n B| >= 80 |A u B|. Shingles
are ordered rare first over the whole corpus; linked documents share one of their first
n - ceil(0.8 n) + 1 shingles. A shingle no other document holds cannot be shared, so documents whose
prefix is made of those alone are done without a join.

Equal sets are one class, represented by the smallest id. Representatives that share a prefix shingle
are candidates, cut by length and by position. In a group of g documents around one shingle, first
g - 1 pairs with the group's smallest document are verified; only pairs that are still in different
components follow, each once. That finds the components of the full link graph without writing the
g (g - 1) / 2 links inside a large group of near copies.

Defined results: with fewer than five words the whole sequence is one shingle; null or blank texts
have an empty set and link with nothing; rows of one doc_id are one document (the union of their
sets) and stay or go together; rows without a doc_id are left out here and stay in
``drop_near_duplicates``; an empty table gives an empty result; columns beyond doc_id and text are
ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.bytehash import MASK56, Prefix, M1, mix
from loam.llm.shared import give_back, shared_keys
from loam.plans.components import components
from loam.plans.materialize import keep, small_side

WORDS = 5
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of each text, and the text's index for each."""
    raw = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    blank = BLANK[raw]
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    ends_of_docs = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends_of_docs, begin, side="right")
    words = Prefix(raw).of(begin, end)
    keys, owner = [], []
    n = len(words) - WORDS + 1
    if n > 0:
        inside = doc[:n] == doc[WORDS - 1 :]
        h = np.zeros(n, dtype=np.uint64)
        for k in range(WORDS):
            h = mix(h * M1 + words[k : k + n])
        keys.append(h[inside])
        owner.append(doc[:n][inside])
    counts = np.bincount(doc, minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        h = counts[short].astype(np.uint64)
        for k in range(WORDS - 1):
            live = counts[short] > k
            h[live] = mix(h[live] * M1 + words[starts[short[live]] + k])
        keys.append(h)
        owner.append(short)
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    k, o = np.concatenate(keys) & MASK56, np.concatenate(owner)
    order = np.lexsort((k, o))
    k, o = k[order], o[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    return k[new], o[new]


def single_shingle(text: bytes) -> int:
    """A second hash of the shingle of a text that has one: its first words, up to five."""
    words = text.translate(LOWER.tobytes()).split(None, WORDS)[:WORDS]
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _need(n: Column) -> Column:
    """ceil(0.8 n)"""
    return F.floor((4 * n + 4) / 5).cast("long")


def _fingerprint(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: hashlib.blake2b(np.sort(np.asarray(k, dtype=np.int64)).tobytes(), digest_size=16).digest())


def _linked(na: pd.Series, nb: pd.Series, ka: pd.Series, kb: pd.Series) -> pd.Series:
    out = []
    for x, y, a, b in zip(na, nb, ka, kb, strict=True):
        if x == y == 1:  # equal sets are one class; two classes of one key each differ by their second hash
            out.append(False)
            continue
        a, b = np.sort(a), np.sort(b)
        # suffix filter: what the halves around a's middle key can share at most
        cut = len(a) // 2
        if len(a):
            at = np.searchsorted(b, a[cut])
            most = min(cut, at) + min(len(a) - cut, len(b) - at)
            if 9 * most < 4 * (x + y):
                out.append(False)
                continue
        shared = len(np.intersect1d(a, b, assume_unique=True))
        out.append(bool(100 * shared >= 80 * (x + y - shared)))
    give_back()
    return pd.Series(out, dtype=bool)


def _verified(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, linked for every pair, compared once on the shared keys of both."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"k_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    check = F.pandas_udf(_linked, "boolean")
    return both.select("a", "b", check("n_a", "n_b", "k_a", "k_b").alias("linked"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document with an id."""
    sets = keep(
        shared_keys(docs, shingle_keys, checker=single_shingle).select(
            "doc_id", "n", "second", F.size("keys").cast("long").alias("n_shared"), F.when(F.size("keys") >= F.greatest(_need(F.col("n")), F.lit(1)), F.col("keys")).alias("keys")
        ),
        "jaccard-sets",
    )
    whole = sets.where("keys IS NOT NULL AND n_shared = n").select("doc_id", F.concat(F.hex(F.pandas_udf(_fingerprint, "binary")("keys")), F.when(F.col("n") == 1, F.hex("second")).otherwise("")).alias("fp"))
    # equal sets share all their keys; the others of a class are named by a join, so that none is gathered
    whole = keep(whole, "jaccard-whole")
    firsts = whole.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").select("fp", "rep")
    firsts = small_side(keep(firsts, "jaccard-firsts"))
    copies = keep(whole.join(firsts, "fp").where("doc_id <> rep").select("rep", "doc_id"), "jaccard-copies")
    reps = sets.where("keys IS NOT NULL").join(small_side(copies), "doc_id", "left_anti").select("doc_id", "n", "n_shared", "keys")
    reps = keep(reps, "jaccard-reps")

    first = F.col("n") - _need(F.col("n")) + 1 - (F.col("n") - F.col("n_shared"))
    prefix = reps.where(first > 0).select("doc_id", "n", (F.col("n") - F.col("n_shared")).alias("u"), F.posexplode(F.slice("keys", 1, first.cast("int"))).alias("i", "key"))
    prefix = prefix.select("key", "doc_id", "n", (F.col("i") + F.col("u")).alias("at"))

    def possible(n: str, m: str, i: str, j: str) -> Column:
        """Length and positional filters: what two sets of n and m can share if their first common shingle has places i and j.

        A linked pair's first common shingle passes, so rows of a join on shingles may be cut by it at once.
        """
        n, m = F.col(n), F.col(m)
        return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - F.col(i), m - F.col(j)) >= 4 * (n + m))

    def candidates(joined: DataFrame) -> DataFrame:
        """a < b of joined pairs (x, y), each once, by the place of their first common shingle."""
        sides = [F.struct(F.col(f"{s}.doc_id").alias("id"), F.col(f"{s}.n").alias("n"), F.col(f"{s}.at").alias("at")) for s in "xy"]
        pairs = joined.select(F.least(*sides).alias("a"), F.greatest(*sides).alias("b"))
        firsts = pairs.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(
            F.first("a.n").alias("n"), F.first("b.n").alias("m"), F.min(F.struct(F.col("a.at").alias("i"), F.col("b.at").alias("j"))).alias("p")
        )
        return firsts.where(possible("n", "m", "p.i", "p.j")).select("a", "b")

    # the hub of a shingle is the document that has it earliest, which the positional filter lets most others meet
    hubs = prefix.groupBy("key").agg(F.min(F.struct("at", "doc_id", "n")).alias("h"), F.count("*").alias("m")).where("m > 1").select("key", "h.*")
    star = prefix.alias("x").join(hubs.alias("y").hint("merge"), F.col("x.key") == F.col("y.key"))
    star = star.where((F.col("x.doc_id") != F.col("y.doc_id")) & possible("x.n", "y.n", "x.at", "y.at"))
    tried = keep(_verified(candidates(star), reps), "jaccard-star")
    label = components(tried.where("linked").select("a", "b"))

    named = prefix.join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = keep(named, "jaccard-prefix")
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    open_rows = keep(named.join(mixed, "key", "left_semi"), "jaccard-open")
    cross = open_rows.alias("x").join(open_rows.alias("y").hint("merge"), F.col("x.key") == F.col("y.key"))
    apart = (F.col("x.doc_id") > F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
    cross = cross.where(apart & possible("x.n", "y.n", "x.at", "y.at"))
    cross = candidates(cross).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    rest = keep(_verified(cross, reps), "jaccard-cross")
    # what the second round links are components of the first
    by = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    met = rest.where("linked").join(by("a"), "a", "left").join(by("b"), "b", "left")
    joined = components(met.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")))
    out = sets.select("doc_id", "n").join(small_side(copies), "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = out.join(small_side(label), "node", "left").withColumn("node", F.coalesce("component", "node")).drop("component")
    out = out.join(small_side(joined), "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose group has a smaller id; rows without an id stay."""
    found = keep(near_duplicates(docs).where("doc_id <> component_id").select("doc_id"), "jaccard-losers")
    return docs.join(small_side(found), "doc_id", "left_anti")
