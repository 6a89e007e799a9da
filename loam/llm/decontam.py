"""Benchmark decontamination by greedy string tiling.

Texts are lower-case word sequences, words and windows of words are known by 64-bit rolling
(Karp-Rabin) hashes. A document meets a benchmark item if they share a seed, a window of ``SEED``
words. Of such a pair, tiling takes the words of the document that lie in shared seeds and marks the
longest match of unmarked words again and again, each word of either side once; the length of the
longest match is found by bisection, as a length that matches has all smaller ones match. No list of
pairs of places is made, so a word repeated 20,000 times costs no more than any other. An item leaks
into a document if its tiles cover ``COVER`` of its words, in whatever order the passages stand; what
leaks by hash is compared word by word.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_ITEMS`` items and
``BLOCK_CHARS`` characters, and every block is run against all documents, without a shuffle. A
task holds ``BLOCKS_AT_ONCE`` blocks; between groups of so many the rows are written to the shared folder.

Defined results: null texts have no words and never match; an item shorter than a seed leaks only
into a document that consists of it; items without words match nothing; repeated items count as one
each; ties between matches go to the earlier place in the item, then in the document; repeated
documents get the same result; empty tables give empty results; further columns pass, one named like
the added column as ``<name>_input``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.binding import aside, spare
from loam.llm.bytehash import M1, Prefix, mix, powers, runs
from loam.llm.shared import give_back
from loam.plans.materialize import keep

SEED = 5
COVER = 0.5
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 4_000_000
BLOCKS_AT_ONCE = 4
#: Documents and characters that are looked up together.
CHUNK_DOCS = 500
CHUNK_CHARS = 1_000_000
TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)
    end = np.flatnonzero(raw == 10)
    return Prefix(raw).of(np.concatenate([[0], end[:-1] + 1]), end)


class Rolling:
    """Hash of every window of a sequence of word hashes, whatever its width."""

    def __init__(self, words: np.ndarray):
        up, self.down = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mix(words) * up[: len(words)], dtype=np.uint64, out=self.sums[1:])

    def windows(self, at: np.ndarray, width: int) -> np.ndarray:
        return mix((self.sums[at + width] - self.sums[at]) * self.down[at] * M1)


def _starts(free: np.ndarray, width: int) -> np.ndarray:
    """Places from which ``width`` entries are free."""
    if len(free) < width:
        return np.zeros(0, dtype=np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[width:] == taken[:-width])


def greedy_tiles(item: np.ndarray, doc: np.ndarray, width: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, length) of two sequences of word hashes, longest first."""
    a, b = Rolling(item), Rolling(doc)
    free_a, free_b = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool)
    tiles: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows of this size on both sides, as far as the other side has them."""
        at_a, at_b = _starts(free_a, size), _starts(free_b, size)
        ha, hb = a.windows(at_a, size), b.windows(at_b, size)
        in_a, in_b = np.isin(ha, hb), np.isin(hb, ha)
        return at_a[in_a], ha[in_a], at_b[in_b], hb[in_b]

    longest = min(len(item), len(doc))
    while longest >= width:
        low, high = width - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        longest = low
        if longest < width:
            break
        at_a, ha, at_b, hb = common(longest)
        order = np.argsort(hb, kind="stable")
        hb, at_b = hb[order], at_b[order]
        for j, h in zip(at_a.tolist(), ha, strict=True):
            if not free_a[j : j + longest].all():
                continue
            for i in at_b[np.searchsorted(hb, h) : np.searchsorted(hb, h, side="right")].tolist():
                if free_b[i : i + longest].all():
                    tiles.append((j, i, longest))
                    free_a[j : j + longest] = False
                    free_b[i : i + longest] = False
                    break
        longest = min(longest, *(max((e - s for s, e in runs(free) if free[s]), default=0) for free in (free_a, free_b)))
    return tiles


class Block:
    """Benchmark items as word hashes, with the sorted hashes of all their seeds; short items by the hash of the whole."""

    def __init__(self, rows: list[tuple]):
        words = [tokens(text) for _, text in rows]
        self.rows = [r for r, w in zip(rows, words, strict=True) if w]
        words = [w for w in words if w]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.words = word_hashes([x for w in words for x in w])
        rolling = Rolling(self.words)
        at = np.arange(max(0, len(self.words) - SEED + 1))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = owner[at] == owner[np.minimum(at + SEED - 1, len(owner) - 1)] if len(at) else np.zeros(0, dtype=bool)
        seed, of = rolling.windows(at[inside], SEED), owner[at[inside]]
        order = np.argsort(seed, kind="stable")
        self.seed, self.of = seed[order], of[order].astype(np.int32)
        self.short: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(sizes < SEED).tolist():
            self.short.setdefault(tuple(words[k]), []).append(k)

    def item(self, k: int) -> np.ndarray:
        return self.words[self.begins[k] : self.begins[k + 1]]

    def tilings(self, texts: list[str | None], cover: float) -> list[list[tuple]]:
        """(item_id, coverage, n_tiles) of every item that leaks into each text."""
        found = [tokens(t) for t in texts]
        sizes = np.array([len(w) for w in found], dtype=np.int64)
        out: list[list[tuple]] = [[] for _ in texts]
        for d, w in enumerate(found):
            if 0 < len(w) < SEED:
                out[d] += [(self.rows[k][0], 1.0, 1) for k in self.short.get(tuple(w), [])]
        doc = word_hashes([x for w in found for x in w])
        if len(doc) < SEED or not len(self.seed):
            return out
        owner, begins = np.repeat(np.arange(len(texts)), sizes), np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(len(doc) - SEED + 1)
        at = at[owner[at] == owner[at + SEED - 1]]
        h = Rolling(doc).windows(at, SEED)
        hit = self.seed[np.minimum(np.searchsorted(self.seed, h), len(self.seed) - 1)] == h
        at, h = at[hit], h[hit]
        for a, b in runs(owner[at]):
            d = int(owner[at[a]])
            own, begin = found[d], int(begins[d])
            # the items of each different seed of the document; a shared place covers SEED words of an item at most
            seeds = np.unique(h[a:b])
            lo = np.searchsorted(self.seed, seeds)
            held = np.searchsorted(self.seed, seeds, side="right") - lo
            places = np.arange(int(held.sum())) + np.repeat(lo - np.cumsum(held) + held, held)
            items, times = np.unique(self.of[places], return_counts=True)
            for k in items[SEED * times >= cover * (self.begins[items + 1] - self.begins[items])].tolist():
                item = self.item(k)
                tiles = greedy_tiles(item, doc[begin : begin + len(own)]) if len(own) <= 4 * SEED else self._near(item, at[a:b] - begin, h[a:b], doc[begin : begin + len(own)])
                if sum(t[2] for t in tiles) < cover * len(item):
                    continue
                words = tokens(self.rows[k][1])
                tiles = [t for t in tiles if words[t[0] : t[0] + t[2]] == own[t[1] : t[1] + t[2]]]
                share = sum(t[2] for t in tiles) / len(item)
                if share >= cover:
                    out[d].append((self.rows[k][0], share, len(tiles)))
        return out

    def _near(self, item: np.ndarray, at: np.ndarray, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """Tiles of an item over the words of the document that lie in seeds the two share.

        Stretches between them are left out; a gap keeps matches from running across.
        """
        own = Rolling(item).windows(np.arange(len(item) - SEED + 1), SEED)
        mine = at[np.isin(h, own)]
        covered = np.zeros(len(doc) + 1, dtype=np.int64)
        np.add.at(covered, mine, 1)
        np.add.at(covered, mine + SEED, -1)
        covered = np.cumsum(covered)[:-1] > 0
        places = np.flatnonzero(covered)
        cut = np.flatnonzero(np.diff(places) > 1) + 1
        parts = np.split(places, cut)
        gap = np.zeros(1, dtype=np.int64) - 1
        where = np.concatenate([x for p in parts for x in (p, gap)])
        # a gap is a word that no text has: its hash is unlike the others of this pair
        filler = np.uint64(1)
        known = set(item.tolist()) | set(doc[places].tolist())
        while int(filler) in known:
            filler += np.uint64(1)
        squeezed = np.where(where < 0, filler, doc[np.maximum(where, 0)])
        return [(j, int(where[i]), n) for j, i, n in greedy_tiles(item, squeezed)]


def blocks(benchmark: DataFrame, text: str = "text") -> Iterator[list[tuple]]:
    """The query set in bounded blocks, read one after another."""
    rows, chars = [], 0
    for r in benchmark.select("item_id", text).orderBy("item_id", text).toLocalIterator():
        rows.append((r[0], r[1]))
        chars += len(r[1] or "")
        if len(rows) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield rows
            rows, chars = [], 0
    if rows:
        yield rows


MATCHES = "array<struct<item_id:long,coverage:double,n_tiles:int>>"


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks", cover: float = COVER) -> DataFrame:
    """``docs`` with ``out``: the items whose tiles cover at least ``cover`` of their words."""
    docs = aside(docs, out).withColumn(out, F.array().cast(MATCHES))
    for i, rows in enumerate(blocks(benchmark)):
        if i and i % BLOCKS_AT_ONCE == 0:
            docs = keep(docs, "leaks")
        sent = docs.sparkSession.sparkContext.broadcast(rows)  # bounded by BLOCK_ITEMS and BLOCK_CHARS
        docs = docs.withColumn(out, F.concat(F.col(out), F.pandas_udf(_leaks(sent, cover), MATCHES)(F.col(text))))
    return docs


def _leaks(sent, cover: float):
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Block(sent.value)
        for s in batches:
            found: list[list[tuple]] = []
            part: list[str | None] = []
            size = 0
            for t in s:
                part.append(t)
                size += len(t or "")
                if len(part) >= CHUNK_DOCS or size >= CHUNK_CHARS:
                    found += block.tilings(part, cover)
                    part, size = [], 0
            found += block.tilings(part, cover)
            yield pd.Series([[{"item_id": a, "coverage": b, "n_tiles": c} for a, b, c in own] for own in found])
        give_back()

    leaks.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return leaks


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", cover: float = COVER) -> DataFrame:
    """The documents into which no item leaks."""
    leaks = spare(docs, "_leaks")
    return with_leaks(docs, benchmark, text, leaks, cover).where(F.size(leaks) == 0).drop(leaks)
