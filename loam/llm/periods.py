"""Periodic runs in texts by an online sparse diagonal dynamic programme.

A lag q is a diagonal: it matches at word i if words i and i - q are the same. Words are taken in order; an
earlier occurrence opens or lengthens the match on its lag, and a diagonal that ends long enough emits its
run at once. A run of period q and length l is a match of l - q words, so it needs ``max(q, MIN_LENGTH - q)`` of
them.

The table is sparse in three ways, none of which loses a run. An occurrence counts as one only where as many
words agree as a run of its lag needs, to the power of two below: lags under 8 are looked up by windows of six
words, lags from w to 2w by windows of w. A diagonal is looked up where its match begins, with different words
before it; from there it is carried on. And a lag that is a multiple of an active one whose stretch begins
at the same word is that same run again, and stays shut. Windows are numbered by doubling, exactly, and
only those that occur twice in a document stay, so ordinary prose costs a few sorts of its bigrams, and one word
20,000 times one diagonal. Occurrences of a window that overlap by half form chains of one
step; within a chain all but the first have the same word before them, so only pairs with a first of a chain are looked at:
the number of openings grows with n log n at most.

Defined results: a null or blank text has no words, no runs and an empty collapsed text; texts may be of any
length; repeated rows get the same result; an empty table gives an empty table; further columns pass, one
named like an added column as ``<name>_input``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loam.functions.binding import aside, spare

#: Least words of a run.
MIN_LENGTH = 12
#: Text that is looked up together (a single longer document excepted).
CHUNK_BYTES, CHUNK_ROWS = 500_000, 2000
RUNS = "array<struct<start:long,length:long,period:long>>"

Run = tuple[int, int, int]


def _numbered(at: np.ndarray, left: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose window, of two parts ``shift`` apart, occurs twice or more; dense numbers of all places (-1: none)."""
    out = np.full(len(left), -1, dtype=np.int64)
    at = at[at + shift < len(left)]
    at = at[left[at + shift] >= 0]
    key = left[at] * len(left) + left[at + shift]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
    number = np.cumsum(new) - 1
    twice = np.bincount(number)[number] > 1 if len(key) else new
    out[at[order[twice]]] = number[twice]
    return np.sort(at[order[twice]]), out


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every number in [lo, hi) of each row."""
    n = np.maximum(hi - lo, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _pairs(at: np.ndarray, ids: np.ndarray, width: int, lags: tuple[int, int], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal windows whose lag lies in [lags) and that have different words before them."""
    order = np.argsort(ids[at], kind="stable")
    place, group = at[order], ids[at[order]]
    chained = np.zeros(len(place), dtype=bool)
    chained[1:] = (group[1:] == group[:-1]) & (2 * (place[1:] - place[:-1]) <= width)
    base = group * len(words)
    key, first = base + place, np.flatnonzero(~chained)

    def earlier(of: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = key[among]
        row, found = _ranges(np.searchsorted(keys, base[of] + np.maximum(place[of] - lags[1] + 1, 0)), np.searchsorted(keys, key[of] - lags[0], side="right"))
        return of[row], among[found]

    everything = np.arange(len(place))
    i, j = earlier(everything, first)
    more, other = earlier(first, everything)
    other_chained = chained[other]
    i, j = place[np.concatenate([i, more[other_chained]])], place[np.concatenate([j, other[other_chained]])]
    begins = (j == 0) | (words[i - 1] != words[j - 1])
    return i[begins], (i - j)[begins]


def openings(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) at which a diagonal opens, by word and lag. Word numbers are distinct between documents."""
    at, two = _numbered(np.arange(len(words)), words, 1)
    at, ids = _numbered(at, two, 2)
    narrow, six = _numbered(at, ids, 2)
    found, width = [_pairs(narrow, six, 6, (1, 8), words)], 4
    while len(at):
        at, ids = _numbered(at, ids, width)
        width *= 2
        found.append(_pairs(at, ids, width, (width, 2 * width), words))
    place, lag = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def runs_of(words: list[int], opens: list[tuple[int, int]]) -> list[Run]:
    """Runs (start, length, period) of one text, emitted where their diagonals end; then sorted by start and period."""
    found: list[Run] = []
    active: dict[int, int] = {}  # lag -> word at which its match begins
    t, k, n = 0, 0, len(words)
    while active or k < len(opens):
        if not active:
            t = opens[k][0]
        word = words[t] if t < n else None
        for q in [q for q in active if words[t - q] != word]:
            began = active.pop(q)
            if t - began >= q and t - began + q >= MIN_LENGTH:
                found.append((began - q, t - began + q, q))
        while k < len(opens) and opens[k][0] == t:
            q = opens[k][1]
            if not any(q % p == 0 and began - p == t - q for p, began in active.items()):
                active[q] = t
            k += 1
        t += 1
        if len(active) == 1:
            (q,) = active
            stop = opens[k][0] if k < len(opens) else n
            while t < stop and words[t] == words[t - q]:
                t += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _texts(raws: list[bytes]) -> tuple[list[list[Run]], list[bytes]]:
    """Runs and collapsed text of each."""
    split = [raw.split() for raw in raws]
    numbers, base = [], 0
    for own in split:
        table: defaultdict[bytes, int] = defaultdict()
        table.default_factory = table.__len__
        numbers.append(np.fromiter(map(table.__getitem__, own), dtype=np.int64, count=len(own)) + base)
        base += len(table)
    ends = np.cumsum([len(x) for x in split])
    place, lag = openings(np.concatenate(numbers)) if len(numbers) else (np.zeros(0, dtype=np.int64),) * 2
    cuts = np.searchsorted(place, ends)
    runs, collapsed = [], []
    for d, own in enumerate(split):
        a, b = cuts[d - 1] if d else 0, cuts[d]
        begin = int(ends[d]) - len(own)
        found = runs_of(numbers[d].tolist(), list(zip((place[a:b] - begin).tolist(), lag[a:b].tolist(), strict=True))) if a < b else []
        if found:
            stays = np.ones(len(own), dtype=bool)
            for start, length, period in found:
                stays[start + period : start + length] = False
            own = [own[i] for i in np.flatnonzero(stays).tolist()]
        runs.append(found)
        collapsed.append(b" ".join(own))
    return runs, collapsed


def _added(text_at: int, schema: pa.Schema | None = None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a = batch.column(text_at), 0
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            while a < batch.num_rows:
                b = min(max(int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK_BYTES, side="right")), a + 1), a + CHUNK_ROWS, batch.num_rows)
                part = batch.slice(a, b - a)
                runs, collapsed = _texts([x or b"" for x in part.column(text_at).cast(pa.binary()).to_pylist()])
                flat = np.array([r for own in runs for r in own], dtype=np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
                columns = [*part.columns, pa.ListArray.from_arrays(offsets, rows), pa.array(collapsed, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "runs", "collapsed"])
                a = b

    return scan


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length, period in words, by start and period) and ``collapsed``.

    A run is a stretch of at least ``MIN_LENGTH`` words and two periods that repeats with its smallest period and
    that no neighbouring word extends. The collapsed text keeps the first period of every run, words joined by one space.
    """
    taken = text.lower() in ("runs", "collapsed")
    source = spare(docs, "_text") if taken else text
    docs = aside(docs.withColumn(source, F.col(text)) if taken else docs, "runs", "collapsed")
    added = StructType.fromDDL(f"runs {RUNS}, collapsed string")
    out = docs.mapInArrow(_added(docs.columns.index(source)), StructType(docs.schema.fields + added.fields))
    return out.drop(source) if taken else out


def longest(runs: Column) -> Column:
    """The run with the greatest length, of those the first, of those the one with the smallest period; null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
