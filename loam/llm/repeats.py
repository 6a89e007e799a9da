"""Repeated passages: bytes covered by a 50-byte string that also starts in an earlier document.

Not the external induced sorting that the operator is named for: see README, "Suffix-array dedup", for
why and for figures. What is kept of it is the plan: sample suffixes at places that the text itself
chooses, settle those first, and derive all other positions from them.

1. Every 50-byte window has an anchor, its smallest hashed 20-byte string. Equal windows have equal
   anchors, so a document needs to be looked at only where its anchors occur in other documents too
   (``shared_keys``, one packed shuffle). Exact copies of whole texts are settled by their digest.
2. The runs of windows around a shared anchor meet by anchor, as bytes; all their windows are hashed
   there, and those with equal hashes compared as bytes. Runs around an anchor that is common in a
   stretch of documents or in the whole corpus are taken apart into windows that meet by window hash
   instead, so no anchor, however frequent, gathers its occurrences in one task. Such a window goes
   with a second, independent hash in place of its bytes: 56 and 64 bits have to agree.
   Each task first settles what its own documents decide and sends only the first holder of a run.
3. A window is marked if its smallest holder is an earlier document; marks are joined to the texts.

Defined results: null text is empty; texts under 50 bytes keep all; repeats inside one document stay;
rows of one doc_id never remove each other's bytes; rows without a doc_id are not compared and stay
whole; texts may be of any length; an empty table gives an empty result; columns beyond doc_id and
text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bytehash import MASK56, Prefix, mix, runs
from loam.llm.shared import BITS, binary, give_back, key_ranges, pack, shared_keys, squeeze, unpack, unsqueeze
from loam.plans.materialize import keep, small_side

SPAN = 50
GRAM = 20
PIECE = 500_000
PLACE = np.uint64((1 << 24) - 1)
STRETCH_BYTES = 2_000_000


class Scanned:
    """A buffer of text pieces with the anchor of every window in them."""

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        raw = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.raw, self.prefix = raw, Prefix(raw)
        sums, down = self.prefix.sums, self.prefix.down
        n = len(raw) - GRAM + 1
        self.grams = mix((sums[GRAM:] - sums[:n]) * down[:n])
        v = (self.grams & ~PLACE) | np.arange(n, dtype=np.uint64)
        low, width = v, 1
        while width * 2 <= SPAN - GRAM + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPAN - GRAM + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
        ok = sizes >= SPAN
        counts = np.where(ok, sizes - SPAN + 1, 0)
        total = int(counts.sum())
        piece = np.repeat(np.arange(len(pieces)), counts)
        self.at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + begins[piece]
        self.anchor = (low[self.at] & PLACE).astype(np.int64)
        self.piece = piece
        self.doc = np.array([p[0] for p in pieces])[piece]
        self.shift = (np.array([p[1] for p in pieces]) - begins)[piece]  # from place in the buffer to place in the text

    @cached_property
    def other(self) -> Prefix:
        return Prefix(self.raw, 1)


def scan(texts: list[bytes]) -> Iterator[Scanned]:
    """Texts in buffers of bounded size; a longer text in pieces that overlap by a window less a byte."""
    own, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < SPAN:
            continue
        for a in range(0, max(1, len(t) - SPAN + 1), PIECE):
            part = t[a : a + PIECE + SPAN - 1]
            if size + len(part) > PIECE and own:
                yield Scanned(own)
                own, size = [], 0
            own.append((i, a, part))
            size += len(part)
    if own:
        yield Scanned(own)


def anchor_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys, owner = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for s in scan(texts):
        new = np.concatenate([[True], (s.anchor[1:] != s.anchor[:-1]) | (s.doc[1:] != s.doc[:-1])])
        keys.append(s.grams[s.anchor[new]] & MASK56)
        owner.append(s.doc[new])
    k, o = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((k, o))
    k, o = k[order], o[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) if len(k) else np.zeros(0, dtype=bool)
    return k[new], o[new]


STAGE = pa.schema([("slot", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("at", pa.binary()), ("place", pa.binary()), ("docs", pa.binary()), ("bytes", pa.binary())])
STAGE_DDL = "slot long, kind int, keys binary, at binary, place binary, docs binary, bytes binary"
MARKS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("marks", pa.binary())])
RUNS, WINDOWS, MARKED = 0, 1, 2


def _later(group: np.ndarray, doc: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group, and which rows in that order have a smaller document in their group.

    Rows of a group agree in ``check``; where they don't, group and check together make the group.
    """
    order = np.lexsort((doc, group))
    g, d, c = group[order], doc[order], check[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.concatenate([first, [len(g)]]))
    if (c != np.repeat(c[first], times)).any():
        exact = np.unique(np.stack([group.astype(np.uint64), check.astype(np.uint64)], axis=1), axis=0, return_inverse=True)[1].ravel()
        return _later(exact.astype(np.uint64), doc, np.zeros(len(doc), dtype=np.uint64))
    return order, d > np.repeat(d[first], times)


def _as_bytes(blob: np.ndarray, at: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the windows of a buffer that begin at ``at``: those of equal hash are compared as bytes."""
    none = np.zeros(len(at), dtype=np.uint64)
    order, later = _later(hashes, doc, none)
    g = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    lead = np.repeat(order[first], np.diff(np.concatenate([first, [len(g)]])))[later]
    gone = order[later]
    eight = np.lib.stride_tricks.as_strided(blob, shape=(max(0, len(blob) - 7), 8), strides=(1, 1))
    for k in (*range(0, SPAN - 8, 8), SPAN - 8):
        if not np.array_equal(eight[at[gone] + k].view(np.uint64), eight[at[lead] + k].view(np.uint64)):
            windows = np.lib.stride_tricks.sliding_window_view(blob, SPAN)[at]
            exact = np.unique(windows, axis=0, return_inverse=True)[1].ravel()
            return _later(exact.astype(np.uint64), doc, none)
    return order, later


def _merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Owners, and for each the union of its intervals as a binary of (start, stop) pairs."""
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order].astype(np.int64), start[order], stop[order]
    far = owner << 40  # keeps owners apart in one running maximum
    reach = np.maximum.accumulate(stop + far)
    new = np.concatenate([[True], start[1:] + far[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    pairs = np.stack([start[first], reach[last] - far[last]], axis=1).astype("<i4")
    own, counts = np.unique(owner[first], return_counts=True)
    return own, binary(pairs.ravel(), counts * 2)


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the slices [begin, begin + size), one after another."""
    base = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(base, size) + np.repeat(begin, size)


class _Stretch:
    """Runs and windows of a stretch of documents, settled locally before they are sent."""

    def __init__(self, shift: int):
        self.shift = shift
        self.docs: list[tuple[int, int]] = []
        self.runs: list[tuple] = []
        self.windows: list[tuple] = []
        self.blobs: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, ths: np.ndarray, texts: list[bytes], shared: list[np.ndarray], rare: np.ndarray) -> None:
        base = len(self.docs)
        self.docs += list(zip(ids.tolist(), ths.tolist(), strict=True))
        for s in scan(texts):
            new = np.flatnonzero(np.concatenate([[True], (s.anchor[1:] != s.anchor[:-1]) | (s.piece[1:] != s.piece[:-1])]))
            last = np.concatenate([new[1:], [len(s.at)]]) - 1
            key, doc = s.grams[s.anchor[new]] & MASK56, s.doc[new]
            kind = np.full(len(new), -1, dtype=np.int8)
            for a, b in runs(doc):
                own, few = shared[doc[a]], int(rare[doc[a]])
                for part, code in ((own[:few], RUNS), (own[few:], WINDOWS)):
                    if len(part):
                        part = np.sort(part)
                        near = np.minimum(np.searchsorted(part, key[a:b]), len(part) - 1)
                        kind[a:b][part[near] == key[a:b]] = code
            run = kind == RUNS
            begin, end = s.at[new[run]], s.at[last[run]] + SPAN
            if len(begin):
                shift = s.shift[new[run]]
                self.runs.append((key[run], s.prefix.of(begin, end), s.other.of(begin, end), doc[run] + base, begin + shift, end - begin))
                flat = _gather(begin, end - begin)
                self.blobs.append(s.raw[flat])
                self.size += len(flat)
            win = np.repeat(kind == WINDOWS, last - new + 1)
            if win.any():
                at = s.at[win]
                self.windows.append((s.prefix.of(at, at + SPAN) & MASK56, s.other.of(at, at + SPAN), s.doc[win] + base, at + s.shift[win]))
                self.size += 24 * len(at)

    def flush(self) -> pa.RecordBatch:
        out: dict[str, list] = {name: [] for name in STAGE.names}
        docs = np.array(self.docs, dtype=np.int64).reshape(-1, 2)
        ranges = 1 << (BITS - self.shift)
        marks = []
        if self.runs:
            key, whole, check, owner, begin, size = (np.concatenate(x) for x in zip(*self.runs, strict=True))
            blob = np.concatenate(self.blobs)
            offset = np.cumsum(size) - size
            order, later = _later(key ^ mix(whole), docs[owner, 0], check)
            gone = order[later]
            marks.append((owner[gone], begin[gone], begin[gone] + size[gone]))
            stay = order[~later]
            stay = stay[np.argsort(key[stay], kind="stable")]
            part = key[stay] >> np.uint64(self.shift)
            for a, b in runs(part):
                rows = stay[a:b]
                used, at = np.unique(owner[rows], return_inverse=True)
                text = blob[_gather(offset[rows], size[rows])].tobytes()
                place = squeeze(np.concatenate([begin[rows], size[rows]]).astype("<i4"))
                for name, v in zip(STAGE.names, (int(part[a]), RUNS, squeeze(pack(key[rows])), squeeze(at.astype("<u4")), place, squeeze(docs[used].ravel()), squeeze(text)), strict=True):
                    out[name].append(v)
        if self.windows:
            key, check, owner, begin = (np.concatenate(x) for x in zip(*self.windows, strict=True))
            order, later = _later(key, docs[owner, 0], check)
            gone = order[later]
            marks.append((owner[gone], begin[gone], begin[gone] + SPAN))
            stay = order[~later]
            stay = stay[np.argsort(key[stay], kind="stable")]
            part = key[stay] >> np.uint64(self.shift)
            for a, b in runs(part):
                rows = stay[a:b]
                used, at = np.unique(owner[rows], return_inverse=True)
                row = (int(part[a]) + ranges, WINDOWS, squeeze(pack(key[rows])), squeeze(at.astype("<u4")), squeeze(begin[rows].astype("<i4")), squeeze(docs[used].ravel()), check[rows].astype("<u8").tobytes())
                for name, v in zip(STAGE.names, row, strict=True):
                    out[name].append(v)
        sent = pa.RecordBatch.from_pydict(out, schema=STAGE)
        owner, begin, stop = (np.concatenate(x) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, dtype=np.int64),) * 3
        if not len(owner):
            return sent
        own, blobs = _merged(owner, begin, stop)
        none = pa.nulls(len(own), pa.binary())
        names = binary(docs[own].ravel(), np.full(len(own), 2))
        settled = [pa.array(docs[own, 0] % ranges), pa.array(np.full(len(own), MARKED, dtype=np.int32)), none, none, blobs, names, none]
        return pa.Table.from_batches([sent, pa.RecordBatch.from_arrays(settled, schema=STAGE)]).combine_chunks().to_batches()[0]


def _emit(shift: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Stretch(shift)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                shared = part.column("keys")
                own = [shared[i].values.to_numpy(zero_copy_only=False).astype(np.uint64) if shared[i].is_valid else np.zeros(0, dtype=np.uint64) for i in range(part.num_rows)]
                numbers = [part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th", "n_rare")]
                for i, gone in enumerate(part.column("copies").to_pylist()):
                    if gone and numbers[1][i] in gone:  # settled as a whole
                        texts[i] = b""
                held.add(numbers[0], numbers[1], texts, own, numbers[2])
                if held.size >= STRETCH_BYTES:
                    yield held.flush()
                    held = _Stretch(shift)
        if held.docs:
            yield held.flush()
        held = None
        give_back()

    return emit


def _meet(group: pa.Table) -> pa.Table:
    """One slot: marks pass; equal windows of different documents meet, the later ones are marked."""
    settled = group.filter(pc.equal(group["kind"], MARKED)).select(["docs", "place"]).combine_chunks()
    named = np.frombuffer(b"".join(settled["docs"].to_pylist()), dtype=np.int64).reshape(-1, 2)
    out = [pa.Table.from_arrays([pa.array(named[:, 0]), pa.array(named[:, 1]), settled["place"]], schema=MARKS)]
    docs, blocks, windows, count = [], [], [], 0
    sent = group.filter(pc.not_equal(group["kind"], MARKED))
    for kind, keys, at, place, table, text in zip(*(sent.column(c).to_pylist() for c in ("kind", "keys", "at", "place", "docs", "bytes")), strict=True):
        own = unsqueeze(table, "<i8").reshape(-1, 2)
        docs.append(own)
        owner = unsqueeze(at, "<u4").astype(np.int64) + count
        count += len(own)
        numbers = unsqueeze(place, "<i4").astype(np.int64)
        if kind == RUNS:
            blocks.append((unpack(unsqueeze(keys)), owner, numbers[: len(owner)], numbers[len(owner) :], np.frombuffer(unsqueeze(text), dtype=np.uint8)))
        else:
            windows.append((unpack(unsqueeze(keys)), np.frombuffer(text, dtype="<u8"), owner, numbers))
    marks = []
    docs = np.concatenate(docs) if docs else np.zeros((0, 2), dtype=np.int64)
    if windows:
        key, check, owner, begin = (np.concatenate(x) for x in zip(*windows, strict=True))
        order, later = _later(key, docs[owner, 0], check)
        gone = order[later]
        marks.append((owner[gone], begin[gone], begin[gone] + SPAN))
    if blocks:
        key, owner, begin, size, blob = (np.concatenate(x) for x in zip(*blocks, strict=True))
        offset = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        filled = np.concatenate([[0], np.cumsum(size[order])])
        a = 0
        while a < len(edges) - 1:  # whole anchors, a few MB at a time
            b = max(a + 1, int(np.searchsorted(filled[edges], filled[edges[a]] + 2_000_000)) - 1)
            b = min(b, len(edges) - 1)
            rows = order[edges[a] : edges[b]]
            own = size[rows]
            base = np.cumsum(own) - own
            part = blob[_gather(offset[rows], own)]
            prefix = Prefix(part)
            count = own - SPAN + 1
            row = np.repeat(np.arange(len(rows)), count)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at = base[row] + step
            got, later = _as_bytes(part, at, prefix.of(at, at + SPAN), docs[owner[rows[row]], 0])
            gone = got[later]
            start = begin[rows[row[gone]]] + step[gone]
            marks.append((owner[rows[row[gone]]], start, start + SPAN))
            a = b
    owner, begin, stop = (np.concatenate(x) for x in zip(*marks, strict=True)) if marks else (np.zeros(0, dtype=np.int64),) * 3
    if len(owner):
        own, blobs = _merged(owner, begin, stop)
        out.append(pa.Table.from_arrays([pa.array(docs[own, 0]), pa.array(docs[own, 1]), blobs], schema=MARKS))
    give_back()
    return pa.concat_tables(out).combine_chunks()


def _cut(text: pd.Series, th: pd.Series, marks: pd.Series) -> pd.DataFrame:
    rows = []
    for t, own, entries in zip(text, th, marks, strict=True):
        raw = (t or "").encode()
        mine = [e["marks"] for e in (entries if entries is not None else ()) if e["th"] == own]
        spans = []
        if any(m is None for m in mine) and len(raw) >= SPAN:  # a copy of an earlier text
            spans = [(0, len(raw))]
        else:
            for s, e in sorted(tuple(x) for m in mine if m is not None for x in np.frombuffer(m, dtype="<i4").reshape(-1, 2).tolist()):
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
                else:
                    spans.append((s, e))
        kept, at, digest = 0, 0, hashlib.sha256()
        for s, e in [*spans, (len(raw), len(raw))]:
            digest.update(raw[at:s])
            kept += s - at
            at = e
        rows.append((len(raw), len(raw) - kept, [{"start": s, "stop": e} for s, e in spans], digest.hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "removed", "kept_sha256"])


REPORT = "struct<n_bytes:long,n_removed:long,removed:array<struct<start:long,stop:long>>,kept_sha256:string>"


def repeated_passages(docs: DataFrame, out: str = "repeats") -> DataFrame:
    """``docs`` (doc_id, text) with ``out``: struct of n_bytes, n_removed, removed (byte spans), kept_sha256."""
    docs = docs.select("doc_id", "text")
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.where("doc_id IS NOT NULL").withColumn("th", th)
    digests = keep(named.select("doc_id", "th", F.sha2("text", 256).alias("sha")).where("sha IS NOT NULL"), "repeat-digests")
    firsts = digests.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = small_side(keep(firsts, "repeat-firsts"))  # kept, so that the join may split a digest with many copies
    copies = keep(digests.join(firsts, "sha").where("doc_id > first").select("doc_id", "th").distinct(), "repeat-copies")
    shift = key_ranges(docs)
    shared = shared_keys(docs, anchor_keys, shift).where(F.size("keys") > 0).select("doc_id", "n_rare", "keys")
    shared = keep(shared, "repeat-anchors")
    whole = copies.groupBy("doc_id").agg(F.collect_set("th").alias("copies"))
    shared = shared.join(whole.hint("merge"), "doc_id", "left")
    # both joins read one exchange of the texts
    spread = named.repartition("doc_id")
    looked = spread.join(shared.hint("merge"), "doc_id")
    packed = looked.select("doc_id", "th", "text", "n_rare", "keys", "copies").mapInArrow(_emit(shift), STAGE_DDL)
    marks = packed.groupBy("slot").applyInArrow(_meet, "doc_id long, th long, marks binary")
    marks = marks.unionAll(copies.select("doc_id", "th", F.lit(None).cast("binary")))
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("th", "marks")).alias("marks"))
    joined = spread.join(marks.hint("merge"), "doc_id", "left").select("doc_id", "th", "text", "marks")
    nameless = docs.where("doc_id IS NULL").select("doc_id", th.alias("th"), "text", F.lit(None).cast("array<struct<th:bigint,marks:binary>>").alias("marks"))
    cut = F.pandas_udf(_cut, REPORT)
    return joined.unionAll(nameless).select("doc_id", "text", cut("text", "th", "marks").alias(out))
