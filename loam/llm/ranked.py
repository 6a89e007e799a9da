"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

The documents are indexed once into segments: postings (document, count) of every term, for some
``SEGMENT_BYTES`` of text each, written to the shared folder. Corpus figures are sums over segments. A query is answered in
every segment on its own. Its short lists are summed a term at a time into accumulators; sorted by document
they form one more list, with a bound of its own. That list and the long ones are walked
document-at-a-time in blocks of ``BLOCK_DOCS``: a block is skipped where the bounds of all lists in it,
together, can't reach the k-th best score so far. The accumulators' own k-th best sum is
such a score from the start, and a task takes the best hits of one segment on to the next.

The score is a whole number: the sum over the query's different terms of
``weight * ((1000000000 * tf) div (1000 * tf + 8 * m))``, weight ``floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and
``m = 10 + (90 n N) div L``; N documents have a term, L terms in all, n in this one, df with this one.

Queries are the stated set: they are read in blocks of bounded size, each sent to all tasks, and a block's
document frequencies are a row a term of it.

Defined results: null texts have no terms; documents without terms count nowhere and are never found; queries without
terms, or whose terms no document has, find nothing; repeated documents are each ranked, those of one id in no
order; documents without an id come last among equal scores; repeated queries are each answered; texts may be of
any length; empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.decontam import blocks
from loam.llm.shared import give_back, squeeze, unsqueeze
from loam.plans.materialize import keep, shared_dir, spread

#: Text and documents of a segment (a single longer document excepted), and text that is counted together.
SEGMENT_BYTES, SEGMENT_DOCS, CHUNK_BYTES = 8_000_000, 60_000, 500_000
#: A list of a query is short if at most one in so many documents of the segment is on it.
SHORT_SHARE = 16
BLOCK_DOCS = 64
#: ASCII letters in lower case and digits stay, all other ASCII divides terms.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

SEGMENT = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.binary()) for c in ("terms", "begins", "docs", "tf", "ids", "none", "size"))])
SEGMENT_DDL = "n_docs long, n_terms long, terms binary, begins binary, docs binary, tf binary, ids binary, none binary, size binary"
HITS_DDL = "q long, item_id long, doc_id long, score long"
HITS = pa.schema([("q", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


class Writer:
    """Collects the postings of one segment."""

    def __init__(self):
        self.table: defaultdict[bytes, int] = defaultdict()
        self.table.default_factory = self.table.__len__
        self.ids, self.sizes, self.keys, self.times = [], [], [], []
        self.bytes = self.pending_bytes = 0
        self.pending: list[np.ndarray] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        found = terms_of(raw)
        self.bytes += len(raw)
        if not found:
            return
        self.pending.append(np.fromiter(map(self.table.__getitem__, found), dtype=np.int64, count=len(found)))
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.pending_bytes += len(raw)
        if self.pending_bytes >= CHUNK_BYTES:
            self.count()

    def count(self) -> None:
        docs = np.repeat(np.arange(len(self.sizes) - len(self.pending), len(self.sizes)), self.sizes[len(self.sizes) - len(self.pending) :])
        keys, times = np.unique(np.concatenate(self.pending) << 32 | docs, return_counts=True) if self.pending else (docs, docs)
        self.keys.append(keys)
        self.times.append(times)
        self.pending, self.pending_bytes = [], 0

    def row(self) -> pa.RecordBatch:
        self.count()
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        begins = np.searchsorted(keys >> 32, np.arange(len(self.table) + 1))
        none = np.array([x is None for x in self.ids], dtype=np.uint8)
        ids = np.array([x or 0 for x in self.ids], dtype=np.int64)
        packed = [b"\n".join(self.table), begins.astype("<u4"), (keys & 0xFFFFFFFF).astype("<u2"), times[order].astype("<u4"), ids, none, np.array(self.sizes, dtype="<i8")]
        return pa.RecordBatch.from_pylist([dict(zip(SEGMENT.names, [len(ids), sum(self.sizes), *map(squeeze, packed)], strict=True))], schema=SEGMENT)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = Writer()
    for batch in batches:
        for a in range(0, batch.num_rows, 128):
            part = batch.slice(a, 128)
            for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own.add(doc_id, raw or b"")
                if own.bytes >= SEGMENT_BYTES or len(own.ids) >= SEGMENT_DOCS:
                    yield own.row()
                    own = Writer()
    yield own.row()
    give_back()


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The segments of all documents, in the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return keep(spread(rows).mapInArrow(_index, SEGMENT_DDL).where("n_docs > 0"), "segments")


def _frequencies(sent):
    """term (its number in the vocabulary), df (documents of the segment that hold it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for terms, begins in zip(batch.column(0), batch.column(1), strict=True):
                n = np.diff(unsqueeze(begins.as_py(), "<u4").astype(np.int64))
                at = [(vocabulary[t], i) for i, t in enumerate(unsqueeze(terms.as_py()).split(b"\n")) if t in vocabulary]
                if at:
                    number, place = np.array(at).T
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(n[place])], names=["term", "df"])

    return count


class Segment:
    """Postings of the terms that queries ask for, with whole-number impacts and their maxima by block of documents."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int], n_docs: int, n_terms: int):
        ids, none, size = unsqueeze(row["ids"], "<i8"), unsqueeze(row["none"], "u1").astype(bool), unsqueeze(row["size"], "<i8")
        self.ids, self.none, self.n = ids, none, len(ids)
        self.m = np.array([10 + 90 * s * n_docs // n_terms for s in size.tolist()], dtype=np.int64)  # numbers of any size before the division
        self.begins, self.docs, self.tf = unsqueeze(row["begins"], "<u4").astype(np.int64), unsqueeze(row["docs"], "<u2").astype(np.int64), unsqueeze(row["tf"], "<u4").astype(np.int64)
        self.at = {vocabulary[t]: i for i, t in enumerate(unsqueeze(row["terms"]).split(b"\n")) if t in vocabulary}
        self.starts = np.arange(0, self.n, BLOCK_DOCS)
        self._lists: dict[int, tuple[np.ndarray, ...]] = {}

    def length(self, term: int) -> int:
        i = self.at[term]
        return int(self.begins[i + 1] - self.begins[i])

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, impacts, where each block of documents begins on the list, highest impact in each block."""
        if term not in self._lists:
            a, b = self.begins[self.at[term]], self.begins[self.at[term] + 1]
            docs, tf = self.docs[a:b], self.tf[a:b]
            self._lists[term] = (docs, impact := 1_000_000_000 * tf // (1000 * tf + 8 * self.m[docs]), *self.blocks(docs, impact))
        return self._lists[term]

    def blocks(self, docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.append(np.searchsorted(docs, self.starts), len(docs))
        highest = np.zeros(len(self.starts), dtype=np.int64)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(full):
            highest[full] = np.maximum.reduceat(values, cuts[full])
        return cuts, highest


class Hits:
    """The k best documents of a query so far, and the score that another must reach."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.ids, self.none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        score, ids, none = np.concatenate([self.score, score]), np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.ids, self.none = score[order], ids[order], none[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def _accumulated(segment: Segment, short: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the short lists, ascending, with their sums: a term at a time."""
    if not short:
        return (np.zeros(0, dtype=np.int64),) * 2
    lists = [(segment.postings(t), w) for t, w in short]
    docs, parts = np.concatenate([x[0] for x, _ in lists]), np.concatenate([w * x[1] for x, w in lists])
    order = np.argsort(docs, kind="stable")
    docs, first = np.unique(docs[order], return_index=True)
    return docs, np.add.reduceat(parts[order], first)


def evaluate(segment: Segment, query: list[tuple[int, int]], hits: Hits) -> int:
    """Adds the segment's documents that belong to the best of a query of (term, weight); returns the blocks it looked into."""
    held = [(t, w) for t, w in query if t in segment.at and w > 0]
    if not held:
        return 0
    is_short = lambda t: SHORT_SHARE * segment.length(t) <= segment.n
    docs, sums = _accumulated(segment, [x for x in held if is_short(x[0])])
    if len(sums) >= hits.k:  # what the short lists alone give k documents
        hits.floor = max(hits.floor, int(np.partition(sums, -hits.k)[-hits.k]))
    cuts, highest = segment.blocks(docs, sums)
    walked = [(docs, sums, cuts, 1, highest), *((d, i, c, w, w * h) for (d, i, c, h), w in ((segment.postings(t), w) for t, w in held if not is_short(t)))]
    bound = sum(x[4] for x in walked)
    looked = 0
    for b in np.flatnonzero(bound >= hits.floor).tolist():
        if bound[b] < hits.floor:
            continue
        looked += 1
        base = int(segment.starts[b])
        score = np.zeros(min(BLOCK_DOCS, segment.n - base), dtype=np.int64)
        for d, i, c, w, _ in walked:
            if c[b] < c[b + 1]:
                score[d[c[b] : c[b + 1]] - base] += w * i[c[b] : c[b + 1]]
        near = np.flatnonzero(score >= hits.floor)
        if len(near):
            hits.add(score[near], segment.ids[base + near], segment.none[base + near])
    return looked


def _search(sent, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries, vocabulary, n_docs, n_terms = sent.value
        best = [Hits(k) for _ in items]
        for batch in batches:
            for a in range(batch.num_rows):
                segment = Segment(batch.slice(a, 1).to_pylist()[0], vocabulary, n_docs, n_terms)
                for query, hits in zip(queries, best, strict=True):
                    evaluate(segment, query, hits)
        sizes = [len(h.ids) for h in best]
        joined = lambda c: np.concatenate([getattr(h, c) for h in best])
        item = pa.array(items, pa.int64()).take(pa.array(np.repeat(np.arange(len(items)), sizes)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items)), sizes)), item, pa.array(joined("ids"), mask=joined("none")), pa.array(joined("score"))], schema=HITS)

    return search


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 10, segments: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of every item (item_id, text).

    ``segments``: an index from ``build_index``, to search it again.
    """
    spark = items.sparkSession
    segments = build_index(docs) if segments is None else segments
    folder, schema = f"{shared_dir(spark)}/ranked-{uuid.uuid4().hex}", "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none")
    n_docs, n_terms = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    for b, rows in enumerate(blocks(items) if n_docs else ()):
        asked = [dict.fromkeys(terms_of((text or "").encode("utf-8", "surrogatepass"))) for _, text in rows]
        vocabulary: dict[bytes, int] = {}
        for terms in asked:
            for t in terms:
                vocabulary.setdefault(t, len(vocabulary))
        counted = segments.select("terms", "begins").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "term long, df long")
        df = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row a term of the block
        queries = [[(vocabulary[t], weight(df[vocabulary[t]], n_docs)) for t in terms if vocabulary[t] in df] for terms in asked]
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], queries, vocabulary, n_docs, n_terms))
        found = segments.mapInArrow(_search(sent, k), HITS_DDL)
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/{b}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
