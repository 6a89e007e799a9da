"""Exact top-k search by multi-resolution segment statistics.

Every vector is summarised at several resolutions: cut into 4, 8, 16, ... segments, each known by its
mean and its standard deviation. Of two vectors a, b the squared distance over a segment of length l is
at least ``l * ((mean_a - mean_b)**2 + (dev_a - dev_b)**2)``, so the sum over segments bounds their
distance from below; with the lengths of both known, the same sum bounds their inner product from
above (``l * (mean_a * mean_b + dev_a * dev_b)``). Pairs pass from the coarsest resolution to the finest,
and whoever can't reach the query's k-th best score so far is dropped; the exact score is computed for
the survivors only. Bounds are widened by far more than rounding can take, and scores are whole numbers.

The rows are never shuffled: queries are the stated set, read in blocks of bounded size, and a block is sent
to all tasks. A first round searches a slice of ``FIRST_ROWS`` rows (by digest of the id), each later round
``GROWTH`` times as many, until all rows have been searched once. Every round starts with the
k-th best scores of the rounds before, so a task passes on few hits that don't last, however large the table.

Defined results: vectors that are null, or hold a null or a component that isn't finite, take no part; a query
has candidates of its own length only; rows with the query's id are its own and no candidates; rows without
an id ask nothing, and are found after others of the same score; repeated query rows are each answered;
scores outside 64 bits become the nearest 64-bit number; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.plans.materialize import keep, shared_dir, spread

#: Numbers a query block holds at most, and queries in one.
BLOCK_NUMBERS, BLOCK_QUERIES = 4_000_000, 50_000
#: Rows of the first round, and how many times the rows seen so far each later round sees.
FIRST_ROWS, GROWTH = 4096, 16
SLICES = 1 << 20
#: Queries and rows that are compared at once; a pair list beyond this share of them is computed as a whole matrix.
#: The first tile is small, so that scores to be reached are known early.
TILE, FIRST_TILE, DENSE = 1024, 32, 8
#: Segments of the coarsest resolution.
COARSEST = 4
#: Bounds are widened by this share of the product of both lengths.
SLACK = 1e-9
EXACT = float(1 << 53)

HITS = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Resolutions:
    """Whole-number vectors of one length with their segment statistics, coarse to fine."""

    def __init__(self, m: np.ndarray):
        self.m, n = m, m.shape[1]
        self.largest = np.abs(m).max(initial=0.0)
        self.length = np.sqrt(np.einsum("ij,ij->i", m, m))
        self.levels, parts = [], COARSEST
        while 2 * parts <= n:
            at = np.arange(parts) * n // parts
            size = np.diff(np.append(at, n))
            mean = np.add.reduceat(m, at, axis=1) / size
            off = m - np.repeat(mean, size, axis=1)
            self.levels.append(np.concatenate([mean * np.sqrt(size), np.sqrt(np.add.reduceat(off * off, at, axis=1))], axis=1))
            parts *= 2

    def take(self, at: slice) -> Resolutions:
        out = object.__new__(Resolutions)
        out.m, out.largest, out.length, out.levels = self.m[at], self.largest, self.length[at], [x[at] for x in self.levels]
        return out


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (a[i], b[j])."""
    if DENSE * len(i) >= len(a) * len(b):
        return (a @ b.T)[i, j]
    return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + TILE]], b[j[k : k + TILE]]) for k in range(0, len(i), TILE)]) if len(i) else np.zeros(0)


def _scores(a: Resolutions, b: Resolutions, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit numbers: in doubles where they can't round, else in whole numbers of any size."""
    if a.largest * b.largest * max(a.m.shape[1], 1) < EXACT:
        return _dots(a.m, b.m, i, j).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
    u, v = whole(a.m), whole(b.m)
    return np.array([min(max(sum(x * y for x, y in zip(u[p], v[q], strict=True)), low), high) for p, q in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)


def survivors(a: Resolutions, b: Resolutions, floor: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are open and whose bound at every resolution reaches ``floor`` of the query."""
    i, j = np.nonzero(open_)
    with np.errstate(invalid="ignore", over="ignore"):
        for x, y in zip(a.levels, b.levels, strict=True):
            bound = _dots(x, y, i, j)
            near = ~(bound + SLACK * a.length[i] * b.length[j] < floor[i])  # what can't be told stays
            i, j = i[near], j[near]
    return i, j


class Best:
    """The k best hits of every query of a block, and the score a further hit must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.size = k, floor.copy(), 0
        self.kept = [(*(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros(0, dtype=bool))]

    def add(self, *hits: np.ndarray) -> None:
        """Hits as (query, score, id, whether the id is null); they are sorted in when they outnumber those kept."""
        self.kept.append(hits)
        self.size += len(hits[0])
        if self.size > max(TILE, len(self.kept[0][0])):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        q, score, ids, none = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((ids, none, ~score, q))  # ~x falls as x rises, without overflow
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        stay, last = order[rank < self.k], q[rank == self.k - 1]
        kth = score[order[rank == self.k - 1]].astype(float)
        self.floor[last] = np.maximum(self.floor[last], kth)
        self.kept, self.size = [(q[rank < self.k], score[stay], ids[stay], none[stay])], 0
        return self.kept[0]


def _matrix(lists: pa.Array, at: np.ndarray, n: int, scale: float) -> np.ndarray:
    return np.floor(scale * lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(at), n)


def _scan(sent, k: int, scale: float):
    """Rows (vec_id, vec) against a block of queries: the k best of this task for each query, where they reach its floor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, vectors, floor = sent.value
        asked = {n: (places[n], Resolutions(np.floor(scale * vectors[n]))) for n in vectors}
        best, size = Best(floor, k), FIRST_TILE
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, size)
                a, size = a + size, min(TILE, 2 * size)
                lists, key = part.column(1), part.column(0)
                none = key.is_null().to_numpy(zero_copy_only=False)
                key = key.fill_null(0).to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                for n, (own, block) in asked.items():
                    at = np.flatnonzero(sizes == n)
                    rows = Resolutions(_matrix(lists, at, n, scale))
                    for b in range(0, len(own) if len(at) else 0, TILE):
                        q, block_part = own[b : b + TILE], block.take(slice(b, b + TILE))
                        i, j = survivors(block_part, rows, best.floor[q], (ids[q][:, None] != key[at][None, :]) | none[at][None, :])
                        score = _scores(block_part, rows, i, j)
                        near = score >= best.floor[q[i]] if len(i) else np.zeros(0, dtype=bool)
                        best.add(q[i[near]], score[near], key[at][j[near]], none[at][j[near]])
        q, score, found, none = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q]), pa.array(found, mask=none), pa.array(score)], schema=HITS)

    return scan


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, dict, dict]]:
    """The query set in bounded blocks: ids, and by vector length places and vectors."""

    def block(rows: list) -> tuple[np.ndarray, dict, dict]:
        by: dict[int, list[int]] = {}
        for p, r in enumerate(rows):
            by.setdefault(len(r[1]), []).append(p)
        vectors = {n: np.array([rows[p][1] for p in own], dtype=float).reshape(len(own), n) for n, own in by.items()}
        return np.array([r[0] for r in rows], dtype=np.int64), {n: np.array(own) for n, own in by.items()}, vectors

    rows, numbers = [], 0
    for r in queries.toLocalIterator():
        rows.append(r)
        numbers += len(r[1])
        if len(rows) >= BLOCK_QUERIES or numbers >= BLOCK_NUMBERS:
            yield block(rows)
            rows, numbers = [], 0
    if rows:
        yield block(rows)


def usable(vec: Column, scale: float) -> Column:
    """Is there a vector, with all its scaled components finite?"""
    finite = lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False))
    return F.coalesce(F.forall(vec, finite), F.lit(False))


def top_k(queries: DataFrame, rows: DataFrame, k: int, scale: float = 256.0, query_id: str = "vec_id", vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the highest inner products of each query, ties to the smaller id.

    Components become whole numbers, ``floor(scale * x)``, before the product is taken.
    """
    spark = rows.sparkSession
    shaped = lambda df, key: df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(usable(F.col("vec"), scale))
    have = spread(shaped(rows, vec_id))
    n = have.count()
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    folder = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none")
    place = F.pmod(F.xxhash64("id"), F.lit(SLICES))
    for b, (ids, places, vectors) in enumerate(_blocks(shaped(queries, query_id).where("id IS NOT NULL"))):
        best, floor, seen = None, np.full(len(ids), -np.inf), 0
        while seen < SLICES:
            upto = SLICES if n <= 2 * FIRST_ROWS else min(SLICES, max(GROWTH * seen, FIRST_ROWS * SLICES // n, 1))
            sent = spark.sparkContext.broadcast((ids, places, vectors, floor))  # bounded by BLOCK_NUMBERS and BLOCK_QUERIES
            hits = have.where((place >= seen) & (place < upto)).mapInArrow(_scan(sent, k, scale), "q long, query_id long, vec_id long, score long")
            both = hits if best is None else best.drop("rank").unionByName(hits)
            ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            seen = upto
            if seen < SLICES:
                best = keep(ranked, "topk-round")
                for r in best.where(F.col("rank") == k).select("q", "score").toLocalIterator():  # a row a query of the block
                    floor[r["q"]] = r["score"]
            else:
                ranked.select("query_id", "rank", "vec_id", "score").write.parquet(f"{folder}/{b}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
