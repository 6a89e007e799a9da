"""A stored inverted index: built once, searched often, kept up by rewriting the buckets that a change touches.

Documents fall into blocks of about ``BLOCK_DOCS`` by a hash of their id. The index has a row for each term and block:
the postings (id, tf, len), how many they are, the highest tf and the least length, which bound what any of them can
score. Rows lie in buckets by a hash of the term, so a search opens the buckets of its own terms only. A second table,
in buckets by id, holds each document's terms, which tells an update whose postings to change. A frequent term
has many rows, none longer than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.search import B, K1, top_k
from loam.plans.bucketed import Bucketed
from loam.plans.materialize import keep, small_side

BLOCK_DOCS = 256
#: Terms (with repeats) that a bucket should hold, and most buckets; one of more terms is written as several files.
BUCKET_TERMS, MOST_BUCKETS = 1_000_000, 4096
#: Blocks of a query, highest bound first, that are scored to learn what its k-th best score is at least.
FIRST_BLOCKS = 2
#: Blocks whose changed ids are sent to all tasks, some 40 MB; beyond that stored rows are shuffled by block.
GONE_BLOCKS = 20_000
SLACK = 1e-9


ROW = "term string, block int, n int, max_tf int, min_len int, posts array<struct<id:long,tf:int,len:int>>"


def _documents(rows: DataFrame, blocks: int, id_: str, text: str) -> DataFrame:
    """id, block, len, terms (with repeats) of every document; a null text has no terms and no length."""
    docs = rows.select(F.col(id_).cast("long").alias("id"), T.search_terms(F.col(text)).alias("terms"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    return docs.select("id", block.alias("block"), F.when(F.col("terms").isNotNull(), F.size("terms")).alias("len"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def _packed(docs: DataFrame) -> DataFrame:
    """Index rows of documents: a block's documents come together, and their terms are sorted into postings there."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and held[0].column(1)[0].as_py() != part.column(1)[0].as_py():
                    yield from _block_rows(pa.Table.from_batches(held))
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield from _block_rows(pa.Table.from_batches(held))

    # terms have no blanks, and a text takes less in a shuffle than an array
    worded = docs.where("len > 0").select("id", "block", "len", F.array_join("terms", " ").alias("terms"))
    return worded.repartition("block").sortWithinPartitions("block").mapInArrow(pack, ROW)


def _block_rows(docs: pa.Table) -> list[pa.RecordBatch]:
    docs = docs.combine_chunks()
    lists = pc.split_pattern(docs["terms"].chunk(0), " ")
    coded = lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    keys, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lists) + doc, return_counts=True)
    if not len(keys):
        return []
    term, doc = np.divmod(keys, len(lists))
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    n = np.diff(np.append(first, len(term)))
    length = docs["len"].to_numpy()[doc].astype(np.int32)
    posts = pa.StructArray.from_arrays([pa.array(docs["id"].to_numpy()[doc]), pa.array(tf.astype(np.int32)), pa.array(length)], names=["id", "tf", "len"])
    columns = [
        coded.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), docs["block"][0].as_py(), dtype=np.int32)), pa.array(n.astype(np.int32)), pa.array(np.maximum.reduceat(tf, first).astype(np.int32)),
        pa.array(np.minimum.reduceat(length, first)), pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), posts),
    ]
    return [pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "max_tf", "min_len", "posts"])]


def _rows(postings: DataFrame) -> DataFrame:
    """Index rows of postings (term, block, id, tf, len)."""
    post = F.collect_list(F.struct("id", "tf", "len"))
    return postings.groupBy("term", "block").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), post.alias("posts"))


def _figures(docs: DataFrame) -> tuple[int, int, int]:
    """Documents, those with a text, their terms."""
    return tuple(docs.agg(F.count("*"), F.count("len"), F.coalesce(F.sum("len"), F.lit(0))).first())


def _spread(buckets: int, n_terms: int) -> Column:
    return F.pmod(F.col("block"), F.lit(-(-n_terms // (buckets * BUCKET_TERMS)) or 1))


class Index:
    """Postings and documents of an index folder."""

    def __init__(self, postings: Bucketed, documents: Bucketed):
        self.postings, self.documents = postings, documents

    @staticmethod
    def build(rows: DataFrame, path: str, id_: str = "id", text: str = "text", buckets: int | None = None) -> Index:
        """An index of ``rows`` with distinct ids in a new folder."""
        blocks = max(1, rows.count() // BLOCK_DOCS)
        docs = keep(_documents(rows, blocks, id_, text), "index-docs")
        n, texts, total = _figures(docs)
        buckets = buckets or min(MOST_BUCKETS, max(4, total // BUCKET_TERMS))
        forward = docs.select("id", "block", "len", F.array_distinct("terms").alias("terms"))
        postings = Bucketed.create(_packed(docs), f"{path}/postings", ["term"], buckets, _spread(buckets, total), blocks=blocks, n_docs=n, n_texts=texts, n_terms=total)
        return Index(postings, Bucketed.create(forward, f"{path}/documents", ["id"], buckets))

    @staticmethod
    def open(spark, path: str) -> Index:
        return Index(Bucketed(spark, f"{path}/postings"), Bucketed(spark, f"{path}/documents"))

    def update(self, changed: DataFrame, removed: DataFrame | None = None, batch: int | None = None, id_: str = "id", text: str = "text") -> None:
        """Puts documents (new, or in place of those of their id) in, and takes the ids of ``removed`` out."""
        more = self.postings.more
        new = keep(_documents(changed, more["blocks"], id_, text), "index-new")
        gone = new.select("id") if removed is None else new.select("id").union(removed.select(F.col(id_).cast("long"))).distinct()
        block = F.pmod(F.xxhash64("id"), F.lit(more["blocks"])).cast("int")
        # a block's ids in one row, as short as blocks are
        gone = keep(gone.groupBy(block.alias("block")).agg(F.collect_list("id").alias("gone")), "index-gone")
        marked = lambda rows: rows.join(small_side(gone, GONE_BLOCKS), "block", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
        homes = self.documents.touched(gone.select(F.explode("gone").alias("id")))
        stored = marked(self.documents.read(homes))
        is_gone = F.array_contains("gone", F.col("id"))
        old = keep(stored.where(is_gone).select("id", "block", "len", "terms"), "index-old")
        buckets = self.postings.touched(old.select(F.explode("terms").alias("term")).union(new.select(F.explode("terms"))))
        packed = keep(_packed(new), "index-packed")
        posts = F.filter("posts", lambda p: ~F.array_contains(F.col("gone"), p["id"]))
        there = marked(self.postings.read(buckets)).select("term", "block", posts.alias("posts")).where(F.size("posts") > 0)
        met = small_side(packed.select("term", "block"))
        rebuilt = _rows(there.join(met, ["term", "block"], "left_semi").select("term", "block", F.inline("posts")).unionByName(packed.select("term", "block", F.inline("posts"))))
        stay = there.join(met, ["term", "block"], "left_anti")
        stay = stay.select("term", "block", F.size("posts").alias("n"), F.array_max(F.col("posts")["tf"]).alias("max_tf"), F.array_min(F.col("posts")["len"]).alias("min_len"), "posts")
        figures = {k: more[k] - less + plus for k, less, plus in zip(("n_docs", "n_texts", "n_terms"), _figures(old), _figures(new), strict=True)}
        self.postings.replace(rebuilt, buckets, batch, _spread(self.postings.manifest["buckets"], figures["n_terms"]), stay, **figures)
        forward = new.select("id", "block", "len", F.array_distinct("terms").alias("terms"))
        self.documents.replace(forward, homes, batch, stay=stored.where(~is_gone))

    def rows(self, terms: DataFrame) -> DataFrame:
        """Index rows of the terms (a column ``term``), from their buckets only."""
        return self.postings.read(self.postings.touched(terms)).join(small_side(terms.select("term").distinct()), "term", "left_semi")

    def frequencies(self) -> DataFrame:
        """term, df, tf of all terms."""
        tf = F.aggregate("posts", F.lit(0).cast("long"), lambda a, p: a + p["tf"])
        return self.postings.read().groupBy("term").agg(F.sum("n").alias("df"), F.sum(tf).alias("tf"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, id, score, rank by BM25: the ``k`` best documents of every query (query, text), ties by id.

        Bounds of blocks are added up from what each row says of its postings. The blocks of highest bound are scored
        first; then only blocks whose bound reaches the k-th best score found there. No other posting is read.
        """
        n, mean = self.postings.more["n_docs"], self.postings.more["n_terms"] / max(self.postings.more["n_texts"], 1)
        asked = keep(queries.select("query", F.explode(F.array_distinct(T.search_terms(F.col("text")))).alias("term")).distinct(), "asked")
        rows = self.rows(asked)
        part = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
        cells = keep(rows.select("term", "block", "n", part(F.col("max_tf"), F.col("min_len")).alias("most")), "cells")
        df = cells.groupBy("term").agg(F.sum("n").alias("df"))
        weighed = keep(asked.join(df, "term").select("query", "term", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "weighed")
        bounds = cells.join(small_side(weighed), "term").groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        best_first = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
        bounds = keep(bounds.withColumn("place", F.row_number().over(best_first)), "bounds")

        def scored(chosen: DataFrame) -> DataFrame:
            terms = weighed.join(chosen, "query").select("query", "term", "block", "idf")
            posts = rows.join(terms, ["term", "block"]).select("query", "idf", F.inline("posts"))
            return posts.groupBy("query", "id").agg(F.sum(F.col("idf") * part(F.col("tf"), F.col("len"))).alias("score"))

        first = keep(top_k(scored(bounds.where(F.col("place") <= FIRST_BLOCKS).select("query", "block")), k), "first")
        floor = first.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        rest = bounds.where(F.col("place") > FIRST_BLOCKS).join(floor, "query", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
        more = scored(rest.select("query", "block"))
        return top_k(first.select("query", "id", "score").unionByName(more.select("query", "id", "score")), k)
