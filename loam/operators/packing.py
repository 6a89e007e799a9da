"""Chunks, evidence and token budgets over a table of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import chunking, detect, scoring
from loam.functions import text as T
from loam.functions.binding import let
from loam.plans.materialize import keep
from loam.schemas import lookup, risk_of, risk_rank


def idle_details(refs: DataFrame, idle: int = 3) -> DataFrame:
    """session, id, idle: details not referred to (session, id, turn) for ``idle`` turns or more."""
    now = refs.groupBy("session").agg(F.max("turn").alias("now"))
    last = refs.groupBy("session", "id").agg(F.max("turn").alias("last"))
    return last.join(now, "session").withColumn("idle", F.col("now") - F.col("last")).where(F.col("idle") >= idle).select("session", "id", "idle")


def merge_details(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row an id with the links of both sets."""
    return a.unionByName(b).groupBy("id").agg(F.flatten(F.collect_list("links")).alias("links"))


def greedy_prefix(rows: DataFrame, group: str, order: list[Column], cost: str, most: int, budget: int) -> DataFrame:
    """The first rows of each group that fit ``most`` rows and ``budget``; the first row always fits, the first overflow ends it.

    Only the first ``most`` rows of a group get to the running sums, and each task passes on no more than these.
    """
    w = Window.partitionBy(group).orderBy(*order)
    first = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    run = Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ranked = first.withColumn("used", F.sum(cost).over(run))
    over = (F.col("used") > budget) & (F.col("place") > 1)
    return ranked.withColumn("_end", F.max(over.cast("int")).over(run)).where("_end = 0").drop("_end")


def fixed_chunks(rows: DataFrame, words: int = 150) -> DataFrame:
    """id, chunk, n_words, text: runs of ``words`` words."""
    w = rows.select("id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int"))
    cut = w.select("id", F.posexplode(F.transform(starts, lambda i: F.slice("w", i * words + 1, F.lit(words)))).alias("chunk", "part"))
    return cut.select("id", "chunk", F.size("part").alias("n_words"), F.array_join("part", " ").alias("text"))


def chunks(rows: DataFrame, limit: int = chunking.LIMIT, overlap: int = chunking.OVERLAP, least: int = chunking.LEAST) -> DataFrame:
    """id, chunk, n_words, text, start, stop: texts (id, text) cut at paragraph and sentence ends; a null text has no chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [(i, c) for i, t in enumerate(part.column(1).to_pylist()) if t is not None for c in chunking.chunks_of(t, limit, overlap, least)]
                ids = part.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                of = lambda k, kind, found=found: pa.array([c[k] for _, c in found], kind)
                yield pa.RecordBatch.from_arrays([ids, of(0, pa.int32()), of(4, pa.int32()), of(1, pa.string()), of(2, pa.int32()), of(3, pa.int32())], names=["id", "chunk", "n_words", "text", "start", "stop"])

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "text").mapInArrow(cut, f"id {kind}, chunk int, n_words int, text string, start int, stop int")


def _chunk_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, id, chunk, n_words, raw of rows (query, id, chunks: chunk, n_words and its counts of the query's terms)."""
    for batch in batches:
        lists = batch.column(2)
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        each = lists.flatten()
        chunk, n_words, counts = (each.field(i) for i in range(3))
        group, words = np.repeat(np.arange(len(n)), n), n_words.to_numpy(zero_copy_only=False).astype(float)
        terms = counts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = counts.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(group)), terms)
        place = np.arange(len(tf)) - np.repeat(np.cumsum(terms) - terms, terms)
        most = np.zeros(len(n), np.int64)
        np.maximum.at(most, group, terms)
        at = (np.cumsum(most) - most)[group[row]] + place  # a group's terms, side by side
        df = np.bincount(at, tf > 0, minlength=int(most.sum()))[at]
        mean = (np.bincount(group, words, minlength=len(n)) / np.maximum(n, 1))[group]
        idf = np.log(1.0 + (n[group][row] - df + 0.5) / (df + 0.5))
        part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (words / mean)[row]))
        raw = np.bincount(row, np.where(tf > 0, part, 0.0), minlength=len(group))
        best = np.full(len(n), 0.01)
        np.maximum.at(best, group, raw)
        take = pa.array(group)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), chunk, n_words, pa.array(raw / best[group])], names=["query", "id", "chunk", "n_words", "share"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, id, chunk, n_words, c of rows (query, id, chunk, n_words, low, ts): how often each term is in the text."""
    for batch in batches:
        found = [[float(low.count(t)) for t in ts] for low, ts in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.float64()))], names=["query", "id", "chunk", "n_words", "c"])


def rank_chunks(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query, id, chunk, score: term weights within each document, 3 decimals of the best. ``queries``: query, id, text.

    A document's chunks come together with their counts of a query's terms, without texts, and are weighed in blocks of documents.
    """
    terms = queries.select("query", "id", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 1)).alias("ts")).where(F.size("ts") > 0)
    # a chunk's terms are counted beside its text, and only the counts go on
    beside = chunks.join(terms, "id").select("query", "id", "chunk", F.col("n_words").cast("int").alias("n_words"), F.lower("text").alias("low"), "ts")
    kinds = dict(beside.dtypes)
    named = ", ".join(f"{c} {kinds[c]}" for c in ("query", "id", "chunk", "n_words"))
    rows = beside.mapInArrow(_term_counts, named + ", c array<double>")
    whole = rows.groupBy("query", "id").agg(F.collect_list(F.struct("chunk", "n_words", "c")).alias("cs"))
    scores = whole.mapInArrow(_chunk_scores, named + ", share double")
    return scores.select("query", "id", "chunk", "n_words", scoring.half_up(F.round("share", 9), 3).alias("score"))


def select_chunks(ranked: DataFrame, most: int = 3, words: int = 500) -> DataFrame:
    """The best chunks of each (query, id) within the budget, in document order."""
    keyed = ranked.withColumn("_g", F.struct("query", "id"))
    chosen = greedy_prefix(keyed, "_g", [F.col("score").desc(), F.col("chunk")], "n_words", most, words)
    return chosen.drop("_g", "used", "place")


BASE_SCORE = {"constraint": 0.9, "failure": 0.85, "decision": 0.8, "open_question": 0.7, "note": 0.5}


def spans(rows: DataFrame, most: int = 12, least: int = 18, longest: int = 420) -> DataFrame:
    """id, place, label, span, base: labelled sentences of each record."""
    parts = F.filter(T.sentences(F.col("text")), lambda s: F.length(F.trim(s)) >= least)
    cut = rows.select("id", F.posexplode(F.slice(parts, 1, most)).alias("place", "raw")).withColumn("span", F.substring(F.trim("raw"), 1, longest))
    label = T.first_match(F.col("span"), detect.LABEL_RULES, "note")
    return cut.withColumn("label", label).select("id", "place", "label", "span", lookup(BASE_SCORE, F.col("label")).alias("base"))


def evidence_candidates(queries: DataFrame, span_rows: DataFrame) -> DataFrame:
    """``span_rows`` of the records (query, id, text) asked for, with the share of the query's terms and the tokens of each."""
    asked = queries.select("query", "id", T.query_terms(F.col("text")).alias("terms"))
    return span_rows.join(asked, "id").withColumn("overlap", scoring.term_overlap(F.col("span"), F.col("terms"))).drop("terms")


def evidence_score(weight: Column) -> Column:
    return scoring.half_up(F.col("base") + weight * F.col("overlap") - 0.002 * T.token_estimate(F.col("span")), 3)


def select_evidence(queries: DataFrame, span_rows: DataFrame, most: int = 6, least: float = 0.2, weight: float = 0.3) -> DataFrame:
    """query, id, place, score: spans by base score, overlap with the query's terms and length."""
    scored = evidence_candidates(queries, span_rows).withColumn("score", evidence_score(F.lit(weight))).where(F.col("score") >= least)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "place")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query", "id", "place", "label", "score", "rank")


def token_budget(task: Column, window: Column, override: Column | None = None) -> Column:
    ratio = F.coalesce(lookup(detect.TASK_BUDGETS, task), F.lit(0.1)) if override is None else F.coalesce(override, lookup(detect.TASK_BUDGETS, task))
    return F.floor(window * F.greatest(F.lit(0.01), F.least(F.lit(0.5), ratio))).cast("long")


#: Ranges that a group's open rows are cut into, by one column after another.
RANGES = 256


def _narrowed(rows: DataFrame, value: str, few: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (query, tokens, _left, _budget) whose fate the sums of ranges of ``value`` settle, with ``kept``; the open rows of one value; those of several.

    ``_left``: the tokens there are when the first of the rows is looked at. Of the ranges of a query one at most stays open:
    one of the values that cut the rows into ``RANGES``, or what lies between two of them. ``few``: every value is a range.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = rows.groupBy("query").agg(F.percentile_approx(value, shares).alias("_cuts"))
    among = F.size(F.filter("_cuts", lambda x: x < F.col(value))) + F.size(F.filter("_cuts", lambda x: x <= F.col(value)))
    placed = rows.withColumn("_range", F.col(value).cast("int")) if few else rows.join(cuts, "query").withColumn("_range", among)
    one = F.lit(True) if few else F.array_contains("_cuts", F.col(value))
    placed = placed.withColumn("_one", one).drop("_cuts")
    sums = placed.groupBy("query", "_range").agg(F.sum("tokens").alias("_sum"), F.first("_left").alias("_all"), F.first("_budget").alias("_most"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("query").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = sums.select("query", "_range", "_sum", "_most", (F.col("_all") - before).alias("_there"))
    kept = F.when(F.col("_there") <= F.col("_most"), True).when(F.col("_there") - F.col("_sum") > F.col("_most"), False)
    told = keep(placed.join(left.select("query", "_range", "_there", kept.alias("kept")), ["query", "_range"]).drop("_range"), "budget")
    open_ = told.where("kept IS NULL").drop("kept", "_left").withColumnRenamed("_there", "_left")
    return told.where("kept IS NOT NULL").drop("_there", "_one"), open_.where("_one").drop("_one"), open_.where("NOT _one").drop("_one")


def enforce_budget(details: DataFrame, budget: Column) -> DataFrame:
    """``details`` (query, id, kind, confidence, tokens) with ``kept``: lowest risk and confidence go first until the rest fits; critical ones stay.

    What goes is a beginning of the rows by risk, confidence and id. Where it ends is narrowed down by sums over ranges of
    one after another; only the rows of the last range are sorted and summed, whatever a query holds. Ids are numbers.
    """
    named = keep(details.withColumn("_risk", risk_rank(risk_of(F.col("kind")))).withColumn("_budget", budget), "details")
    total = named.groupBy("query").agg(F.sum("tokens").alias("_left"))
    open_ = named.where("_risk < 4").join(total, "query")
    done = [named.where("_risk >= 4 OR _risk IS NULL").withColumn("kept", F.lit(True))]
    last = []
    for value in ("_risk", "confidence", "id"):
        settled, open_, between = _narrowed(open_, value, few=value == "_risk")
        done.append(settled)
        last.append(between)
    w = Window.partitionBy("query").orderBy("_risk", "confidence", "id").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum("tokens").over(w), F.lit(0))
    done.append(reduce(DataFrame.unionByName, last, open_).withColumn("kept", ~(F.col("_left") - freed > F.col("_budget"))))
    columns = [*details.columns, "kept"]
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in done])


def record_index(rows: DataFrame, expanded: int = 20, compact_over: int = 100) -> DataFrame:
    """kind, n, mode, ids: each kind's records, listed in full or compacted where there are many."""
    w = Window.partitionBy("kind").orderBy(F.col("confidence").desc(), "id")
    ranked = rows.withColumn("r", F.row_number().over(w))
    agg = ranked.groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= expanded, F.struct("r", "id")))).alias("top"))
    return agg.select("kind", "n", F.when(F.col("n") > compact_over, "compacted").otherwise("expanded").alias("mode"), F.transform("top", lambda x: x["id"]).alias("ids"))
