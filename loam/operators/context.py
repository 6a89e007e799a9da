"""Recall and context packing: whole pipelines over a table of queries."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import detect, scoring
from loam.functions import text as T
from loam.operators import packing, search
from loam.plans.materialize import keep, small_side
from loam.schemas import risk_of, risk_rank


def candidates(asked: DataFrame, records: DataFrame, n: int, mode: str) -> DataFrame:
    """query, id, score, rank: the first stage by words (``fts``), hashed features of whole texts (``vector``) or both fused (``hybrid``).

    ``asked``: query, text (with synonyms) for the words, query_text for the features.
    """
    if mode not in ("fts", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    deep = n if mode == "fts" else max(50, 2 * n)
    lexical = None if mode == "vector" else search.bm25(asked.select("query", "text"), records, deep)
    if mode == "fts":
        return lexical
    near = search.hashed_knn(asked.select("query", F.col("query_text").alias("text")), records, deep)
    none = near.select("query", "id", "rank").limit(0)
    return search.fuse(none if lexical is None else lexical, near, n).select("query", "id", "score", "rank")


def recall(queries: DataFrame, records: DataFrame, now: Column, k: int = 10, linked: DataFrame | None = None, mode: str = "fts", edges: DataFrame | None = None) -> DataFrame:
    """query, id, score, rank, reasons: expand, search, rerank, score by all factors, boost linked records.

    ``queries``: query, text; ``records``: id, kind, text, confidence, created_at and, where known,
    accesses, feedback (-1 to 1) and degree; without these one access, no feedback and no edges count.
    ``edges`` (id), a row an edge, gives the degrees of the records that are found. First stage keeps max(4 k, 40) candidates,
    the reranker max(k, 20); only its hits are looked up in ``records`` and ``edges``, which are not shuffled.
    """
    expanded = search.expand_queries(queries).select("query", F.array_join("terms", " ").alias("more"))
    asked = queries.join(expanded, "query").select("query", F.concat_ws(" ", "text", "more").alias("text"), F.col("text").alias("query_text"))
    hits = candidates(asked, records, max(4 * k, 40), mode)
    ranked = keep(search.rerank(hits, queries.select("query", "text"), records, max(k, 20), 0.0), "ranked")
    found = small_side(keep(ranked.select("id").distinct(), "found"))
    records = records.join(found, "id", "left_semi")
    if edges is not None:
        degrees = edges.join(found, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
        records = records.drop("degree").join(degrees, "id", "left")
    for name, usual in (("accesses", 1), ("feedback", 0.0), ("degree", 0)):
        value = F.coalesce(F.col(name), F.lit(usual)) if name in records.columns else F.lit(usual)
        records = records.withColumn(name, value)
    ranked = ranked.join(asked.select("query", "query_text"), "query").join(records, "id")
    operational = F.col("query_text").rlike(detect.OPERATIONAL)
    factors = {
        "similarity": F.least(F.lit(1.0), F.col("final")), "recency": scoring.recency(F.unix_timestamp("created_at"), now), "confidence": F.col("confidence"),
        "access": scoring.access_boost(F.col("accesses")), "feedback": scoring.feedback_norm(F.col("feedback")), "fts": scoring.rank_boost(F.col("rank")), "risk": scoring.risk_boost(risk_of(F.col("kind")), operational),
        "graph": scoring.graph_boost(F.col("degree")), "path": F.lit(0.0), "specificity": F.when(T.word_count(F.col("text")) <= 18, 0.4).otherwise(0.0),
    }
    reasons = F.array_join(search.explain({c: v.cast("double") for c, v in factors.items() if c != "specificity"}), ",")
    scored = ranked.withColumn("reasons", reasons).withColumn("total", scoring.composite(factors)).select("query", "id", F.col("total").alias("score"), "reasons")
    out = search.top_k(scored, k)
    if linked is None:
        return out
    mark = linked.select("id").distinct().withColumn("linked", F.lit(True))
    moved = out.join(mark, "id", "left").withColumn("rank", F.when(F.col("linked"), F.col("rank") - 100).otherwise(F.col("rank")))
    w = Window.partitionBy("query").orderBy("rank", "id")
    return moved.withColumn("rank", F.row_number().over(w)).drop("linked")


def semantic_rounds(queries: DataFrame, rows: DataFrame, rounds: int = 3, k: int = 5) -> DataFrame:
    """query, id, similarity: best similarity over up to three rounds, each asking from the mean of the last round's hits."""
    ask, found = queries, None
    for _ in range(min(rounds, 3)):
        hits = search.knn(ask, rows, k)
        found = hits.select("query", "id", "similarity") if found is None else found.unionAll(hits.select("query", "id", "similarity"))
        parts = hits.join(rows, "id").select("query", F.posexplode("vec").alias("i", "x"))
        mean = parts.groupBy("query", "i").agg(F.avg("x").alias("x")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        ask = mean.select("query", F.transform("v", lambda e: e["x"]).alias("vec"))
    return found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))


def subqueries(evidence: DataFrame, n: int = 3) -> DataFrame:
    """query, subqueries: questions that the best four spans (query, rank, span) raise."""
    top = evidence.where("rank <= 4").select("query", "rank", F.array_join(F.slice(T.query_terms(F.col("span")), 1, 6), " ").alias("q")).where("q <> ''")
    agg = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("qs"))
    return agg.select("query", F.slice(F.array_distinct(F.transform("qs", lambda x: x["q"])), 1, n).alias("subqueries"))


def evidence_enabled(mode: Column, task: Column) -> Column:
    return F.when(mode == "force", True).when(mode == "off", False).otherwise(task.isin("debugging", "planning", "code_review", "refactoring"))


def lineage(ids: DataFrame, log: DataFrame, n: int = 5) -> DataFrame:
    """id, entries: the last ``n`` log rows (id, at, event) of each id, newest first."""
    rows = log.join(ids.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("id").orderBy(F.col("at").desc())
    last = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return last.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "event"))), lambda x: x["event"]).alias("entries"))


def chunk_step(hits: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """query, id, chunk_tokens, deferred of the hits (query, id) with several chunks: tokens of those chosen for the query, and how many are not."""
    texts = records.select("id", "text").join(hits.select("id").distinct(), "id", "left_semi")
    cut = keep(packing.chunks(texts), "chunks")
    many = cut.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    asked = hits.select("query", "id").join(many, "id").join(queries.select("query", "text"), "query")
    chosen = packing.select_chunks(packing.rank_chunks(cut.join(many.select("id"), "id", "left_semi"), asked.select("query", "id", "text")))
    shown = chosen.select("query", "id", "chunk").join(cut.select("id", "chunk", T.token_estimate(F.col("text")).alias("tokens")), ["id", "chunk"])
    agg = shown.groupBy("query", "id").agg(F.sum("tokens").alias("chunk_tokens"), F.count("*").alias("m"))
    return agg.join(many, "id").select("query", "id", "chunk_tokens", (F.col("n") - F.col("m")).alias("deferred"))


def pack(queries: DataFrame, records: DataFrame, now: Column, window_tokens: int = 8_000, k: int = 8, evidence: str = "auto") -> DataFrame:
    """One row a query: task, budget, ids kept, tokens used, ids evicted, chunks deferred, and the evidence spans chosen.

    A long record goes in by the chunks that answer the query best, the others are deferred. ``evidence`` (off, force, auto) tells whether spans are chosen, auto for tasks that call for them.
    """
    hits = keep(recall(queries, records, now, k).select("query", "id", "score"), "recalled")
    chunked = keep(chunk_step(hits, queries, records), "chunked")
    whole = records.select("id", "kind", "confidence", T.token_estimate(F.col("text")).alias("all_tokens"))
    details = hits.join(whole, "id").join(chunked, ["query", "id"], "left")
    details = details.withColumn("tokens", F.coalesce("chunk_tokens", "all_tokens")).withColumn("deferred", F.coalesce("deferred", F.lit(0)))
    tasks = queries.select("query", detect.task_type(F.col("text")).alias("task")).withColumn("budget", packing.token_budget(F.col("task"), F.lit(window_tokens)))
    fitted = packing.enforce_budget(details.join(tasks, "query"), F.col("budget"))
    ids = lambda kept: F.array_sort(F.collect_list(F.when(F.col("kept") == kept, F.col("id"))))
    agg = fitted.groupBy("query", "task", "budget").agg(ids(True).alias("ids"), ids(False).alias("evicted"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.when(F.col("kept"), F.col("deferred")).otherwise(0)).alias("deferred"))
    chosen = fitted.where(F.col("kept") & evidence_enabled(F.lit(evidence), F.col("task"))).select("query", "id").join(queries, "query")
    spans = packing.spans(records.join(chosen.select("id").distinct(), "id", "left_semi").select("id", "text"))
    picked = packing.select_evidence(chosen, spans)
    found = picked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "place"))).alias("evidence"))
    return agg.join(found, "query", "left").withColumn("over_budget", F.col("tokens") > F.col("budget"))


def details_of(matches: DataFrame, records: DataFrame, least: float = 0.75, most: int = 3, tokens: int = 1000) -> DataFrame:
    """query, id, place of the semantic matches (query, id, similarity) that go in full."""
    rows = matches.where(F.col("similarity") > least).join(records.select("id", T.token_estimate(F.col("text")).alias("tokens")), "id")
    return packing.greedy_prefix(rows, "query", [F.round("similarity", 9).desc(), F.col("id")], "tokens", most, tokens).select("query", "id", "place")


def operational_details(records: DataFrame, n: int = 5) -> DataFrame:
    """kind, id: escalated records, riskiest first, at most ``n`` of a kind."""
    w = Window.partitionBy("kind").orderBy(F.col("confidence").desc(), "id")
    risky = records.where(risk_rank(risk_of(F.col("kind"))) >= 3)
    return risky.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("kind", "id", "r")


# Settings of the policy grid.
LEAST_SCORES, MOST_SPANS, TERM_WEIGHTS = (0.1, 0.2, 0.35), (4, 6, 8), (0.2, 0.3, 0.5)


def policy_grid(spark: SparkSession) -> DataFrame:
    """policy, least, most, weight: least score, number of spans and weight of query terms, in every combination."""
    grid = enumerate(itertools.product(LEAST_SCORES, MOST_SPANS, TERM_WEIGHTS), 1)
    return spark.createDataFrame([(i, *p) for i, p in grid], "policy int, least double, most int, weight double")


def tune(chosen: DataFrame, span_rows: DataFrame, expected: DataFrame, packed: DataFrame, policies: DataFrame, budget: int) -> DataFrame:
    """policy, recall, evidence_recall, tokens, over_budget, value, best: a grid of evidence policies over all cases.

    ``chosen``: query, id, text of the query, a row a record packed for it; ``expected``: query, phrase;
    ``packed``: query, recall and tokens of the packed records, one row a case. The value is both
    recalls less 0.0005 a token of the mean and 0.2 a case over ``budget``; the first policy wins ties.
    """
    grid = small_side(policies, 1000)
    scored = packing.evidence_candidates(chosen, span_rows).crossJoin(grid)  # a grid of settings
    scored = scored.withColumn("score", packing.evidence_score(F.col("weight"))).where(F.col("score") >= F.col("least"))
    w = Window.partitionBy("policy", "query").orderBy(F.col("score").desc(), "id", "place")
    best = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("most")).select("policy", "query", "span")
    used = best.groupBy("policy", "query").agg(F.sum(T.token_estimate(F.col("span"))).alias("spent"))
    found = best.join(expected, "query").where(F.contains("span", "phrase")).groupBy("policy", "query").agg(F.countDistinct("phrase").alias("found"))
    wanted = expected.groupBy("query").agg(F.countDistinct("phrase").alias("wanted"))
    cases = packed.join(wanted, "query", "left").crossJoin(grid.select("policy")).join(used, ["policy", "query"], "left").join(found, ["policy", "query"], "left")
    share = F.when(F.col("wanted") > 0, F.coalesce("found", F.lit(0)) / F.col("wanted")).otherwise(1.0)
    cases = cases.select("policy", "recall", share.alias("evidence"), (F.col("tokens") + F.coalesce("spent", F.lit(0))).alias("tokens"))
    out = cases.groupBy("policy").agg(F.avg("recall").alias("recall"), F.avg("evidence").alias("evidence_recall"), F.avg("tokens").alias("tokens"), F.count_if(F.col("tokens") > budget).alias("over_budget"))
    out = out.withColumn("value", F.col("recall") + F.col("evidence_recall") - 0.0005 * F.col("tokens") - 0.2 * F.col("over_budget"))
    top = out.agg(F.max_by("policy", F.struct(F.round("value", 9), -F.col("policy"))).alias("top"))
    return policies.join(out, "policy").crossJoin(F.broadcast(top)).withColumn("best", F.col("policy") == F.col("top")).drop("top")  # a single row
