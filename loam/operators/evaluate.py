"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.scoring import half_up


def recall(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """query, relevant, hits, recall, rr of hits (query, id, rank) against truth (query, id)."""
    joined = truth.join(hits.select("query", "id", "rank"), ["query", "id"], "left")
    out = joined.groupBy("query").agg(F.count("*").alias("relevant"), F.count("rank").alias("hits"), F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)).alias("rr"))
    return out.select("query", "relevant", "hits", (F.col("hits") / F.col("relevant")).alias("recall"), "rr")


def ranking_metrics(hits: DataFrame) -> DataFrame:
    """p1, p3, p5, mrr, ndcg of the first five hits (query, rank, rel) of each query."""
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / float(k)
    gain = F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    agg = hits.where("rank <= 5").groupBy("query").agg(
        upto(1).alias("p1"), upto(3).alias("p3"), upto(5).alias("p5"), F.max(F.col("rel") / F.col("rank")).alias("mrr"), gain.alias("g"), F.sum("rel").cast("int").alias("n")
    )
    return agg.select("query", "p1", "p3", "p5", "mrr", half_up(F.when(F.col("n") > 0, F.col("g") / ideal).otherwise(0.0), 6).alias("ndcg"))


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Median and nearest-rank 95th percentile of each group."""
    p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(group).agg(F.median(value).alias("median"), p95.alias("p95"))
