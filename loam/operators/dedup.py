"""Exact and vector near-duplicates of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.records import first_per_key
from loam.plans.materialize import keep


def exact(rows: DataFrame) -> DataFrame:
    """The record with the smallest id of each (project, content hash)."""
    return first_per_key(rows.withColumn("hash", T.content_hash(F.col("text"))), ["project", "hash"], [F.col("id")])


def first_by_hash(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """The first row of each hash, by partial aggregation: a hot hash costs each task one row."""
    firsts = rows.groupBy(digest).agg(F.min_by(F.struct(*[c for c in rows.columns if c != digest]), order).alias("_r"))
    return firsts.select(digest, "_r.*")


def vector_pairs(rows: DataFrame, threshold: float, block: int = 8192) -> DataFrame:
    """a < b and similarity of all pairs at or above the threshold, exactly.

    Different vectors meet in blocks of cells around fitted centres, and only where the angles between the cells
    allow a pair; no task holds more than two blocks and the pairs of a tile. Copies are joined on afterwards.
    """
    from loam.plans.blocks import similar_pairs

    return similar_pairs(rows, threshold, block)


def vector_classes(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of different vectors as ``vector_pairs``, by the smallest id of each, and the rows (id, agent, rep, n, own) of every class."""
    from loam.plans.blocks import similar_classes

    return similar_classes(rows, threshold)


def class_links(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that connect what all pairs of the rows connect; a copy is linked with its class only."""
    return pairs.select("a", "b").unionAll(members.where((F.col("own") >= threshold) & (F.col("rep") != F.col("id"))).select("rep", "id"))


def cross_pairs(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """n: how many pairs of rows at or above the threshold are of different agents, counted by class."""
    own = members.where(F.col("agent").isNotNull()).groupBy("rep", "agent").agg(F.count("*").alias("n"), F.first("own").alias("own"))
    own = keep(own, "class-agents")
    held = own.groupBy("rep").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.first("own").alias("own"))
    side = lambda df, s: df.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), *[c for c in df.columns if c == "agent"])
    every = pairs.select("a", "b").join(side(held, "a"), "a").join(side(held, "b"), "b").select((F.col("n_a") * F.col("n_b")).alias("n"))
    alike = pairs.select("a", "b").join(side(own, "a"), "a").join(side(own, "b"), ["b", "agent"]).select((-F.col("n_a") * F.col("n_b")).alias("n"))
    within = held.where(F.col("own") >= threshold).select(F.expr("(n * n - squares) div 2").alias("n"))
    return every.unionAll(alike).unionAll(within).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def earlier_candidates(pairs: DataFrame, members: DataFrame, threshold: float, old: Column, new: Column) -> DataFrame:
    """new, old, similarity: for every row of ``new`` (a condition on ``id``) the smallest id of ``old`` in each class at or above the threshold, if smaller than its own."""
    firsts = members.where(old).groupBy("rep").agg(F.min("id").alias("old")).withColumnRenamed("rep", "other")
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other"), "similarity").unionAll(pairs.select("b", "a", "similarity"))
    same = members.where(F.col("own") >= threshold).groupBy("rep").agg(F.first("own").alias("similarity")).select("rep", F.col("rep").alias("other"), "similarity")
    asked = members.where(new).select("rep", F.col("id").alias("new"))
    return both.unionAll(same).join(firsts, "other").join(asked, "rep").where("old < new").select("new", "old", "similarity")


def best_match(pairs: DataFrame, need: Column) -> DataFrame:
    """new, into, similarity: the most similar old record that reaches ``need``; ties to the smallest id."""
    ok = pairs.where(F.col("similarity") >= need)
    best = F.max_by(F.struct(F.col("old").alias("into"), "similarity"), F.struct(F.round("similarity", 9), -F.col("old")))
    return ok.groupBy("new").agg(best.alias("m")).select("new", "m.*")
