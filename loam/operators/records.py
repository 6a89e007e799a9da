"""Scans, lookups, constraints and table-to-table writes of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, n: int, offset: int = 0, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The ``n`` newest rows after ``offset``; ties by id."""
    return rows.orderBy(F.col(time).desc(), F.col(tie)).offset(offset).limit(n)


def newest_per(rows: DataFrame, group: str, n: int, time: str = "created_at", tie: str = "id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(time).desc(), F.col(tie)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def by_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Batch form of a point lookup."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def not_stored(rows: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(stored.select(*on).distinct(), on, "left_anti")


def resolve_prefixes(prefixes: DataFrame, ids: DataFrame, at_least: int = 1) -> DataFrame:
    """prefix, status (ok, ambiguous, missing) and id, the id only where one matches.

    Every id offers its own prefixes of the lengths asked for, so the match is an equi-join.
    """
    lengths = [r.n for r in prefixes.select(F.length("prefix").alias("n")).where(F.col("n") >= at_least).distinct().collect()]  # no more than an id has characters
    ids = ids.select(F.col("id").cast("string").alias("id"))
    cut = ids.select("id", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).where(F.length("id") >= F.col("n"))
    cut = cut.select(F.expr("substring(id, 1, n)").alias("prefix"), "id")
    found = cut.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.count("*").alias("matches"), F.min("id").alias("one"))
    status = F.when(F.col("matches").isNull(), "missing").when(F.col("matches") > 1, "ambiguous").otherwise("ok")
    return prefixes.join(found, "prefix", "left").select("prefix", status.alias("status"), F.when(F.col("matches") == 1, F.col("one")).alias("id"))


def constrain(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``violations``: names of the rules that don't hold (a rule that is null doesn't)."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("violations", F.array_compact(F.array(*broken)))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("violations") == 0).drop("violations")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("violations") > 0)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_new(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``batch`` to append: the first of each key that ``stored`` doesn't hold."""
    return not_stored(first_per_key(batch, keys, order), stored, keys)


def update_rows(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the non-null columns of ``changes`` in place, by key."""
    named = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    new = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in stored.columns]
    return stored.join(named, key, "left").select(*new)


def delete_cascade(items: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and edges (source, target) without the ids in ``gone`` (id)."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return items.join(ids, "id", "left_anti"), left.select(*edges.columns)


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], updated: str = "updated_at", created: str = "created_at") -> DataFrame:
    """One row a key: earliest ``created``, everything else from the row last ``updated``."""
    both = stored.unionByName(batch)
    rest = [c for c in both.columns if c not in (*keys, created)]
    merged = both.groupBy(*keys).agg(F.min(created).alias(created), F.max_by(F.struct(*rest), F.struct(updated, *rest)).alias("_last"))
    return merged.select(*keys, created, "_last.*").select(*stored.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys and change (added, deleted, modified, same) between two snapshots."""
    a, b = old.select(*keys, F.col(digest).alias("_old")), new.select(*keys, F.col(digest).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified").otherwise("same")
    )
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def merge_evidence(rows: DataFrame, key: str) -> DataFrame:
    """Evidence of merged records: one entry per (source, reference), most confidence, sources and their number."""
    once = rows.groupBy(key, "source", "reference").agg(F.max("confidence").alias("confidence"))
    return once.groupBy(key).agg(
        F.count("*").alias("n_evidence"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )
