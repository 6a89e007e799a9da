"""Record lifecycle: states, expiry, superseding, staleness, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.scoring import half_up
from loam.operators import folds
from loam.plans import ordered

GAIN, LOSS, KEEP, STEP = 0.2, -0.15, 0.85, 0.15


def latest_state(log: DataFrame, time: str, tie: str) -> DataFrame:
    return log.groupBy("entity").agg(F.max_by("state", F.struct(time, tie)).alias("state"))


def expire(rows: DataFrame, cutoff: Column) -> DataFrame:
    """``rows`` with status expired where an active row is due, and ``changed``."""
    due = (F.col("status") == "active") & F.coalesce(F.col("expires_at") <= cutoff, F.lit(False))
    return rows.withColumn("changed", due).withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def supersede(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with superseded ones archived, and one edge new -> old for each pair (old, new)."""
    by = pairs.groupBy(F.col("old").alias("id")).agg(F.max("new").alias("superseded_by"))
    out = rows.join(by, "id", "left").withColumn("status", F.when(F.col("superseded_by").isNotNull(), "archived").otherwise(F.col("status")))
    edges = pairs.distinct().select(F.col("new").alias("source"), F.col("old").alias("target"), F.lit("supersedes").alias("relation"), F.lit(0.9).alias("confidence"))
    return out, edges


# Severity of each stale reason.
SEVERITY = {"missing_file": 3, "missing_symbol": 3, "fingerprint_mismatch": 2, "memory_conflict": 3, "low_confidence": 1}


def stale_report(reasons: DataFrame) -> DataFrame:
    """id, severity, reasons, action from rows (id, reason)."""
    from loam.schemas import lookup

    each = reasons.distinct().withColumn("s", lookup(SEVERITY, F.col("reason")))
    agg = each.groupBy("id").agg(F.max("s").alias("severity"), F.array_sort(F.collect_set("reason")).alias("rs"))
    has = lambda r: F.array_contains("rs", r)
    action = F.when(has("memory_conflict"), "supersede").when(has("missing_file") | has("missing_symbol"), "update_link").when(F.size("rs") > 0, "review").otherwise("none")
    return agg.select("id", "severity", F.array_join("rs", ",").alias("reasons"), action.alias("action"))


def feedback_fold(events: DataFrame, key: str, order: list[str], good: Column) -> DataFrame:
    """Running feedback score of each key: a step of 15 % towards +0.2 or -0.15 per event in order, within [-1, 1], 3 decimals each.

    A key's events are folded in runs that are joined afterwards, so no key is gathered.
    """
    machine = folds.feedback_table(GAIN, LOSS, KEEP, STEP)
    out = ordered.fold(events, key, order, {"_good": F.coalesce(good, F.lit(False))}, machine)
    score = F.pandas_udf(lambda states: states.map(lambda s: (machine.number(bytes(s)) - 1000) / 1000), "double")
    return out.select(key, score("state").alias("score"), "n")


def decay(score: Column, idle_days: Column, after: int = 7, days: float = 30.0) -> Column:
    """An idle score fades exponentially; changes under 0.001 are not made."""
    new = half_up(score * F.exp(-idle_days / days), 3)
    return F.when((idle_days >= after) & (F.abs(new - score) >= 0.001), new).otherwise(score)


def close_sessions(sessions: DataFrame) -> DataFrame:
    """Each closed session (session, summary, decisions, tooling) as proposals: session, kind, text."""
    entry = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))
    every = F.concat(entry("session_summary", F.array("summary")), entry("decision", F.col("decisions")), entry("tooling", F.col("tooling")))
    return sessions.select("session", F.inline(every)).where("length(text) > 0")
