"""Failures, recoveries and corrections in session transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import detect
from loam.functions import text as T
from loam.operators import folds
from loam.plans import ordered


def failures(lines: DataFrame) -> DataFrame:
    """session, at, type, confidence, context: detector hits on lines (session, at, line), five lines around each.

    A correction word within the line and the two after it makes a line a wrong memory at 0.8.
    """
    w = Window.partitionBy("session").orderBy("at")
    near = F.concat_ws(" ", F.collect_list("line").over(w.rowsBetween(0, 2)))
    hits = detect.failure_hits(F.col("line"))
    has = F.exists(hits, lambda h: h["type"] == "wrong_memory")
    more = F.when(~has & F.col("near").rlike(detect.CORRECTION), F.array(F.struct(F.lit("wrong_memory").alias("type"), F.lit(0.8).alias("confidence")))).otherwise(
        F.array().cast("array<struct<type:string,confidence:double>>")
    )
    rows = lines.withColumn("near", near).withColumn("context", F.concat_ws("\n", F.collect_list("line").over(w.rowsBetween(-5, 5))))
    return rows.select("session", "at", "line", "context", F.inline(F.concat(hits, more)))


def distinct_failures(rows: DataFrame) -> DataFrame:
    """The first hit of each (session, type, first 100 characters of the line)."""
    w = Window.partitionBy("session", "type", F.substring("line", 1, 100)).orderBy("at")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def recovery_candidates(calls: DataFrame, ahead: int = 8) -> DataFrame:
    """session, failed, recovered: a failed call with each success in the next ``ahead`` calls (session, at, success)."""
    a = calls.where("NOT success").select("session", F.col("at").alias("failed"), F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("d"))
    b = calls.where("success").select("session", F.col("at").alias("recovered"))
    return a.withColumn("recovered", F.col("failed") + F.col("d")).join(b, ["session", "recovered"]).select("session", "failed", "recovered")


def recovery_pairs(calls: DataFrame, order: list[str], ahead: int = 8) -> DataFrame:
    """session, failed, recovered: numbers of the calls (session, order columns, success) of one-to-one pairs.

    Failures in order take the first success within ``ahead`` calls that is not taken yet: what a machine over the calls tells that
    knows which of the last ones wait. A session's calls are walked in runs, so a long one is spread over tasks.
    """
    told = ordered.scan(calls, "session", order, {"_ok": F.col("success")}, folds.pairing_table(ahead))
    return told.where("told > 0").select("session", (F.col("place") - F.col("told")).alias("failed"), F.col("place").alias("recovered"))


# Tool names by category.
TOOL_CATEGORIES = {
    "read_file": "file_read", "view_file": "file_read", "Read": "file_read", "write_to_file": "file_write", "replace_file_content": "file_write",
    "multi_replace_file_content": "file_write", "Edit": "file_write", "run_command": "command", "Bash": "command", "bash": "command",
    "search": "search", "grep_search": "search", "Grep": "search",
}


def tool_category(tool: Column) -> Column:
    from loam.schemas import lookup

    return F.coalesce(lookup(TOOL_CATEGORIES, tool), F.lit("other"))


def primary_argument(args: Column, category: Column) -> Column:
    """The distinguishing argument of a call (map of snake-case keys)."""
    first = lambda *keys: F.coalesce(*[args[k] for k in keys], F.lit(""))
    return F.when(category == "search", first("query", "search_path", "path", "pattern")).otherwise(
        first("path", "file_path", "absolute_path", "target_file", "command", "command_line", "query", "search_path")
    )


MISSING = r"\b(not found|enoent|missing|command not found|module not found|cannot find)\b"
INSTALL = r"\b(install|add|apt|brew|npm|yarn|bun|pip)\b"


def recovery_pattern(pairs: DataFrame) -> DataFrame:
    """Adds pattern and confidence to pairs (category, arg, error, category2, arg2); null pattern where none fits."""
    a, b = F.col("arg"), F.col("arg2")
    same = F.col("category") == F.col("category2")
    folder = lambda p: F.regexp_replace(p, r"/?[^/]*$", "")
    head = lambda c: F.substring_index(c, " ", 2)
    nested = (folder(a) != "") & (folder(b) != "") & (F.contains(folder(a), folder(b)) | F.contains(folder(b), folder(a)))
    hit = lambda name, c: F.struct(F.lit(name).alias("pattern"), F.lit(c).alias("confidence"))
    is_file = F.col("category").isin("file_read", "file_write")
    found = (
        F.when(same & ((a == "") | (b == "") | (a == b)), F.lit(None))
        .when(same & is_file & (T.basename(a) == T.basename(b)), hit("wrong_path", 0.85))
        .when(same & is_file & nested, hit("wrong_path", 0.65))
        .when(same & is_file, hit("wrong_path", 0.5))
        .when(same & (F.col("category") == "command") & F.lower(F.coalesce("error", F.lit(""))).rlike(MISSING) & F.lower(b).rlike(INSTALL), hit("missing_dep", 0.8))
        .when(same & (F.col("category") == "command") & (head(a) == head(b)), hit("wrong_args", 0.7))
        .when(same & (F.col("category") == "command"), hit("wrong_command", 0.6))
        .when(same & (F.col("category") == "search"), hit("narrow_search", 0.65))
        .when(same, hit("wrong_args", 0.5))
        .when((F.col("category") != "other") & (F.col("category2") != "other"), hit("fallback_tool", 0.45))
    )
    return pairs.withColumn("_h", found).select(*pairs.columns, F.col("_h.pattern").alias("pattern"), F.col("_h.confidence").alias("confidence"))


def corrections(rows: DataFrame) -> DataFrame:
    """Failures (session, type, line, context, confidence) as corrections with text, kind and risk."""
    text = F.format_string("%s: %s", F.col("type"), F.substring("line", 1, 200))
    return rows.select("session", "type", text.alias("text"), detect.infer_kind(F.col("context")).alias("kind"), detect.infer_risk(F.col("context")).alias("risk"), "confidence")


def apply_learnings(rows: DataFrame, confidence: float = 0.4) -> DataFrame:
    """Corrections (session, text, kind, risk), the first of each text and kind: those of low risk as records, the rest as proposals."""
    first = Window.partitionBy("text", "kind").orderBy("session")
    once = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    low = F.col("risk") == "low"
    return once.select("session", "kind", "text", F.when(low, "record").otherwise("proposal").alias("target"), F.when(low, F.lit(confidence)).alias("confidence"))


#: Characters of both ends of a line that a correction may reach over into the next one.
ENDS = 20


def mine(lines: DataFrame, least: float = 0.5, most: int = 10) -> DataFrame:
    """session, failures, automatic, pending: hits per session, and how many of its first corrections need no review.

    Hits, corrections and risks are those of ``failures`` and ``corrections``. Every line is searched once: words of risk lie within
    a line, so a context has those of its lines, and a correction lies in one line or where two of them meet.
    """
    line = F.col("line")
    ends = F.when(F.length(line) <= 2 * ENDS, line).otherwise(F.concat(F.substring(line, 1, ENDS), F.lit("_"), F.substring(line, -ENDS, ENDS)))
    marks = lines.select(
        "session", "at", F.substring(line, 1, 100).alias("_line"), ends.alias("_ends"), detect.failure_hits(line).alias("_hits"), line.rlike(detect.CORRECTION).alias("_corrected"), (detect.infer_risk(line) != "low").alias("_risky")
    )
    w = Window.partitionBy("session").orderBy("at")
    near = w.rowsBetween(0, 2)
    corrected = F.coalesce(F.max("_corrected").over(near), F.lit(False)) | F.concat_ws(" ", F.collect_list("_ends").over(near)).rlike(detect.CORRECTION)
    risky = F.coalesce(F.max("_risky").over(w.rowsBetween(-5, 5)), F.lit(False))
    rows = marks.withColumn("_near", corrected).withColumn("_pending", risky)
    more = F.when(~F.exists("_hits", lambda h: h["type"] == "wrong_memory") & F.col("_near"), F.array(F.struct(F.lit("wrong_memory").alias("type"), F.lit(0.8).alias("confidence"))))
    every = rows.select("session", "at", F.col("_line").alias("line"), "_pending", F.inline(F.concat("_hits", F.coalesce(more, F.array().cast("array<struct<type:string,confidence:double>>")))))
    hits = distinct_failures(every).where(F.col("confidence") >= least)
    first = Window.partitionBy("session").orderBy(F.col("confidence").desc(), "at", "type")
    among = (F.col("_r") <= most).cast("long")
    ranked = hits.withColumn("_r", F.row_number().over(first))
    pending = among * F.col("_pending").cast("long")
    return ranked.groupBy("session").agg(F.count("*").alias("failures"), F.sum(among - pending).alias("automatic"), F.sum(pending).alias("pending"))
