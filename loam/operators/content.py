"""Content typing and loss-aware compression of logs, records, configuration, diffs, code and prose."""

from __future__ import annotations

from functools import reduce

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import detect
from loam.functions import text as T
from loam.functions.binding import let
from loam.plans.materialize import keep

MIN_TYPE_SCORE = 0.35


def lines_of(rows: DataFrame, n: int | None = None) -> DataFrame:
    """id, at, line; only the first ``n`` lines of each text if given."""
    parts = F.split("text", "\n") if n is None else F.slice(F.split("text", "\n"), 1, n)
    return rows.select("id", F.posexplode(parts).alias("at", "line"))


# What lines and texts of each type look like, and what it counts for.
DIFF_MARKS = r"^diff --git|^@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@|^---\s|^\+\+\+\s"
DIFF_CHANGE = r"^[+-](?!\+\+|--)"
#: The first pattern that a trimmed line has decides.
CODE_LINES = (
    (r"^(pub\s+)?(async\s+)?(function|class|def\s|fn\s|interface|enum|type|struct|impl|module|namespace)\s+\w", 3.0),
    (r"^(import\s+|export\s+(default\s+)?(async\s+)?(function|class|const|let|var|interface|type|enum))", 3.0),
    (r"\b(const|let|var)\s+\w+\s*(:\s*\w+)?\s*=", 1.5),
    (r"^[A-Za-z_$][\w$-]*\s*:\s*[^,]+,?$", 0.75),
    (r"^(if|else if|for|while|switch|try|catch|finally)\b", 1.0),
    (r"[{};]\s*$", 1.0),
    (r"^(return|throw|await|yield)\s", 1.0),
)
#: All of them count.
CODE_SIGNALS = ((r"\bnew\s+[A-Z]\w*\s*\(", 2.0), (r"=>", 1.0), (r"\bprocess\.env\.[A-Z0-9_]+\b", 1.0), (r"\basync\s+function\b|\bPromise<|\):\s*Promise\b", 1.0))
LINE_COMMENT, CODE_PUNCTUATION = (r"^\s*//\s+\w", 0.35), r"[{}();=]"
FENCED, FENCED_SCRIPT = (r"(?m)^```[\s\S]*```$", 0.5), (r"(?im)^\s*```(?:ts|tsx|js|jsx|typescript|javascript)\b", 0.7)
DENSITIES, SIGNALS = ((1.5, 0.7), (0.8, 0.5), (0.4, 0.2)), ((6.0, 0.45), (3.0, 0.25))
STRONG_CODE = r"\b(const|let|var)\s+\w+\s*=|\basync\s+function\b|\bnew\s+[A-Z]\w*\s*\("
SENTENCE = r"[.!?]\s+[A-Z]"
STAMP = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\[\d{4}-\d{2}-\d{2}|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
LEVEL_WORD = r"(?i)\b(ERROR|WARN|INFO|DEBUG|TRACE|FATAL|CRITICAL)\b"
DOCKER = r"(?m)^(FROM|RUN|COPY|ENV|EXPOSE|CMD|ENTRYPOINT|WORKDIR|ADD|VOLUME|USER|ARG|LABEL)\s"
SETTING = r"^[A-Za-z_][\w.-]*\s*[=:]\s*"
FIRST_LINES = ((r"^\[.*\]\s*$", 0.5), (r"^[A-Z_][A-Z0-9_]*=", 0.4))
PROSE_WORDS = r"(?i)\b" + T.one_of(
    "the a an is was are were been have has had will would should could may might can shall we our us they their them I you he she it this that "
    "these those and or but because however therefore although while since also just very really quite maybe perhaps actually basically probably".split()
) + r"\b"
CODE_WORDS = r"\b(function|const|let|var|import|export|class|interface|type|enum|return|await|async|throw|catch|try|yield)\b"
BULLET, HEADER = r"(?m)^(\s*[-*+\u2022]|\s*\d+[.)]\s)", r"(?m)^#{1,4}\s+\w+"
TYPES = ("diff", "code", "log", "json", "config")


def _sum(items: Column, weight) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + weight(x))


def _graded(value: Column, steps, otherwise: float = 0.0) -> Column:
    """What the first step counts for that the value reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, worth in steps[1:]:
        out = out.when(value >= least, worth)
    return out.otherwise(otherwise)


def _when(flag: Column, worth: float) -> Column:
    return F.when(flag, worth).otherwise(0.0)


def _diff_score(lines: Column) -> Column:
    filled = lambda x: F.length(F.trim(x)) > 0
    marks = _sum(lines, lambda x: F.when(x.rlike(DIFF_MARKS), 3.0).when(x.rlike(DIFF_CHANGE), 1.0).otherwise(0.0))
    plain = F.filter(lines, lambda x: ~x.rlike(DIFF_MARKS) & ~x.rlike(r"^[+-]"))
    other = let(plain, lambda p: F.size(F.filter(p, lambda x: filled(x) & ~x.startswith(" "))) - 0.5 * F.size(F.filter(p, lambda x: x.startswith(" "))))
    return F.least(F.lit(1.0), marks / 6 * let(other, lambda o: F.when(o > 10, 0.5).when(o > 5, 0.7).otherwise(1.0)))


def _code_score(text: Column, lines: Column, sentences: Column, words: Column) -> Column:
    def weight(x: Column) -> Column:
        out = F.when(x.rlike(CODE_LINES[0][0]), CODE_LINES[0][1])
        for pattern, worth in CODE_LINES[1:]:
            out = out.when(x.rlike(pattern), worth)
        return out.otherwise(0.0)

    filled = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    signal = lambda x: sum((_when(x.rlike(p), w) for p, w in CODE_SIGNALS), F.lit(0.0))
    both = let(filled, lambda f: F.struct((_sum(f, weight) / F.greatest(F.size(f), F.lit(1))).alias("density"), _sum(f, signal).alias("signals")))
    punctuated = F.exists(lines, lambda x: x.rlike(CODE_PUNCTUATION))
    comments = F.when(punctuated, _sum(lines, lambda x: _when(x.rlike(LINE_COMMENT[0]), LINE_COMMENT[1]))).otherwise(0.0)
    score = _when(text.rlike(FENCED[0]), FENCED[1]) + _when(text.rlike(FENCED_SCRIPT[0]), FENCED_SCRIPT[1])
    score = score + let(both, lambda b: _graded(b["density"], DENSITIES) + let(b["signals"] + comments, lambda x: _graded(x, SIGNALS)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score - _when(sentences / F.greatest(F.lit(1.0), words / 15.0) > 0.15, 0.2)))


def _log_score(lines: Column) -> Column:
    trimmed = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x) > 0)

    def of(ls: Column) -> Column:
        stamped = _sum(ls, lambda x: F.when(x.rlike(STAMP), F.when(x.rlike(LEVEL_WORD), 2.0).otherwise(1.0)).otherwise(0.0))
        bare = F.size(F.filter(ls, lambda x: ~x.rlike(STAMP) & x.rlike(LEVEL_WORD)))
        return F.least(F.lit(1.0), (stamped + let(bare, lambda k: F.when(k >= 3, 0.5 * k).otherwise(0.0))) / 8)

    return let(trimmed, of)


def _json_score(text: Column) -> Column:
    trimmed = F.trim(text)
    shaped = (trimmed.startswith("{") & trimmed.endswith("}")) | (trimmed.startswith("[") & trimmed.endswith("]"))
    return F.when(shaped, F.when(F.try_parse_json(trimmed).isNotNull(), 1.0).otherwise(0.6)).otherwise(0.0)


def _config_score(text: Column, lines: Column) -> Column:
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    score = _when(text.rlike(DOCKER), 0.8) + sum((_when(first.rlike(p), w) for p, w in FIRST_LINES), F.lit(0.0))
    score = score + _when(first.rlike(r"^[\w-]+:\s") & ~F.contains(text, F.lit("{")) & ~F.contains(text, F.lit(";")), 0.3)
    kept = F.filter(lines, lambda x: x != "")
    share = let(kept, lambda k: F.when(F.size(k) > 0, F.size(F.filter(k, lambda x: x.rlike(SETTING))) / F.size(k)).otherwise(0.0))
    return F.least(F.lit(1.0), score + _when(share > 0.6, 0.5))


def _prose_score(text: Column, sentences: Column, words: Column) -> Column:
    density = sentences / F.greatest(F.lit(1.0), words / 12.0)
    said = let(F.regexp_count(text, F.lit(PROSE_WORDS)) / words, lambda x: F.when(x > 0.06, 0.25).when(x > 0.03, 0.1).otherwise(0.0))
    score = 0.3 + F.when(density > 0.2, 0.3).when(density > 0.08, 0.15).otherwise(0.0) + said
    score = score + _when(F.regexp_count(text, F.lit(BULLET)) >= 3, 0.1) + _when(F.regexp_count(text, F.lit(HEADER)) >= 2, 0.15)
    score = score - _when(F.regexp_count(text, F.lit(CODE_WORDS)) / words > 0.03, 0.15)
    return F.when(words < 20, 0.3).otherwise(F.greatest(F.lit(0.25), F.least(F.lit(1.0), score)))


def type_scores(text: Column) -> Column:
    """struct of the score in [0, 1] of each content type and of prose; lines and words are cut once."""

    def of(lines: Column, sentences: Column, words: Column) -> Column:
        head = lambda n: F.slice(lines, 1, n)
        return F.struct(
            _diff_score(head(25)).alias("diff"), _code_score(text, head(80), sentences, words).alias("code"), _log_score(head(40)).alias("log"),
            _json_score(text).alias("json"), _config_score(text, lines).alias("config"), _prose_score(text, sentences, words).alias("prose"),
        )

    text = F.coalesce(text, F.lit(""))
    words = T.word_count(text).cast("double")
    return let(F.split(text, "\n"), lambda ls: let(F.struct(F.regexp_count(text, F.lit(SENTENCE)).alias("s"), words.alias("w")), lambda x: of(ls, x["s"], x["w"])))


def _best(scores: Column) -> Column:
    """The type that beats prose and scores enough; of equals the first."""
    best = F.greatest(*[F.when(scores[k] >= MIN_TYPE_SCORE, scores[k]).otherwise(0.0) for k in TYPES])
    out = F.when(best <= scores["prose"], "prose")
    for k in TYPES:
        out = out.when(scores[k] == best, k)
    return out


def content_type(text: Column) -> Column:
    """diff, code, log, json, config, or prose where no other type scores both enough and more than prose."""
    return let(type_scores(text), _best)


def content_type_for_kind(text: Column, kind: Column) -> Column:
    """Records of code context that would be prose lean to code where something in the text marks it."""

    def of(scores: Column) -> Column:
        marked = (scores["code"] >= MIN_TYPE_SCORE - 0.1) | text.rlike(FENCED_SCRIPT[0]) | text.rlike(STRONG_CODE)
        return let(_best(scores), lambda t: F.when((t == "prose") & (kind == "code_context") & (scores["code"] >= 0.2) & marked, "code").otherwise(t))

    return let(type_scores(text), of)


LEVEL_RANK = {"error": 0, "warn": 1, "info": 2, "other": 3, "debug": 4}


def log_groups(rows: DataFrame) -> DataFrame:
    """id, level, pattern, n, examples (three first) of log lines (id, line)."""
    named = rows.select("id", T.log_level(F.col("line")).alias("level"), T.log_pattern(F.col("line")).alias("pattern"), "line", "at")
    w = Window.partitionBy("id", "level", "pattern").orderBy("at")
    ranked = named.withColumn("r", F.row_number().over(w))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "line"))))
    return ranked.groupBy("id", "level", "pattern").agg(F.count("*").alias("n"), F.transform(first, lambda x: x["line"]).alias("examples"))


# Marks and words of shown logs.
LOG_MARKS = {"error": "\u274c ", "warn": "\u26a0\ufe0f ", "info": "\u2139\ufe0f  "}
MORE = "  \u2514\u2500 +%d similar %s occurrences"
SUMMARY = "\n\u2500\u2500 Compression summary: %s \u2014 %d total lines"
HYGIENE = " \u2026 [Truncated for Context Hygiene]"
LEADING_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*"
SERVICE, ERROR_NAME = r"\]\s+([\w.-]+)\s+", r"\b([A-Z][A-Za-z0-9_]*(?:Error|Exception))\b"
AFTER_ERROR, AFTER_LEVEL = r"(?s)\b(?:Error|Exception):\s*(.+)$", r"(?i)\b(?:ERROR|FATAL|CRITICAL)\]\s+[\w.-]+\s+(.+)$"
IDS = r"(?i)\b(requestId|sessionId|userId|traceId|spanId|correlationId)=[\w-]+"
SHORT_LINES, SHORT_ERRORS, SIGNATURES, REQUESTS, MESSAGE = 80, 2, 8, 6, 72


def _log_lines(text: Column) -> Column:
    """Array of the filled lines of a log: line, level, pattern."""
    trimmed = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(trimmed, lambda x: F.struct(x.alias("line"), T.log_level(x).alias("level"), T.log_pattern(x).alias("pattern")))


def _nonempty(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def _signed(x: Column) -> Column:
    """Service and error signature of an error line."""
    service = _nonempty(F.regexp_extract(x["line"], SERVICE, 1), F.lit("unknown-service"))
    message = _nonempty(F.regexp_extract(x["line"], AFTER_ERROR, 1), F.regexp_extract(x["line"], AFTER_LEVEL, 1), x["pattern"])
    compact = F.substring(F.trim(F.regexp_replace(F.regexp_replace(message, IDS, ""), r"\s+", " ")), 1, MESSAGE)
    return F.concat(service, F.lit(": "), _nonempty(F.regexp_extract(x["line"], ERROR_NAME, 1), F.lit("error")), F.lit(": "), compact)


def _short_errors(lines: Column) -> Column:
    """A short log with several errors as its error signatures; null for others, and where that is no shorter."""
    errors = F.filter(lines, lambda x: x["level"] == "error")

    def shown(signed: Column) -> Column:
        kinds = F.array_distinct(signed)
        counted = F.transform(kinds, lambda k, i: F.struct((-F.size(F.filter(signed, lambda x: x == k))).alias("n"), i.alias("i"), k.alias("k")))
        top = F.transform(F.slice(F.array_sort(counted), 1, SIGNATURES), lambda g: F.format_string("- %s x%d", g["k"], -g["n"]))
        ids = F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x["line"], F.lit(r"\brequestId=([\w-]+)"), F.lit(1)))))
        head = F.format_string("log error signatures: %d error lines across %d patterns", F.size(signed), F.size(kinds))
        asked = let(ids, lambda r: F.when(F.size(r) > 0, F.array(F.concat(F.lit("requestIds: "), F.array_join(F.slice(r, 1, REQUESTS), ", ")))).otherwise(F.array().cast("array<string>")))
        last = F.format_string("summary: %d lines compacted; retrieve full log with memory_retrieve", F.size(lines))
        return F.array_join(F.concat(F.array(head), top, asked, F.array(last)), "\n")

    whole = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    short = F.size(lines).between(1, SHORT_LINES) & (F.size(errors) >= SHORT_ERRORS)
    return F.when(short, let(let(F.transform(errors, _signed), shown), lambda t: F.when(F.length(t) < F.length(whole), t)))


def _grouped(lines: Column) -> Column:
    """A log as its patterns, worst level first: three examples of errors, warnings and other lines, one of information, none below."""
    key = lambda x: F.concat(x["level"], F.lit(":"), x["pattern"])
    keyed = F.transform(lines, lambda x: F.struct(key(x).alias("key"), x["line"].alias("line"), x["level"].alias("level")))

    def groups(rows: Column) -> Column:
        def one(k: Column) -> Column:
            own = F.filter(rows, lambda x: x["key"] == k)
            return let(own, lambda g: F.struct(g[0]["level"].alias("level"), F.size(g).alias("n"), F.transform(F.slice(g, 1, 3), lambda x: x["line"]).alias("some")))

        return F.transform(F.array_distinct(F.transform(rows, lambda x: x["key"])), one)

    def shown(g: Column) -> Column:
        bare = lambda x: F.regexp_replace(x, LEADING_STAMP, "")
        loud = F.transform(g["some"], lambda x: F.concat(F.when(g["level"] == "error", LOG_MARKS["error"]).otherwise(LOG_MARKS["warn"]), bare(x)))
        more = F.when(g["n"] > 3, F.array(F.format_string(MORE, g["n"] - 3, g["level"]))).otherwise(F.array().cast("array<string>"))
        told = F.concat(F.lit(LOG_MARKS["info"]), T.truncate_words(bare(g["some"][0]), 25, HYGIENE), F.when(g["n"] > 1, F.format_string(" [\u00d7%d]", g["n"])).otherwise(""))
        return (
            F.when(g["level"].isin("error", "warn"), F.concat(loud, more))
            .when(g["level"] == "info", F.array(told))
            .when(g["level"] == "other", F.transform(g["some"], lambda x: T.truncate_words(x, 20, HYGIENE)))
            .otherwise(F.array().cast("array<string>"))
        )

    def whole(gs: Column) -> Column:
        def of_level(k: str) -> Column:
            return F.filter(gs, lambda g: g["level"] == k)

        def told(n: Column, words: str) -> Column:
            return let(n, lambda v: F.when(v > 0, F.format_string(words, v)))

        ordered = F.flatten(F.array(*[of_level(k) for k in LEVEL_RANK]))
        count = lambda f: F.aggregate(gs, F.lit(0), lambda a, g: a + f(g))
        over = lambda level, keep: count(lambda g: F.when(g["level"] == level, F.greatest(g["n"] - keep, F.lit(0))).otherwise(0))
        left = ((over("error", 3), "%d similar errors collapsed"), (over("warn", 3), "%d similar warnings collapsed"), (over("info", 1), "%d repeated INFO collapsed"),
                (over("debug", 0) + over("other", 3), "%d DEBUG/TRACE/other lines skipped"))
        parts = F.array_compact(F.array(*[told(n, words) for n, words in left]))
        last = let(parts, lambda p: F.when(F.size(p) > 0, F.array(F.format_string(SUMMARY, F.array_join(p, ", "), F.size(lines)))).otherwise(F.array().cast("array<string>")))
        return F.array_join(F.concat(F.flatten(F.transform(ordered, shown)), last), "\n")

    return let(let(keyed, groups), whole)


def compress_log(text: Column) -> Column:
    """A short log with several errors as its error signatures, any other as its patterns with counts."""
    return let(_log_lines(text), lambda ls: F.coalesce(_short_errors(ls), _grouped(ls)))


def compress_logs(rows: DataFrame) -> DataFrame:
    """id, text: each log (id, text) compressed."""
    return rows.select("id", compress_log(F.col("text")).alias("text"))


ERROR_SIGNATURE = r"(\w*(?:Error|Exception)\b[^\n]*)"


def error_signatures(rows: DataFrame, n: int = 8) -> DataFrame:
    """id, signature, n: the commonest normalised error lines of each log."""
    hits = rows.where(T.log_level(F.col("line")) == "error").select("id", T.log_pattern(F.col("line")).alias("signature"))
    counted = hits.groupBy("id", "signature").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.col("n").desc(), "signature")
    return counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


# Records in a set are rows (id, i, key, value): record i of set id.
def long_form(rows: DataFrame, id_: str, order: list[str], columns: list[str]) -> DataFrame:
    """Columns of a table as a long record set, its records numbered in order within each id."""
    w = Window.partitionBy(id_).orderBy(*order)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.col(id_).alias("id"), F.row_number().over(w).cast("long").alias("i"), pairs.alias("p")).select("id", "i", F.inline("p"))


def constants(records: DataFrame) -> DataFrame:
    """id, key, value of keys that have one value in all records of a set of two or more."""
    n = records.groupBy("id").agg(F.countDistinct("i").alias("total"))
    per = records.where("value IS NOT NULL").groupBy("id", "key").agg(F.countDistinct("value").alias("d"), F.count("*").alias("n"), F.min("value").alias("value"))
    return per.join(n, "id").where("d = 1 AND n = total AND total > 1").select("id", "key", "value")


def distributions(records: DataFrame, keys: int = 5, values: int = 6) -> DataFrame:
    """id, key, value, n: the commonest values of the keys with fewest values (more than one, under half as many as records)."""
    counted = records.where("value IS NOT NULL").groupBy("id", "key", "value").agg(F.count("*").alias("n"))
    per = counted.groupBy("id", "key").agg(F.count("*").alias("d"), F.sum("n").alias("total")).where("d > 1 AND d < 0.5 * total")
    few = per.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "key"))).where(F.col("r") <= keys)
    top = counted.join(few.select("id", "key"), ["id", "key"])
    w = Window.partitionBy("id", "key").orderBy(F.col("n").desc(), "value")
    return top.withColumn("r", F.row_number().over(w)).where(F.col("r") <= values).select("id", "key", "value", "n")


def outliers(records: DataFrame, sigmas: float = 2.0, least: int = 5) -> DataFrame:
    """id, i, key, value beyond the mean by more than ``sigmas`` population deviations, for keys with enough numbers."""
    nums = records.withColumn("x", F.col("value").try_cast("double")).where("x IS NOT NULL")
    stats = nums.groupBy("id", "key").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n")).where(F.col("n") >= least)
    return nums.join(stats, ["id", "key"]).where((F.col("sd") > 0) & (F.abs(F.col("x") - F.col("mean")) > sigmas * F.col("sd"))).select("id", "i", "key", "value")


ERROR_KEYS = ("error", "errors", "err", "exception", "failure", "failed")
BAD_STATUS = r"(?i)^(error|failed|failure|fatal|critical|timeout|5\d\d|4\d\d)$"


def error_records(records: DataFrame, n: int = 5) -> DataFrame:
    """id, i: the first records with a filled error key or a failing status."""
    empty = F.lower(F.col("value")).isin("", "null", "none", "false", "0")
    bad = (F.lower(F.col("key")).isin(*ERROR_KEYS) & F.col("value").isNotNull() & ~empty) | (F.lower(F.col("key")).isin("status", "state", "level", "event_type") & F.col("value").rlike(BAD_STATUS))
    hits = records.where(bad).select("id", "i").distinct()
    return hits.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("i"))).where(F.col("r") <= n).select("id", "i")


def head_and_tail(records: DataFrame, apart: DataFrame, head: int = 3, tail: int = 2) -> DataFrame:
    """id, i: first and last records of each set, those in ``apart`` (id, i) left out."""
    ids = records.select("id", "i").distinct().join(apart.select("id", "i").distinct(), ["id", "i"], "left_anti")
    a, b = Window.partitionBy("id").orderBy("i"), Window.partitionBy("id").orderBy(F.col("i").desc())
    return ids.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b)).where((F.col("a") <= head) | (F.col("b") <= tail)).select("id", "i")


def json_schema(text: Column) -> Column:
    """Type description of a JSON text, null where it is none."""
    return F.schema_of_variant(F.try_parse_json(text))


#: Keys of an object that are described.
MOST_KEYS = 20


def _described(value, indent: str = "") -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return f"string ({len(value)} chars)"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, list):
        first = _described(value[0], indent + "  ") if value else "unknown"
        return f"array[{len(value)}] of {first}"
    names = list(value)
    if not names:
        return "{}"
    if len(names) > MOST_KEYS:
        return f"object with {len(names)} keys: {', '.join(names[:MOST_KEYS])}, ..."
    inner = "".join(f"{indent}  {k}: {_described(value[k], indent + '  ')}\n" for k in names)
    return f"object {{\n{inner}{indent}}}"


def describe_json(text: Column) -> Column:
    """What a JSON text holds: keys in their order and up to ``MOST_KEYS``, arrays by length and first element; null where it is none."""

    def describe(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(None if t is None else _described(json.loads(t)))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    describe.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(describe, "string")(text)


def is_record_array(text: Column, least: int = 3, share: float = 0.8) -> Column:
    """Whether a text is an array of objects that mostly have the first one's keys."""

    def alike(keys: Column) -> Column:
        near = F.filter(F.slice(keys, 2, F.size(keys)), lambda k: F.size(F.array_intersect(k, keys[0])) >= share * F.greatest(F.size(keys[0]), F.size(k)))
        return F.size(near) >= share * (F.size(keys) - 1)

    def of(items: Column) -> Column:
        objects = F.forall(items, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
        return F.when((F.size(items) >= least) & objects, let(F.transform(items, F.json_object_keys), alike)).otherwise(False)

    return F.coalesce(F.when(F.ltrim(text).startswith("["), let(F.from_json(text, "array<string>"), of)), F.lit(False))


def compress_config(text: Column) -> Column:
    """Sections and key names of a configuration text."""
    lines = F.split(text, "\n")
    section = lambda x: F.regexp_extract(x, r"^\s*(\[[^\]]+\])\s*$", 1)
    key = lambda x: F.regexp_extract(x, r"^\s*([\w.-]+)\s*[:=]", 1)
    shown = F.transform(lines, lambda x: F.when(section(x) != "", section(x)).when(key(x) != "", key(x)))
    return F.array_join(F.array_compact(shown), "\n")


def diff_files(text: Column) -> Column:
    """Array of file, added, removed of a diff; where no line names both sides, the first ``+++ b/`` names the file."""
    new = lambda name: F.array(F.struct(name.alias("file"), F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("removed")))
    sides, target = r"^diff --git a/(.*) b/(.*)", r"^\+\+\+ b/(.*)"

    def step(files: Column, x: Column) -> Column:
        last = F.element_at(files, -1)
        more = F.struct(
            last["file"].alias("file"),
            (last["added"] + (x.startswith("+") & ~x.startswith("+++")).cast("long")).alias("added"),
            (last["removed"] + (x.startswith("-") & ~x.startswith("---")).cast("long")).alias("removed"),
        )
        counted = F.concat(F.slice(files, 1, F.size(files) - 1), F.array(more))
        started = F.when(x.rlike(sides), F.concat(files, new(F.regexp_extract(x, sides, 2)))).when((F.size(files) == 0) & x.rlike(target), new(F.regexp_extract(x, target, 1)))
        return started.when((F.size(files) > 0) & x.rlike(r"^[+-]"), counted).otherwise(files)

    return F.aggregate(F.split(text, "\n"), F.array().cast("array<struct<file:string,added:bigint,removed:bigint>>"), step)


def diff_stats(rows: DataFrame) -> DataFrame:
    """id, file, added, removed of diffs (id, text)."""
    return rows.select("id", F.inline(diff_files(F.col("text"))))


def compress_diff(text: Column) -> Column:
    """Totals and one line a file; a diff that names no file stays."""
    total = lambda fs, k: F.aggregate(fs, F.lit(0).cast("long"), lambda a, f: a + f[k])

    def shown(fs: Column) -> Column:
        head = F.format_string("diff: %d files changed, +%d -%d", F.size(fs), total(fs, "added"), total(fs, "removed"))
        each = F.transform(fs, lambda f: F.format_string("  %s: +%d -%d", f["file"], f["added"], f["removed"]))
        return F.when(F.size(fs) > 0, F.array_join(F.concat(F.array(head), each), "\n")).otherwise(text)

    return let(diff_files(text), shown)


def compress_code(text: Column, n: int = 30) -> Column:
    """Declarations, imports, comments and closers; the text itself if that leaves out under 30 % of the lines."""
    keep = r"^\s*(import |from |export |def |class |function |interface |type |const |let |public |private |async |@|//|#|/\*|\*|[})\]];?\s*$)"
    return let(
        F.split(text, "\n"),
        lambda ls: let(
            F.filter(ls, lambda x: x.rlike(keep)),
            lambda kept: F.when(F.size(kept) > 0.7 * F.size(ls), text).otherwise(F.array_join(F.slice(kept, 1, n), "\n")),
        ),
    )


def compress_prose(text: Column) -> Column:
    """Under 300 words whole, up to 1000 two sentences of each end, longer the first, its entities and the last."""
    def cut(ss: Column, count: Column) -> Column:
        n = F.size(ss)
        medium = F.concat_ws(" ", F.array_join(F.slice(ss, 1, 2), " "), F.lit("[...]"), F.array_join(F.slice(ss, F.greatest(n - 1, F.lit(1)), F.lit(2)), " "))
        long = F.concat_ws(" ", ss[0], F.concat(F.lit("["), F.array_join(T.key_entities(text), ", "), F.lit("]")), F.element_at(ss, -1))
        return F.when(n <= 4, text).when(count <= 1000, medium).otherwise(long)

    return let(T.word_count(text), lambda count: F.when(count < 300, text).otherwise(let(T.sentences(text), lambda ss: cut(ss, count))))


def safe_display(original: Column, shown: Column) -> Column:
    """struct of text and reason: an excerpt instead where compression gave nothing, grew the text or lost a critical marker."""
    reason = (
        F.when(F.length(F.trim(shown)) == 0, "empty")
        .when(T.token_estimate(shown) > 1.05 * T.token_estimate(original), "inflated")
        .when(detect.loses_markers(original, shown), "marker_loss")
    )
    # without the binding the markers of both texts would be sought once for each use of the reason
    return let(reason, lambda r: F.struct(F.when(r.isNotNull(), T.truncate_words(original, 220, " ... [EXCERPT]")).otherwise(shown).alias("text"), r.alias("reason")))


def library_display(path: Column, text: Column) -> Column:
    """One line in place of library or generated code."""
    reason = detect.library_reason(path, text)
    return F.when(reason.isNotNull(), F.format_string("[library code: %s, %d tokens]", reason, T.token_estimate(text)))


def compress(rows: DataFrame, defer_over: int = 50) -> DataFrame:
    """``rows`` (id, kind, path, text) with type, shown, reason, saved and deferred: the whole chain of decisions, row by row.

    The type is found once a row and only its own compressor runs.
    """
    t = F.col("text")

    def body(kind: Column) -> Column:
        made = F.when(kind == "config", compress_config(t)).when(kind == "code", compress_code(t)).when(kind == "json", json_schema(t))
        return made.when(kind == "log", compress_log(t)).when(kind == "diff", compress_diff(t)).otherwise(compress_prose(t))

    def settled(kind: Column) -> Column:
        result = lambda d: F.struct(kind.alias("type"), d["text"].alias("shown"), d["reason"].alias("reason"))
        return let(F.coalesce(body(kind), t), lambda shown: let(safe_display(t, shown), result))

    guard = library_display(F.col("path"), t)
    library = lambda g, kind: F.struct(kind.alias("type"), g.alias("shown"), F.lit("library").alias("reason"))
    both = let(content_type_for_kind(t, F.col("kind")), lambda kind: let(guard, lambda g: F.when(g.isNotNull(), library(g, kind)).otherwise(settled(kind))))
    done = rows.withColumn("_d", both)
    out = done.select(*rows.columns, "_d.type", "_d.shown", "_d.reason")
    saved = F.greatest(T.token_estimate(t) - T.token_estimate(F.col("shown")), F.lit(0))
    return out.withColumn("saved", saved).withColumn("deferred", F.col("saved") > defer_over)


def retrieval_table(compressed: DataFrame) -> DataFrame:
    """id, text of deferred records: join it by id to restore them."""
    return compressed.where("deferred").select("id", "text")


def retrieval_waste(fetches: DataFrame, compressed: DataFrame) -> DataFrame:
    """id, fetches, wasted: compressed records that were fetched in full again (id, tokens), and the tokens of it."""
    n = fetches.groupBy("id").agg(F.count("*").alias("fetches"))
    return n.join(compressed, "id").select("id", "fetches", (F.col("fetches") * F.col("tokens")).alias("wasted"))


# Keys and values that tell of errors, keys that hold a status, and sizes of the summary of a record array.
ERROR_KEY, ERROR_VALUE = r"(?i)error|warning|exception|fail|alert", r"(?i)error|fail|critical|exception|timeout|denied|rejected"
STATUS_KEYS = ("status", "state", "result", "level")
SHOWN_KEYS, SHOWN_VALUES, SHOWN_ANOMALIES, LONG_VALUE = 5, 6, 5, 60


def json_records(rows: DataFrame) -> DataFrame:
    """id, field, n, i, pos, key, kind, json, value: a row a value of each JSON text (id, text) that is an array of records.

    Of an object the largest such array is taken, the first of equals, and ``field`` names it (empty for
    the text itself). ``kind`` is null, string, number, boolean, array or object.
    """
    entry = lambda pos, field, body: F.struct((-F.size(F.from_json(body, "array<string>"))).alias("n"), pos.alias("pos"), field.alias("field"), body.alias("body"))
    inside = F.filter(F.map_entries(F.from_json("text", "map<string,string>")), lambda e: is_record_array(e["value"]))
    found = F.when(is_record_array(F.col("text")), F.array(entry(F.lit(0), F.lit(""), F.col("text")))).otherwise(F.transform(inside, lambda e, i: entry(i, e["key"], e["value"])))
    arrays = rows.select("id", F.try_element_at(F.array_sort(found), F.lit(1)).alias("a")).where("a IS NOT NULL")
    items = arrays.select("id", "a.field", (-F.col("a.n")).alias("n"), F.posexplode(F.from_json("a.body", "array<string>")).alias("i", "item"))
    values = items.select("id", "field", "n", "i", F.posexplode(F.map_entries(F.from_json("item", "map<string,variant>"))).alias("pos", "e")).select("id", "field", "n", "i", "pos", "e.key", F.col("e.value").alias("v"))
    told = F.schema_of_variant("v")
    kind = F.when(F.col("v").isNull() | (told == "VOID"), "null").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean")
    kind = kind.when(told.startswith("ARRAY"), "array").when(told.startswith("OBJECT"), "object").otherwise("number")
    text = lambda c: F.coalesce(c, F.lit("null"))
    return values.select("id", "field", "n", "i", "pos", "key", kind.alias("kind"), text(F.to_json("v")).alias("json"), text(F.try_variant_get("v", "$", "string")).alias("value"))


def _anomalies(records: DataFrame) -> DataFrame:
    """id, i, reason, r: the first rows with a filled error field or a failing status, then numbers beyond two deviations."""
    filled = ~F.col("kind").isin("null") & ~F.col("json").isin("false", "0", "0.0", '""')
    status = F.when(F.col("kind") == "string", F.array_position(F.array(*[F.lit(k) for k in STATUS_KEYS]), F.col("key"))).otherwise(0)
    error = F.struct(F.lit(0).alias("phase"), F.lit(0).alias("of"), F.lit(0).alias("rule"), F.col("pos").cast("int").alias("at"), F.concat("key", F.lit(" is non-empty: "), F.substring("value", 1, 80)).alias("reason"))
    bad = F.struct(F.lit(0).alias("phase"), F.lit(0).alias("of"), F.lit(1).alias("rule"), status.cast("int").alias("at"), F.concat_ws("=", "key", "value").alias("reason"))
    marked = F.when(F.col("key").rlike(ERROR_KEY) & filled, error).when((status > 0) & F.col("value").rlike(ERROR_VALUE), bad)
    first = records.where("i = 0").select("id", "key", F.col("pos").alias("place"))
    nums = records.where("kind = 'number'").select("id", "i", "key", "value", F.col("value").try_cast("double").alias("x"))
    stats = nums.groupBy("id", "key").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.count("x").alias("m")).where("m >= 5 AND sd > 0").join(first, ["id", "key"])
    far = nums.join(stats, ["id", "key"]).where("abs(x - mean) > 2 * sd")
    told = F.format_string("%s=%s is outlier (mean=%.1f, σ=%.1f)", "key", "value", "mean", "sd")
    outlier = F.struct(F.lit(1).alias("phase"), F.col("place").cast("int").alias("of"), F.lit(0).alias("rule"), F.lit(0).alias("at"), told.alias("reason"))
    every = records.select("id", "i", marked.alias("m")).where("m IS NOT NULL").unionByName(far.select("id", "i", outlier.alias("m")))
    one = every.groupBy("id", "i").agg(F.min("m").alias("m"))
    w = Window.partitionBy("id").orderBy("m.phase", "m.of", "i")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SHOWN_ANOMALIES).select("id", "i", "m.reason", "r")


def summarize_json(rows: DataFrame) -> DataFrame:
    """id, text: JSON texts (id, text) that are or hold an array of records as a summary of it; other texts give no row.

    Schema, constants, distributions of keys with few values (absent ones count as undefined, last among
    equals), anomalies with their reasons, the first and the last other row. Every line is cut from
    grouped rows, so only these lines of a text come together.
    """
    records = keep(json_records(rows), "json-records")
    first = records.where("i = 0").select("id", "key", F.col("pos").alias("place"), F.col("kind").alias("first_kind"))
    plain = ~F.col("kind").isin("array", "object")
    counted = records.groupBy("id", "key", "json").agg(F.first("value").alias("value"), F.first("n").alias("n"), F.count("*").alias("times"), F.min("i").alias("at"), F.max((~plain).cast("int")).alias("deep"))
    per = counted.groupBy("id", "key").agg(F.first("n").alias("n"), F.sum("times").alias("held"), F.count("*").alias("d"), F.max("deep").alias("deep"), F.min("json").alias("json"))
    per = per.join(first, ["id", "key"]).where("deep = 0")
    constant = (F.col("d") == 1) & (F.col("held") == F.col("n"))
    absent = (F.col("held") < F.col("n")).cast("int")
    few = per.where(~constant).withColumn("d", F.col("d") + absent).where("d > 1 AND d < 0.5 * n")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("d", "place"))).where(F.col("k") <= SHOWN_KEYS)
    some = counted.select("id", "key", "value", "times", "at").join(few.select("id", "key", "k"), ["id", "key"])
    some = some.unionByName(few.where("held < n").select("id", "key", F.lit("undefined").alias("value"), (F.col("n") - F.col("held")).alias("times"), F.col("n").alias("at"), "k"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.col("times").desc(), "at"))).where(F.col("r") <= SHOWN_VALUES)
    joined = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), ", ")
    line = lambda df, section, place, text: df.select("id", F.lit(section).alias("section"), place.cast("int").alias("place"), text.alias("line"))

    schema = records.where("i = 0").groupBy("id").agg(F.first("n").alias("n"), joined("pos", F.concat_ws(": ", "key", "kind")).alias("s"))
    same = per.where(constant).groupBy("id").agg(joined("place", F.concat_ws(": ", "key", "json")).alias("s"))
    spread_ = some.groupBy("id", "key", "k").agg(joined("r", F.format_string('"%s"×%d', "value", "times")).alias("s"))
    odd = keep(_anomalies(records), "json-anomalies")
    rest = records.select("id", "i").distinct().join(odd.select("id", "i"), ["id", "i"], "left_anti").groupBy("id").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    ends = rest.select("id", F.explode(F.array_distinct(F.array(F.struct(F.col("a").alias("i")), F.struct(F.col("b").alias("i"))))).alias("e"), "a").select("id", "e.i", (F.col("e.i") == F.col("a")).alias("head"))
    wanted = odd.select("id", "i").unionByName(ends.select("id", "i"))
    cut = F.when((F.col("kind") == "string") & (F.length("value") > LONG_VALUE), F.concat(F.lit('"'), F.substring("value", 1, LONG_VALUE - 3), F.lit('..."'))).otherwise(F.col("json"))
    shown = records.join(wanted, ["id", "i"], "left_semi").groupBy("id", "i").agg(joined("pos", F.concat_ws(": ", F.col("key"), cut)).alias("s"))
    bad, rows_ = odd.join(shown, ["id", "i"]), ends.join(shown, ["id", "i"])
    lines = [
        line(schema, 0, F.lit(0), F.format_string("array[%d] of { %s }", "n", "s")),
        line(same, 1, F.lit(0), F.format_string("  constants: { %s }", "s")),
        line(spread_, 2, F.col("k"), F.format_string("  distribution: { %s: %s }", "key", "s")),
        line(odd.select("id").distinct(), 3, F.lit(0), F.lit("  anomalies:")),
        line(bad, 3, F.col("r"), F.format_string("    row[%d]: { %s }\n      reason: %s", "i", "s", "reason")),
        line(rows_, 4, (~F.col("head")).cast("int"), F.concat(F.when(F.col("head"), "  head[").otherwise("  tail["), F.col("i"), F.lit("]: { "), F.col("s"), F.lit(" }"))),
    ]
    body = reduce(DataFrame.unionByName, lines).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    named = body.join(records.where("i = 0 AND pos = 0").select("id", "field"), "id").join(rows.select("id", "text"), "id")
    others = F.filter(F.map_entries(F.from_json("text", "map<string,string>")), lambda e: e["key"] != F.col("field"))
    around = F.transform(others, lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(json_schema(e["value"]), F.lit("STRING"))))
    whole = F.array_join(F.concat(F.array(F.lit("object {")), around, F.array(F.concat(F.lit("  "), F.col("field"), F.lit(": "), F.col("body")), F.lit("}"))), "\n")
    return named.select("id", F.when(F.col("field") == "", F.col("body")).otherwise(whole).alias("text"))
