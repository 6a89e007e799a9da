"""One thin query per training-data operator, with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.binding import let
from loam.llm import chat, decontam, jaccard, langid, mixing, periods, pii, quality, ranked, repeats, secrets, topk, urlfilter
from loam.plans.materialize import spread
from loam.sources.tables import table


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("m")
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return quality.quality_report(docs).select(
        "doc_id",
        *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        (~base & F.col("failed_rule").isNull()).alias("kept"),
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, spans = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.taken_words(placed, spans).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", F.col("page_id") * 7919 % 365)
    out = urlfilter.url_filter(captures, urlfilter.entries_from_pages(pages))
    return out.select("page_id", "host", "fetch_day", "n_active", "listed", "category")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    chats = chat.format_chats(chat.linear_replies(rows.unionByName(extra)))
    return chats.select(F.col("tree").alias("conv_id"), chat.digest("formatted", "loss").alias("d")).select("conv_id", "d.*")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("findings", lambda s: s["kind"] != "cnn")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("findings")).alias("spans"), count("cnn"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(spans, ",")
    base = F.transform("pii.base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    terms = F.transform("pii.terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["stop"]))
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, terms)).alias("spans"),
        F.size("pii.terms").cast("long").alias("n_term"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs.where(~F.col("held_out")))
    found = langid.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("repeats")
    return found.select("doc_id", r["n_bytes"].alias("n_bytes"), r["n_removed"].alias("n_removed"), F.size(r["removed"]).cast("long").alias("n_spans"), r["kept_sha256"].alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def _cycled(text: Column, doc_id: Column) -> Column:
    """The contract's planted texts: of every tenth document by checksum the words from a on repeat with period p."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(words, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(quality.words_of(text), repeated)).otherwise(text)


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periods.periodic_runs(docs.select("doc_id", _cycled(F.col("text"), F.col("doc_id")).alias("text")))
    best = periods.longest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(periods.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.ranked_search(table(spark, sf_dir, "benchmark").select("item_id", "text"), docs, 10)


QUERIES = {
    "op1_mix": op1_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_chat": op4_chat,
    "op5_secrets": op5_secrets,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_repeats": op9_repeats,
    "op10_jaccard": op10_jaccard,
    "op11_topk": op11_topk,
    "op12_periods": op12_periods,
    "op13_search": op13_search,
}

ORACLE = {
    "op13_search": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, nn),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op11_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2
           + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    "op3_url_filter": r"""
WITH p AS (
  SELECT page_id, page_id * 7919 % 365 AS fetch_day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1) AS seg
  FROM pages),
n AS (
  SELECT DISTINCT 'h' AS kind, host AS name FROM p
  UNION SELECT 's', array_to_string(string_split(host, '.')[-3:], '.') FROM p
  UNION SELECT 'p', host || '/' || seg FROM p),
a AS (SELECT *, ('0x' || md5(name)[1:2])::BIGINT AS a FROM n WHERE name <> ''),
entries AS (
  SELECT 'd:' || name AS key, a % 90 AS day, 'add' AS action, 'spam' AS category FROM a WHERE kind = 'h' AND a % 4 = 0
  UNION ALL SELECT 'd:' || name, a % 60 + 120, 'remove', 'spam' FROM a WHERE kind = 'h' AND a % 4 = 0
  UNION ALL SELECT 'd:' || name, a % 60 + 40, 'add', 'malware' FROM a WHERE kind = 'h' AND a % 8 = 0
  UNION ALL SELECT 'd:' || name, a % 90, 'add', 'fraud' FROM a WHERE kind = 'h' AND a % 8 = 0
  UNION ALL SELECT 'd:' || name, 300, 'remove', 'malware' FROM a WHERE kind = 'h' AND a % 8 = 0
  UNION ALL SELECT 'd:' || name, 30, 'add', 'adult' FROM a WHERE kind = 's' AND a % 16 = 1
  UNION ALL SELECT 'd:' || name, 200, 'remove', 'adult' FROM a WHERE kind = 's' AND a % 16 = 1
  UNION ALL SELECT 'p:' || name, a, 'add', 'tracker' FROM a WHERE kind = 'p' AND a % 8 = 2),
best AS (
  SELECT key, category, day, max(action) AS action FROM entries GROUP BY key, category, day),
iv AS (
  SELECT * FROM (
    SELECT key, category, day AS from_day, lead(day) OVER (PARTITION BY key, category ORDER BY day) AS to_day, action FROM best)
  WHERE action = 'add'),
k AS (
  SELECT page_id, fetch_day, host, 'd:' || array_to_string(l[i:], '.') AS key, len(l) - i + 1 AS depth
  FROM (SELECT *, string_split(host, '.') AS l, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM p)
  UNION ALL
  SELECT page_id, fetch_day, host, 'p:' || host || '/' || seg, len(string_split(host, '.')) + 1 FROM p),
hits AS (
  SELECT page_id, count(*) AS n_active, max_by(category, (depth, category)) AS category
  FROM k JOIN iv ON k.key = iv.key AND fetch_day >= from_day AND (to_day IS NULL OR fetch_day < to_day)
  GROUP BY page_id)
SELECT p.page_id, host, fetch_day, coalesce(n_active, 0)::BIGINT AS n_active, n_active IS NOT NULL AS listed, category
FROM p LEFT JOIN hits USING (page_id)""",
    "op1_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '-')) AS d1, md5(coalesce(text, '')) AS d2
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ix FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(ix % 3 + 1)::INT]::DOUBLE AS wt, 2.0 * z AS cap, 1.5 * sum(z) OVER () AS budget FROM s),
r AS (
  SELECT *, row_number() OVER o AS rn,
         (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(wt) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM w WINDOW o AS (ORDER BY cap / wt, ix)),
lam AS (SELECT min_by(lam, rn) AS lam FROM r WHERE lam <= cap / wt),
t AS (
  SELECT r.source, z, least(cap, coalesce(lam.lam * wt, cap))::DOUBLE AS target,
         greatest(ceil(z / 256.0), 1)::BIGINT AS blocks, md5(coalesce(r.source, '-')) AS k
  FROM r, lam),
q AS (
  SELECT *, CASE WHEN z > 0 THEN floor(floor(target + 0.5) / z) ELSE 0 END::BIGINT AS passes,
         [2147483647, 2147483629, 2147483587, 2147483579][(('0x' || k[1:2])::BIGINT % 4 + 1)::INT]::BIGINT % blocks AS mul,
         ('0x' || k[3:9])::BIGINT % blocks AS ad
  FROM t),
p AS (
  SELECT *, (floor(target + 0.5) - passes * z)::BIGINT AS rest, (mul * (blocks - 1) + ad) % blocks AS short_at,
         blocks * 256 - z AS short_by
  FROM q),
placed AS (
  SELECT d.doc_id, d.size, p.*, coalesce(sum(d.size) OVER (
           PARTITION BY d.source ORDER BY d1, d2, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
         row_number() OVER () AS rid
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, unnest(range(pos // 256, (pos + size - 1) // 256 + 1)) AS b FROM placed WHERE size > 0),
c AS (
  SELECT *, (mul * b + ad) % blocks AS j,
         CASE WHEN b = blocks - 1 THEN 256 - short_by ELSE 256 END AS len FROM b),
e AS (
  SELECT rid, passes * (least((b + 1) * 256, pos + size) - greatest(b * 256, pos))
         + greatest(0, least(b * 256 + greatest(least(rest - (j * 256 - CASE WHEN j > short_at THEN short_by ELSE 0 END), len), 0),
                             pos + size) - greatest(b * 256, pos)) AS n
  FROM c),
g AS (SELECT rid, sum(n)::BIGINT AS taken FROM e GROUP BY rid)
SELECT doc_id, size, z AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN g USING (rid)""",
    "op7_quality": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS bangs, (length(t) - length(translate(t, '0123456789', '')))::BIGINT AS digits
  FROM d LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * bangs > 60 * n_words OR word_chars > 40 * n_words OR 100 * digits > 50 * word_chars) AS kept
FROM m"""
}
