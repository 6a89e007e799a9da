"""Whole pipelines and the surfaces around them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import detect as D
from loam.functions import scoring as S
from loam.functions import text as T
from loam.functions import udfs
from loam.operators import content, context, dedup, evaluate, governance, index, lifecycle, mining, packing, search
from loam.operators import records as R
from loam.plans.materialize import keep, shared_dir
from loam.registry.base import query
from loam.registry.search import BM25_SQL, KNN_SQL, PAIR_SQL, bm25, knn
from loam.registry.jobs import FAIL_SQL
from loam.registry.text import P, W, first_sql, phrased
from loam.schemas import EPOCH, KIND_RISK, RISK_ORDER, case_sql, pick
from loam.sources import code, transcripts

RISK = case_sql(KIND_RISK, "kind")
RANK = case_sql(RISK_ORDER, f"({RISK})")


def now():
    """The clock is always an argument: 30 days after the records' first."""
    return F.lit(EPOCH + 3600 * 24 * 30)



def asked(t):
    return t.benchmark.select(F.col("item_id").alias("query"), "text")


@query()
def ret10_recall_pipeline(t):
    return context.recall(asked(t), t.records.where("status = 'active'"), now(), 5).select("query", "id", "score", "rank", "reasons")


@query()
def ret10_hybrid_recall(t):
    edges = t.lineitem.select(F.col("l_orderkey").alias("id"))
    return context.recall(asked(t), t.records.where("status = 'active'"), now(), 5, mode="hybrid", edges=edges).select("query", "id", "score", "rank", "reasons")


@query()
def ret11_recall_with_links(t):
    linked = t.lineitem.where("l_partkey < 50").select(F.col("l_orderkey").alias("id"))
    return context.recall(asked(t), t.records.where("status = 'active'"), now(), 5, linked).select("query", "id", "rank")


@query("""WITH h AS (SELECT conv_id AS id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role <> 'system' GROUP BY conv_id HAVING count(*) > 2)
SELECT id, length(text) AS n FROM h""")
def ret14_session_history(t):
    turns = t.conversations.where("role <> 'system'").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    rows = turns.where(F.size("ts") > 2).select("id", F.array_join(F.transform("ts", lambda x: x["text"]), " ").alias("text"))
    return rows.select("id", F.length("text").cast("long").alias("n"))


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(lower(text), ''), lambda c: c >= 'a' AND c <= 'z' AND length(c) = 1 AND ascii(c) BETWEEN 97 AND 122) AS cs FROM documents)
SELECT doc_id, floor(CASE WHEN len(cs) > 0 THEN len(list_filter(cs, lambda c: c = 'e')) / len(cs)::DOUBLE ELSE 0 END * 1e4 + 0.5) / 1e4 AS e FROM l""")
def ret15_registered_embedder(t):
    rows = udfs.embed(t.documents.select("doc_id", "text"), "letters")
    return rows.select("doc_id", S.half_up(F.get("vec", F.lit(4)), 4).alias("e"))


@query("SELECT a.vec_id AS a, floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def udf1_sql_cosine(t):
    udfs.register_sql(t.spark)
    t.embeddings.createOrReplaceTempView("loam_vectors")
    return t.spark.sql(
        "SELECT a.vec_id AS a, floor(cosine_similarity(cast(a.embedding AS ARRAY<DOUBLE>), cast(b.embedding AS ARRAY<DOUBLE>)) * 1e6 + 0.5) / 1e6 AS c "
        "FROM loam_vectors a JOIN loam_vectors b ON b.vec_id = a.vec_id + 1"
    )


@query()
def udtf1_chunks(t):
    udfs.register_chunks(t.spark)
    t.documents.createOrReplaceTempView("loam_texts")
    return t.spark.sql("SELECT doc_id, c.index, c.start, c.stop, c.words FROM loam_texts, LATERAL text_chunks(text, 150) c")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE text END AS shown FROM documents")
def udf3_renderers(t):
    udfs.register_renderer("loud", lambda x: F.concat(x, F.lit("!")))
    kind = F.when(F.col("doc_id") % 2 == 0, "loud").otherwise("plain")
    return t.documents.select("doc_id", udfs.render(kind, F.col("text")).alias("shown"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'v:' || value ELSE props END AS payload FROM events")
def udf4_adapters(t):
    udfs.register_adapter("view", lambda e: e.withColumn("payload", F.concat(F.lit("v:"), F.col("value").cast("string"))))
    rows = t.events.select("event_id", "value", F.col("event_type").alias("agent"), F.col("props").alias("payload"))
    return udfs.adapt(rows).select("event_id", "payload")


@query(f"WITH {KNN_SQL} SELECT query, id FROM knn WHERE rank <= 5")
def srt2_top_k(t):
    return knn(t, 5).select("query", "id")


@query(f"WITH {BM25_SQL} SELECT query, count(*) AS candidates FROM lexical WHERE rank <= 40 GROUP BY query")
def srt3_stage_sizes(t):
    return bm25(t, max(4 * 5, 40)).groupBy("query").agg(F.count("*").alias("candidates"))


@query(f"WITH {PAIR_SQL} SELECT a, b FROM pairs WHERE s >= 0.3")
def jn8_similar_pairs(t):
    return dedup.vector_pairs(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.3).select("a", "b")


@query(f"WITH {PAIR_SQL} SELECT a, b, la, lb FROM pairs WHERE s >= 0.3 AND la <> lb")
def jn9_cross_agent_pairs(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("agent"))
    return dedup.vector_pairs(rows, 0.3).where("agent_a <> agent_b").select("a", "b", F.col("agent_a").alias("la"), F.col("agent_b").alias("lb"))


@query(f"""WITH {BM25_SQL}, k AS (SELECT query, id, rank FROM lexical WHERE rank <= 20 AND id % 2 = 0)
SELECT coalesce(l.query, k.query) AS query, coalesce(l.id, k.id) AS id, l.rank AS a, k.rank AS b FROM (SELECT * FROM lexical WHERE rank <= 10) l FULL JOIN k ON k.query = l.query AND k.id = l.id""")
def jn7_ranked_lists(t):
    hits = keep(bm25(t, 20).select("query", "id", F.col("rank").cast("long").alias("rank")), "hits")  # both lists are of one search
    a = hits.where("rank <= 10").withColumnRenamed("rank", "a")
    b = hits.where("id % 2 = 0").withColumnRenamed("rank", "b")
    return a.join(b, ["query", "id"], "full_outer")


@query("SELECT d.doc_id, b.item_id, contains(d.text, b.text) AS found FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def jn12_mentions(t):
    found = search.mentions(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("phrase")), "doc_id", "item_id")
    return found.withColumn("found", F.lit(True))


@query("""WITH truth AS (SELECT b.item_id AS query, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT query, count(*) AS expected, count(*) FILTER (id % 2 = 0) AS even FROM truth GROUP BY query""")
def jn16_expected_sets(t):
    found = search.mentions(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("phrase")), "doc_id", "item_id")
    return found.groupBy(F.col("item_id").alias("query")).agg(F.count("*").alias("expected"), F.count(F.when(F.col("doc_id") % 2 == 0, 1)).alias("even"))


@query(f"""{W}, c AS (SELECT project AS query, id, (id % 40) / 40.0::DOUBLE AS s, ceil(length(text) / 4.0)::BIGINT AS tokens FROM records),
r AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM c WHERE s > 0.75 WINDOW w AS (PARTITION BY query ORDER BY s DESC, id))
SELECT query, id, place FROM (SELECT *, max(CASE WHEN place > 3 OR (used > 1000 AND place > 1) THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY place ROWS UNBOUNDED PRECEDING) AS e FROM r) WHERE e = 0""")
def ctx8_detail_selection(t):
    matches = t.records.select(F.col("project").alias("query"), "id", ((F.col("id") % 40) / 40.0).alias("similarity"))
    return context.details_of(matches, t.records).select("query", "id", F.col("place").cast("long").alias("place"))


@query(f"{W} SELECT kind, id, r FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, id) AS r FROM records WHERE {RANK} >= 3) WHERE r <= 5")
def ctx8_operational_details(t):
    return context.operational_details(t.records).select("kind", "id", F.col("r").cast("long").alias("r"))


@query("""SELECT user_id AS id, array_to_string(list(event_type ORDER BY r), ',') AS entries FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events
WHERE user_id IN (SELECT item_id FROM benchmark)) WHERE r <= 5 GROUP BY user_id""")
def ctx12_lineage(t):
    log = t.events.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("event"))
    return context.lineage(t.benchmark.select(F.col("item_id").alias("id")), log).select("id", F.array_join("entries", ",").alias("entries"))


@query(f"{P} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN {str(n in ('debugging', 'planning', 'code_review', 'refactoring')).lower()}" for n, p in D.TASK_RULES) + " ELSE false END END AS enabled FROM p")
def ctx15_evidence_gate(t):
    mode = pick(("force", "off", "auto"), F.col("doc_id") % 3)
    return phrased(t).select("doc_id", context.evidence_enabled(mode, D.task_type(F.col("x"))).alias("enabled"))


@query()
def ctx6_subqueries(t):
    spans = packing.spans(t.records.select("id", "text"))
    q = asked(t).withColumn("id", F.col("query") * 3)
    evidence = packing.select_evidence(q, spans).join(spans.select("id", "place", "span"), ["id", "place"])
    return context.subqueries(evidence)


@query()
def ctx7_semantic_rounds(t):
    e = t.embeddings
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("vec"))
    return context.semantic_rounds(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")))


@query()
def ctx13_packed_context(t):
    out = context.pack(asked(t), t.records.where("status = 'active'"), now(), evidence="force")
    return out.select("query", "task", "budget", "tokens", F.size("ids").alias("kept"), F.size("evicted").alias("evicted"), F.size("evidence").alias("evidence"), "over_budget")


@query()
def ctx14_policy_tuning(t):
    hits = keep(bm25(t, 5).select("query", "id"), "tuning-hits")
    docs = t.documents.select(F.col("doc_id").alias("id"), "text").join(hits.select("id").distinct(), "id", "left_semi")
    expected = t.benchmark.select(F.col("item_id").alias("query"), F.col("text").alias("phrase"))
    shown = hits.join(docs, "id").join(expected, "query")
    packed = shown.groupBy("query").agg(F.max(F.contains("text", "phrase").cast("double")).alias("recall"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
    chosen = hits.join(asked(t), "query")
    out = context.tune(chosen, packing.spans(docs), expected, packed, context.policy_grid(t.spark), 1000)
    return out.select("policy", S.half_up(F.col("value"), 6).alias("value"), "over_budget", "best")


@query()
def evl2_retrieval_report(t):
    truth = search.mentions(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("phrase")), "doc_id", "item_id")
    hits = context.recall(asked(t), t.records, now(), 5)
    rows = evaluate.recall(hits, truth.select(F.col("item_id").alias("query"), F.col("doc_id").alias("id")))
    return rows.agg(F.count("*").alias("cases"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))


@query()
def evl3_context_accuracy(t):
    out = None
    for tokens in (4_000, 16_000):
        packed = context.pack(asked(t), t.records, now(), tokens).select("query", F.explode("ids").alias("id"))
        truth = search.mentions(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("phrase")), "doc_id", "item_id").select(F.col("item_id").alias("query"), F.col("doc_id").alias("id"))
        row = evaluate.recall(packed.withColumn("rank", F.lit(1)), truth).agg(F.lit(tokens).alias("window"), F.avg("recall").alias("recall"))
        out = row if out is None else out.unionAll(row)
    return out


@query()
def gov5_triage(t):
    rows = t.records.select("id", "kind", "text", "confidence", F.lit("agent").alias("source"), F.lit(False).alias("requires_review"))
    merged = governance.similar_pending(rows.select("id", "kind", "text"))
    decided = governance.auto_approval(rows).join(merged.select("id", "into"), "id", "left")
    return decided.select("id", F.when(F.col("into").isNotNull(), "merged").when(F.col("approved"), "approved").otherwise("pending").alias("verdict"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN 'invalid' WHEN ['supports', 'contradicts', 'depends_on', 'derived_from', 'supersedes', 'relates_to'][(l_linenumber % 6 + 1)::INT] IN ('supersedes', 'contradicts') THEN 'pending' ELSE 'edge' END AS outcome FROM lineitem""")
def gov10_link_proposals(t):
    from loam.schemas import EDGE_RELATIONS

    relation = pick(EDGE_RELATIONS, F.col("l_linenumber") % 6)
    rows = R.constrain(t.lineitem, {"part": F.col("l_partkey") % 11 != 0})
    outcome = F.when(F.size("violations") > 0, "invalid").when(governance.link_auto_approval(relation), "edge").otherwise("pending")
    return rows.select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


@query("SELECT event_type, count(*) AS rows, min(event_id) AS first FROM events GROUP BY event_type")
def gov12_audit_trail(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"))


@query("SELECT user_id AS entity, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS history FROM events WHERE event_type <> 'view' GROUP BY user_id")
def lif4_history(t):
    rows = t.events.where("event_type <> 'view'").groupBy(F.col("user_id").alias("entity")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("es"))
    return rows.select("entity", F.array_join(F.transform("es", lambda e: e["event_type"]), ">").alias("history"))


@query("""SELECT 'record' AS what, o_orderkey AS id, NULL::BIGINT AS target FROM orders WHERE o_orderkey % 4 <> 0
UNION ALL SELECT 'edge', l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 4 <> 0 AND NOT (l_partkey % 4 = 0 AND l_partkey IN (SELECT o_orderkey FROM orders))""")
def lif6_forget(t):
    ids = t.orders.select(F.col("o_orderkey").alias("id"))
    edges = t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    left, kept = R.delete_cascade(ids, edges, ids.where("id % 4 = 0"))
    left = left.select(F.lit("record").alias("what"), "id", F.lit(None).cast("long").alias("target"))
    return left.unionByName(kept.select(F.lit("edge").alias("what"), F.col("source").alias("id"), "target"))


# Source text derived from parts: one file a type, in a language by the type's length, a class and functions in it.
FILES = (("py", "class A:", "def f{}(): # {"), ("ts", "class A { x = '}' }", "function f{}() { return 1 }"), ("go", "type A struct { }", "func f{}() { }"), ("rs", "pub struct A { }", "fn f{}() { }"))
PATH_SQL = "'src/' || replace(lower(p_type), ' ', '_') || '.' || ['py', 'ts', 'go', 'rs'][length(p_type) % 4 + 1]"


def part_sources(t):
    which = F.length("p_type") % 4
    of = lambda i: pick(tuple(f[i] for f in FILES), which)
    path = F.concat(F.lit("src/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.lit("."), of(0))
    line = F.replace(of(2), F.lit("{}"), F.col("p_partkey").cast("string"))
    rows = t.part.groupBy(path.alias("path"), of(1).alias("head")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))).alias("ls"))
    return rows.select("path", F.concat("head", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("text"))


# In Python the class has the functions below it on its own level, so each entity is one line.
@query(f"""WITH f AS (SELECT p_type, {PATH_SQL} AS path, count(*) + 1 AS lines FROM part GROUP BY ALL), l AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part)
SELECT path, 'file' AS type, NULL AS symbol, NULL AS line_no, lines AS line_end FROM f UNION ALL SELECT path, 'class', 'A', 1, 1 FROM f
UNION ALL SELECT path, 'function', 'f' || p_partkey, i + 1, i + 1 FROM l JOIN f USING (p_type) WHERE i < 200""")
def grf7_entities(t):
    return code.entities(part_sources(t)).select("path", "type", "symbol", F.col("line_no").cast("long").alias("line_no"), F.col("line_end").cast("long").alias("line_end"))


@query(f"""WITH f AS (SELECT p_type, {PATH_SQL} AS path FROM part GROUP BY ALL), l AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part)
SELECT path, 'file' AS type, NULL AS symbol FROM f WHERE length(p_type) % 3 <> 0 UNION ALL SELECT path, 'class', 'A' FROM f WHERE length(p_type) % 3 <> 0
UNION ALL SELECT path, 'function', 'f' || p_partkey FROM l JOIN f USING (p_type) WHERE i < 200 AND length(p_type) % 3 <> 0""")
def grf8_index_project(t):
    found = code.entities(part_sources(t))
    stem = F.regexp_extract("path", r"src/(.*)\.", 1)
    known = found.where(F.length(stem) % 3 == 0).select(T.entity_key(F.col("path"), F.col("type"), F.col("symbol"), F.col("line_no"), F.lit(None)).alias("key"))
    return code.new_entities(found, known).select("path", "type", "symbol")


@query("SELECT ['python', 'typescript', 'go', 'rust'][length(p_type) % 4 + 1] AS language, count(DISTINCT p_type) AS files FROM part GROUP BY 1")
def agg20_languages(t):
    return part_sources(t).groupBy(T.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


# Diff text derived from two snapshots of each supplier's parts.
@query("""SELECT l_suppkey AS id, 'p' || (l_suppkey % 7) || '.txt' AS file, count(*) FILTER (l_linenumber % 2 = 0) AS added, count(*) FILTER (l_linenumber % 2 = 1) AS removed FROM lineitem GROUP BY l_suppkey""")
def agg17_diff_stats(t):
    line = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"), F.lit("part "), F.col("l_partkey"))
    rows = t.lineitem.groupBy("l_suppkey").agg(F.collect_list(line).alias("ls"))
    name = F.concat(F.lit("p"), F.col("l_suppkey") % 7, F.lit(".txt"))
    text = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a\n+++ b\n@@ @@\n"), F.array_join("ls", "\n"))
    return content.diff_stats(rows.select(F.col("l_suppkey").alias("id"), text.alias("text")))


@query("SELECT s_suppkey AS id, '[s' || s_nationkey || ']' || chr(10) || 'name' || chr(10) || 'balance' AS keys FROM supplier")
def cmp6_config(t):
    text = F.concat(F.lit("[s"), "s_nationkey", F.lit("]\nname = "), "s_name", F.lit("\n# note\nbalance: "), F.col("s_acctbal").cast("string"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), content.compress_config(text).alias("keys"))


@query()
def cmp8_code(t):
    return part_sources(t).select("path", content.compress_code(F.concat("text", F.lit("\n    x = 1\n    y = 2\n    z = 3\n    w = 4"))).alias("shown"))


@query()
def cmp3_route_by_type(t):
    rows = t.records.select("id", "kind", F.lit(None).cast("string").alias("path"), "text")
    return content.compress(rows).groupBy("type").agg(F.count("*").alias("n"), F.sum("saved").alias("saved"))


@query()
def cmp5_record_summary(t):
    from loam.registry.jobs import record_sets

    sets = record_sets(t)
    errors, far = content.error_records(sets), content.outliers(sets).select("id", "i").distinct()
    kept = content.head_and_tail(sets, errors.unionAll(far))
    n = sets.groupBy("id").agg(F.countDistinct("i").alias("records"))
    part = lambda rows, name: rows.groupBy("id").agg(F.count("*").alias(name))
    out = n.join(part(content.constants(sets), "constants"), "id", "left").join(part(content.distributions(sets), "values"), "id", "left")
    return out.join(part(errors, "errors"), "id", "left").join(part(far, "outliers"), "id", "left").join(part(kept, "sampled"), "id", "left")


@query()
def cmp5_json_summary(t):
    record = F.struct("event_id", F.col("event_type").alias("status"), F.col("value"), (F.col("user_id") % 3).alias("tier"))
    texts = t.events.groupBy(F.col("user_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(record))).alias("text"))
    return content.summarize_json(texts)


@query()
def min6_sentence_picks(t):
    s = T.sentences(F.col("y"))
    hit = F.filter(s, lambda x: x.rlike(r"(?i)\b(missing|don't know|instead|answer)\b"))
    return phrased(t).select("doc_id", F.array_join(F.slice(hit, 1, 3), " ").alias("picked"))


@query(f"""{P}, k AS (SELECT doc_id, unnest({FAIL_SQL}) AS type, x FROM p), c AS (SELECT doc_id, type, type || ': ' || left(x, 200) AS text, {first_sql('x', D.KIND_RULES, 'fact')} AS kind, {first_sql('x', D.RISK_RULES, 'low')} AS risk FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY text, kind ORDER BY doc_id) AS r FROM c)
SELECT doc_id, kind, text, CASE WHEN risk = 'low' THEN 'record' ELSE 'proposal' END AS target, CASE WHEN risk = 'low' THEN 0.4::DOUBLE END AS confidence FROM u WHERE r = 1""")
def min8_apply_learnings(t):
    rows = phrased(t).select(F.col("doc_id").alias("session"), F.col("x").alias("line"), F.col("x").alias("context"), F.inline(D.failure_hits(F.col("x"))))
    return mining.apply_learnings(mining.corrections(rows)).select(F.col("session").alias("doc_id"), "kind", "text", "target", "confidence")


@query("""SELECT user_id AS session, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id""")
def src12_tool_calls(t):
    use = F.concat(F.lit('{"type":"tool_use","name":"Bash","input":{"command":"c'), F.col("event_id"), F.lit('"}}'))
    result = F.concat(F.lit('{"type":"tool_result","is_error":'), (F.col("event_type") == "error").cast("string"), F.lit(',"content":"r"}'))
    rows = t.events.select(F.col("user_id").alias("session"), "event_id", F.posexplode(F.array(use, result)).alias("p", "value"))
    raw = rows.select("session", (F.col("event_id") * 2 + F.col("p")).alias("at"), "value")
    calls = transcripts.tool_calls(raw)
    return calls.groupBy("session").agg(F.count("*").alias("calls"), F.count(F.when(~F.col("success"), 1)).alias("failed"))


@query("""WITH d AS (SELECT doc_id AS id, source AS project, sha256(trim(text, ' ' || chr(10))) AS hash FROM documents)
SELECT id FROM (SELECT id, project, hash, row_number() OVER (PARTITION BY project, hash ORDER BY id) AS r FROM d WHERE id % 3 <> 0) n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM d o WHERE o.id % 3 = 0 AND o.project = n.project AND o.hash = n.hash)""")
def snk6_remember_many(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("project"), T.content_hash(F.col("text")).alias("hash"))
    return R.insert_new(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), ["project", "hash"], [F.col("id")]).select("id")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(CASE WHEN doc_id % 10 = 7 THEN 'changed text' ELSE text END), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1)) AS term FROM documents WHERE doc_id % 10 <> 3)
SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term HAVING count(DISTINCT doc_id) > 10""")
def snk7_index_upkeep(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    own = index.Index.build(docs, f"{shared_dir(t.spark)}/upkeep-{uuid.uuid4().hex}")
    own.update(docs.where("id % 10 = 7").withColumn("text", F.lit("changed text")), docs.where("id % 10 = 3"), batch=0)
    return own.frequencies().select("term", "df").where("df > 10")


@query("SELECT event_type, '{\"event_type\":\"' || event_type || '\",\"n\":' || count(*) || '}' AS line FROM events GROUP BY event_type")
def snk8_report_json(t):
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return rows.select("event_type", F.to_json(F.struct("event_type", "n")).alias("line"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.file_path'), json_extract_string(props, '$.k')) AS found FROM events")
def jsn2_nested_search(t):
    v = F.try_parse_json("props")
    return t.events.select("event_id", F.coalesce(F.try_variant_get(v, "$.file_path", "string"), F.try_variant_get(v, "$.k", "string")).alias("found"))


@query()
def jsn5_structured_context(t):
    stored = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.array(F.lit("kept")).alias("decisions"))))
    parsed = F.from_json(stored, "decisions array<string>")
    derived = packing.spans(t.records.select("id", "text")).where("label = 'decision'").groupBy("id").agg(F.collect_list("span").alias("ds"))
    rows = t.records.select("id", parsed["decisions"].alias("own")).join(derived, "id", "left")
    return rows.select("id", F.size(F.coalesce("own", F.slice("ds", 1, 8), F.array().cast("array<string>"))).alias("decisions"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type IN ('purchase', 'signup', 'view') AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 0.0::DOUBLE AS s FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT f.user_id, e.i, floor(greatest(-1, least(1, f.s * 0.85 + CASE WHEN good THEN 0.2 ELSE -0.15 END * 0.15)) * 1000 + 0.5) / 1000 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, max_by(s, i) AS score, max(i) AS n FROM f GROUP BY user_id""")
def stm4_running_feedback(t):
    return lifecycle.feedback_fold(t.events, "user_id", ["ts", "event_id"], F.col("event_type").isin("purchase", "signup", "view"))


@query("""WITH n AS (SELECT user_id, max(event_id) AS now FROM events GROUP BY user_id), l AS (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY ALL)
SELECT user_id AS session, event_type AS id, now - last AS idle FROM l JOIN n USING (user_id) WHERE now - last >= 100""")
def stm8_idle_expiry(t):
    return packing.idle_details(t.events.select(F.col("user_id").alias("session"), F.col("event_type").alias("id"), F.col("event_id").alias("turn")), 100)


@query(f"""WITH c AS (SELECT id, chunk, n_words, (id * 7 + chunk * 3) % 10 / 10.0::DOUBLE AS score FROM (SELECT doc_id AS id, i AS chunk, least(150, n - i * 150) AS n_words FROM (SELECT doc_id, n, unnest(range(0, (n + 149) // 150)) AS i FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)))),
r AS (SELECT *, row_number() OVER w AS place, sum(n_words) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM c WINDOW w AS (PARTITION BY id ORDER BY score DESC, chunk))
SELECT id, chunk FROM (SELECT *, max(CASE WHEN place > 3 OR (used > 500 AND place > 1) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY place ROWS UNBOUNDED PRECEDING) AS e FROM r) WHERE e = 0""")
def win7_chunk_prefix(t):
    chunks = packing.fixed_chunks(t.documents.select(F.col("doc_id").alias("id"), "text"))
    rows = chunks.withColumn("score", (F.col("id") * 7 + F.col("chunk") * 3) % 10 / 10.0)
    return packing.greedy_prefix(rows, "id", [F.col("score").desc(), F.col("chunk")], "n_words", 3, 500).select("id", "chunk")


@query("""WITH e AS (SELECT user_id, event_id, event_type, ts FROM events) SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call FROM e""")
def win12_previous_call(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("call"))


@query("SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id), '') AS fold, max(value) AS top FROM events GROUP BY user_id")
def udaf1_ordered_fold(t):
    rows = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("es"), F.max("value").alias("top"))
    return rows.select("user_id", F.aggregate("es", F.lit(""), lambda a, e: F.concat(a, e["event_type"])).alias("fold"), "top")
