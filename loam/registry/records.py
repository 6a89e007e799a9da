"""Scans, sinks, filters, joins, aggregates, windows and sets over records."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loam.functions import scoring, text
from loam.operators import records as R
from loam.plans.bucketed import Bucketed
from loam.plans.materialize import shared_dir
from loam.registry.base import query
from loam.schemas import KIND_RISK, RECORDS_SQL, RISK_ORDER, ROLE_PERMISSIONS, case_sql, pick, risk_of, risk_rank

W = f"WITH {RECORDS_SQL}"
RISK = case_sql(KIND_RISK, "kind")
RANK = case_sql(RISK_ORDER, f"({RISK})")


@query(f"{W} SELECT id, kind, project, created_s FROM records WHERE project = 'src3' AND status = 'active' ORDER BY created_s DESC, id LIMIT 20 OFFSET 5")
def src1_recent_records(t):
    rows = t.records.where("project = 'src3' AND status = 'active'")
    return R.newest(rows, 20, 5).select("id", "kind", "project", F.unix_timestamp("created_at").alias("created_s"))


@query(f"{W} SELECT id, kind, status, sha256(text) AS digest FROM records WHERE id IN (SELECT item_id * 7 FROM benchmark)")
def src2_records_by_id(t):
    keys = t.benchmark.select((F.col("item_id") * 7).alias("id"))
    return R.by_keys(t.records, keys, ["id"]).select("id", "kind", "status", F.sha2("text", 256).alias("digest"))


@query("""SELECT doc_id AS id, sha256(text) AS hash FROM documents d
WHERE EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND o.source = d.source AND sha256(o.text) = sha256(d.text)) AND d.doc_id % 3 <> 0""")
def src3_records_by_hash(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("hash"))
    keys = rows.where("id % 3 = 0")
    return R.by_keys(rows.where("id % 3 <> 0"), keys, ["source", "hash"]).select("id", "hash")


@query("""WITH ids AS (SELECT doc_id::VARCHAR AS id FROM documents), p AS (SELECT DISTINCT (item_id * 3)::VARCHAR AS prefix FROM benchmark UNION SELECT 'x1'),
m AS (SELECT prefix, count(id) AS n, min(id) AS one FROM p LEFT JOIN ids ON starts_with(id, prefix) GROUP BY prefix)
SELECT prefix, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN one END AS id FROM m""")
def src4_resolve_prefix(t):
    prefixes = t.benchmark.select((F.col("item_id") * 3).cast("string").alias("prefix")).union(t.spark.range(1).select(F.lit("x1"))).distinct()
    return R.resolve_prefixes(prefixes, t.documents.select(F.col("doc_id").alias("id")))


@query("SELECT vec_id AS id, label, len(embedding) AS dims FROM embeddings WHERE label <> 9 AND len(embedding) > 0 AND vec_id <> 17")
def src5_records_with_vectors(t):
    rows = t.embeddings.where((F.col("label") != 9) & (F.size("embedding") > 0) & (F.col("vec_id") != 17))
    return rows.select(F.col("vec_id").alias("id"), "label", F.size("embedding").cast("long").alias("dims"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('signup', 'error') ORDER BY ts DESC, event_id LIMIT 50")
def src6_pending_proposals(t):
    return R.newest(t.events.where(F.col("event_type").isin("signup", "error")), 50, time="ts", tie="event_id").select("event_id", "user_id", "event_type")


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 5""")
def src7_recent_audit(t):
    return R.newest_per(t.events, "user_id", 5, time="ts", tie="event_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7 AND event_type = 'view' ORDER BY ts DESC, event_id LIMIT 30")
def src8_lifecycle_events(t):
    return R.newest(t.events.where("user_id = 7 AND event_type = 'view'"), 30, time="ts", tie="event_id").select("event_id", "event_type", "value")


@query("SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def src9_session_registry(t):
    return t.conversations.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.countDistinct("role").alias("roles")
    )


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_brand = 'Brand#13' ORDER BY p_type, p_size, p_partkey")
def src10_entities_of_path(t):
    return t.part.where("p_brand = 'Brand#13'").orderBy("p_type", "p_size", "p_partkey").select("p_partkey", "p_brand", "p_type", "p_size")


@query("SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations")
def src11_transcript_lines(t):
    return t.conversations.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))


@query("SELECT item_id % 10 AS file, item_id::VARCHAR AS id, text AS query, 'src' || item_id % 20 AS path FROM benchmark")
def src14_eval_cases(t):
    from loam.sources.cases import eval_cases

    case = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.array(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("open_paths")))
    files = t.benchmark.groupBy((F.col("item_id") % 10).alias("file")).agg(F.array_join(F.collect_list(case), ",").alias("l"))
    listed = F.concat(F.lit("["), "l", F.lit("]"))
    value = F.when(F.col("file") % 2 == 0, listed).otherwise(F.concat(F.lit('{"cases": '), listed, F.lit("}")))
    return eval_cases(files.select("file", value.alias("value"))).select("file", "id", "query", F.get("open_paths", F.lit(0)).alias("path"))


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 4),
b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 7 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'same' END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def src15_changed_files(t):
    d = t.documents.select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 10 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = d.where("doc_id % 10 <> 4").select("doc_id", F.sha2("text", 256).alias("h"))
    return R.snapshot_diff(old, d.where("doc_id % 10 <> 3").select("doc_id", F.sha2(changed, 256).alias("h")), ["doc_id"], "h")


@query("""WITH d AS (SELECT doc_id AS id, source, sha256(text) AS hash FROM documents)
SELECT id, source, hash FROM (SELECT *, row_number() OVER (PARTITION BY source, hash ORDER BY id) AS r FROM d WHERE id % 2 = 1) n
WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM d o WHERE o.id % 2 = 0 AND o.source = n.source AND o.hash = n.hash)""")
def snk1_insert_unique(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("hash"))
    return R.insert_new(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), ["source", "hash"], [F.col("id")])


@query(f"{W} SELECT id, CASE WHEN id % 5 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN confidence / 2 ELSE confidence END AS confidence FROM records")
def snk2_update_by_id(t):
    rows = t.records.select("id", "status", "confidence")
    changes = rows.where("id % 5 = 0").select("id", F.lit("archived").alias("status"), (F.col("confidence") / 2).alias("confidence"))
    return R.update_rows(rows, changes, "id")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS source, l_partkey + 1000000 AS target FROM lineitem)
SELECT source, count(*) AS edges FROM e WHERE source % 3 <> 0 AND (target - 1000000) % 7 <> 0 GROUP BY source""")
def snk3_delete_cascade(t):
    part = lambda key: -1 - F.col(key)  # noqa: E731  # orders have the ids from 0 on, however many there are
    edges = t.lineitem.select(F.col("l_orderkey").alias("source"), part("l_partkey").alias("target")).distinct()
    gone = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")).union(t.part.where("p_partkey % 7 = 0").select(part("p_partkey")))
    _, left = R.delete_cascade(t.orders.select(F.col("o_orderkey").alias("id")), edges, gone)
    return left.groupBy("source").agg(F.count("*").alias("edges"))


@query("""SELECT user_id, min(epoch_us(ts)) // 1000000 AS created_s, max(epoch_us(ts)) // 1000000 AS updated_s, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id""")
def snk4_session_upsert(t):
    rows = t.events.select("user_id", F.col("ts").alias("created_at"), F.struct("ts", "event_id").alias("updated_at"), F.col("event_type").alias("state"))
    stored, batch = rows.where("updated_at.event_id % 2 = 0"), rows.where("updated_at.event_id % 2 = 1")
    out = R.upsert(stored, batch, ["user_id"])
    return out.select("user_id", F.unix_timestamp("created_at").alias("created_s"), F.unix_timestamp("updated_at.ts").alias("updated_s"), "state")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 5 <> 4")
def snk5_append(t):
    """Events appended in four batches, of which the third comes twice, to a table in buckets by user; the last is never sent."""
    rows = t.events.select("event_id", "user_id", "event_type")
    log = Bucketed.create(rows.where("event_id % 5 = 0"), f"{shared_dir(t.spark)}/log-{uuid.uuid4().hex}", ["user_id"], 8)
    for batch in (1, 2, 3, 3):
        log.append(rows.where(f"event_id % 5 = {batch}"), batch)
    return Bucketed(t.spark, log.path).read()


@query("""SELECT l_orderkey, l_partkey, count(*) AS copies, bool_or(p_partkey IS NULL) AS missing FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10
GROUP BY ALL""")
def snk9_bridge_lookup(t):
    links = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("copies"))
    known = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    return links.join(known, "l_partkey", "left").select("l_orderkey", "l_partkey", "copies", F.col("known").isNull().alias("missing"))


@query("SELECT vec_id, label FROM embeddings WHERE label < 5")
def prj1_pruned_vectors(t):
    return t.embeddings.where("label < 5").select("vec_id", "label")


@query(f"{W} SELECT id, kind, {RISK} AS risk, {RANK} AS risk_rank FROM records")
def prj2_kind_risk(t):
    return t.records.select("id", "kind", risk_of(F.col("kind")).alias("risk"), risk_rank(risk_of(F.col("kind"))).alias("risk_rank"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.source_agent'), json_extract_string(props, '$.k'), event_type, 'unknown') AS agent FROM events")
def prj3_agent_of_record(t):
    key = lambda k: F.get_json_object("props", f"$.{k}")
    return t.events.select("event_id", F.coalesce(key("source_agent"), key("k"), "event_type", F.lit("unknown")).alias("agent"))


@query("""SELECT event_id, '{"agent":"a' || (user_id % 3) || '","k":"' || json_extract_string(props, '$.k') || '"}' AS stamped FROM events""")
def prj4_stamp_provenance(t):
    stamp = F.to_json(F.struct(F.concat(F.lit("a"), F.col("user_id") % 3).alias("agent"), F.get_json_object("props", "$.k").alias("k")))
    return t.events.select("event_id", stamp.alias("stamped"))


@query("SELECT doc_id, sha256(text) AS commit_id, source || '@' || left(sha256(text), 12) AS tag FROM documents")
def prj5_tag_snapshot(t):
    h = F.sha2("text", 256)
    return t.documents.select("doc_id", h.alias("commit_id"), F.concat_ws("@", "source", F.substring(h, 1, 12)).alias("tag"))


@query("""SELECT event_id, list_filter([CASE WHEN NOT event_type IN ('view', 'click', 'purchase') THEN 'type' END, CASE WHEN NOT value BETWEEN 0 AND 20 THEN 'range' END,
CASE WHEN user_id = event_id THEN 'self' END], lambda x: x IS NOT NULL).array_to_string(',') AS violations FROM events""")
def flt1_constraints(t):
    rules = {"type": F.col("event_type").isin("view", "click", "purchase"), "range": F.col("value").between(0, 20), "self": F.col("user_id") != F.col("event_id")}
    return R.constrain(t.events, rules).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT doc_id, length(text) <= 10000 AS ok FROM documents")
def flt2_text_limit(t):
    checked = R.constrain(t.documents, {"text": F.length("text") <= 10000})
    return checked.select("doc_id", (F.size("violations") == 0).alias("ok"))


@query("SELECT doc_id, strlen(text) AS bytes, strlen(text) <= 10240 AS string_ok, strlen(text) <= 15360 AS payload_ok FROM documents")
def flt3_byte_guard(t):
    n = F.octet_length("text")
    return t.documents.select("doc_id", n.cast("long").alias("bytes"), (n <= 10240).alias("string_ok"), (n <= 15360).alias("payload_ok"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1996-01-01' AND starts_with(o_orderpriority, '1')")
def flt4_expired(t):
    due = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp")) & F.col("o_orderpriority").startswith("1")
    return t.orders.where(due).select("o_orderkey")


@query(f"{W} SELECT id, confidence FROM records WHERE confidence < 0.25")
def flt5_low_confidence(t):
    return t.records.where("confidence < 0.25").select("id", "confidence")


@query(f"{W} SELECT id, visibility FROM records WHERE visibility IN ('en', 'fr')")
def flt6_visibility(t):
    return t.records.where(F.col("visibility").isin("en", "fr")).select("id", "visibility")


PERMS = " UNION ALL ".join(f"SELECT '{r}' AS role, '{p}' AS permission" for r, ps in ROLE_PERMISSIONS.items() for p in ps)


@query(f"""WITH p AS ({PERMS}), e AS (SELECT event_id, ['viewer', 'proposer', 'approver', 'admin'][(user_id % 4 + 1)::INT] AS role,
['memory:read', 'memory:propose', 'memory:approve', 'role:manage'][(event_id % 4 + 1)::INT] AS permission, ['low', 'medium', 'high', 'critical'][(event_id % 4 + 1)::INT] AS risk FROM events)
SELECT event_id, p.role IS NOT NULL AS allowed, risk = 'low' OR e.role = 'admin' OR (e.role = 'approver' AND risk IN ('medium', 'high')) AS direct FROM e LEFT JOIN p USING (role, permission)""")
def flt7_permissions(t):
    from loam.operators.governance import can_write_directly, has_permission

    role = pick(tuple(ROLE_PERMISSIONS), F.col("user_id") % 4)
    wanted = pick(("memory:read", "memory:propose", "memory:approve", "role:manage"), F.col("event_id") % 4)
    risk = pick(tuple(RISK_ORDER), F.col("event_id") % 4)
    return t.events.select("event_id", has_permission(role, wanted).alias("allowed"), can_write_directly(role, risk).alias("direct"))


@query(f"{W} SELECT id, NOT ({RISK} IN ('high', 'critical') AND project <> 'src1') AS admitted FROM records")
def flt8_direct_write_block(t):
    escalated = risk_of(F.col("kind")).isin("high", "critical")
    return t.records.select("id", (~escalated | (F.col("project") == "src1")).alias("admitted"))


@query(f"""{W} SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('R', 'A') AND {RISK} IN ('high', 'critical') THEN 'critical' ELSE {RISK} END AS risk
FROM lineitem JOIN records ON id = l_partkey % 200""")
def flt9_override_attempt(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_partkey") % 200).alias("id")).join(t.records.select("id", "kind"), "id")
    risk = risk_of(F.col("kind"))
    forced = F.col("l_returnflag").isin("R", "A") & risk.isin("high", "critical")
    return rows.select("l_orderkey", "l_linenumber", F.when(forced, "critical").otherwise(risk).alias("risk"))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, ['supports', 'contradicts', 'depends_on', 'derived_from', 'supersedes', 'relates_to'][(l_linenumber % 6 + 1)::INT] AS relation,
CASE WHEN l_partkey % 2 = 0 THEN 'why' END AS rationale FROM lineitem)
SELECT l_orderkey, l_linenumber, relation, relation IN ('contradicts', 'supersedes', 'depends_on') AND rationale IS NULL AS refused FROM e""")
def flt10_rationale_required(t):
    from loam.operators.graph import needs_rationale
    from loam.schemas import EDGE_RELATIONS

    rows = t.lineitem.withColumn("relation", pick(EDGE_RELATIONS, F.col("l_linenumber") % 6)).withColumn("rationale", F.when(F.col("l_partkey") % 2 == 0, "why"))
    return rows.select("l_orderkey", "l_linenumber", "relation", (needs_rationale(F.col("relation")) & F.col("rationale").isNull()).alias("refused"))


@query("""SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def flt17_contains(t):
    from loam.operators.search import mentions

    return mentions(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("phrase")), "doc_id", "item_id")


@query("""SELECT page_id, regexp_matches(url, '/(de|fr)/') OR NOT regexp_matches(url, '\\.(html|php|aspx)$|/[0-9]+/?$') AS ignored FROM pages""")
def flt18_ignore_rules(t):
    u = F.col("url")
    return t.pages.select("page_id", (u.rlike("/(de|fr)/") | ~u.rlike(r"\.(html|php|aspx)$|/[0-9]+/?$")).alias("ignored"))


@query(f"{W} SELECT id, confidence FROM records WHERE confidence >= 0.55 AND status = 'active'")
def flt19_min_confidence(t):
    return t.records.where("confidence >= 0.55 AND status = 'active'").select("id", "confidence")


@query(f"""{W}, p AS (SELECT id, project, (id * 17) % 1500 AS target FROM records)
SELECT p.id, target, CASE WHEN r.id IS NULL THEN 'missing' WHEN r.project <> p.project THEN 'foreign' ELSE 'ok' END AS state FROM p LEFT JOIN records r ON r.id = target""")
def flt20_tenant_check(t):
    rows = t.records.select("id", "project", (F.col("id") * 17 % 1500).alias("target"))
    known = t.records.select(F.col("id").alias("target"), F.col("project").alias("owner"))
    state = F.when(F.col("owner").isNull(), "missing").when(F.col("owner") != F.col("project"), "foreign").otherwise("ok")
    return rows.join(known, "target", "left").select("id", "target", state.alias("state"))


@query(f"{W} SELECT b.item_id, r.id, r.kind FROM benchmark b JOIN records r ON r.id = b.item_id * 3 WHERE r.status = 'active'")
def jn1_hits_to_records(t):
    hits = t.benchmark.select("item_id", (F.col("item_id") * 3).alias("id"))
    return hits.join(t.records.where("status = 'active'").select("id", "kind"), "id").select("item_id", "id", "kind")


@query("""SELECT o_orderkey, p_partkey, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_brand = 'Brand#12' AND p_size < 20""")
def jn2_records_of_path(t):
    entities = t.part.where("p_brand = 'Brand#12' AND p_size < 20").select("p_partkey")
    links = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    return links.join(entities, F.col("p_partkey") == F.col("l_partkey")).join(t.orders.select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "p_partkey", "l_quantity")


@query("""SELECT o_orderkey, l_partkey, l_discount FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT item_id + 1 FROM benchmark) ORDER BY l_discount DESC""")
def jn3_records_of_entities(t):
    ids = t.benchmark.select((F.col("item_id") + 1).alias("l_partkey"))
    links = t.lineitem.select("l_orderkey", "l_partkey", "l_discount").join(ids, "l_partkey", "left_semi")
    return links.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_discount")


@query("SELECT l_orderkey, p_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def jn4_entities_of_records(t):
    links = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return links.join(t.part.select("p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "p_partkey", "p_brand")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def jn5_semi(t):
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def jn6_anti(t):
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""WITH old AS (SELECT p_type AS path, p_partkey AS symbol, p_size AS fp FROM part WHERE p_partkey % 10 <> 4),
new AS (SELECT p_type AS path, p_partkey AS symbol, CASE WHEN p_partkey % 10 = 7 THEN p_size + 1 ELSE p_size END AS fp FROM part WHERE p_partkey % 10 <> 3)
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.path, n.path) AS path,
CASE WHEN o.fp IS NULL THEN 'added' WHEN n.fp IS NULL THEN 'deleted' WHEN o.fp <> n.fp THEN 'modified' ELSE 'same' END AS change
FROM old o FULL JOIN new n ON o.path = n.path AND o.symbol = n.symbol""")
def jn11_entity_diff(t):
    p = t.part.select(F.col("p_type").alias("path"), F.col("p_partkey").alias("symbol"), F.col("p_size").alias("fp"))
    new = p.where("symbol % 10 <> 3").withColumn("fp", F.when(F.col("symbol") % 10 == 7, F.col("fp") + 1).otherwise(F.col("fp")))
    return R.snapshot_diff(p.where("symbol % 10 <> 4"), new, ["path", "symbol"], "fp")


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_partkey, s.s_suppkey IS NULL AS missing_path, p.p_partkey IS NULL AS missing_symbol FROM l
LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s_suppkey % 10 <> 3 LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p_partkey % 10 <> 3""")
def jn13_missing_targets(t):
    links = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    paths = t.supplier.where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("path"))
    symbols = t.part.where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("symbol"))
    out = links.join(paths, "l_suppkey", "left").join(symbols, "l_partkey", "left")
    return out.select("l_orderkey", "l_partkey", F.col("path").isNull().alias("missing_path"), F.col("symbol").isNull().alias("missing_symbol"))


@query("""SELECT event_id, user_id, r.role FROM events LEFT JOIN (SELECT DISTINCT user_id AS u, ['viewer', 'proposer', 'approver', 'admin'][(user_id % 4 + 1)::INT] AS role FROM events WHERE user_id % 5 <> 0) r ON r.u = user_id""")
def jn14_votes_to_roles(t):
    roles = t.events.where("user_id % 5 <> 0").select("user_id", pick(tuple(ROLE_PERMISSIONS), F.col("user_id") % 4).alias("role")).distinct()
    return t.events.select("event_id", "user_id").join(roles, "user_id", "left").select("event_id", "user_id", "role")


@query("""WITH hits AS (SELECT item_id AS query, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40),
linked AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey < 50)
SELECT query, hits.id, CASE WHEN linked.id IS NOT NULL THEN rank - 100 ELSE rank END AS rank FROM hits LEFT JOIN linked USING (id)""")
def jn15_current_file_boost(t):
    from loam.operators.search import boost_linked

    w = Window.partitionBy("query").orderBy("id")
    hits = t.benchmark.select(F.col("item_id").alias("query"), (F.col("item_id") % 40).alias("m")).join(t.documents.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("m")), "m")
    hits = hits.withColumn("rank", F.row_number().over(w).cast("long")).select("query", "id", "rank")
    return boost_linked(hits, t.lineitem.where("l_partkey < 50").select(F.col("l_orderkey").alias("id")))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND user_id IN (SELECT item_id FROM benchmark)""")
def jn17_latest_row(t):
    latest = t.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return R.by_keys(latest, t.benchmark.select(F.col("item_id").alias("user_id")), ["user_id"]).select("user_id", "e.*")


@query(f"""{W} SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM records WHERE status = 'active' GROUP BY kind
UNION ALL SELECT 'status', status, count(*) FROM records GROUP BY status UNION ALL SELECT 'total', 'active', count(*) FROM records WHERE status = 'active'
UNION ALL SELECT 'pending', event_type, count(*) FROM events WHERE event_type = 'signup' GROUP BY event_type""")
def agg1_stats(t):
    active = t.records.where("status = 'active'")
    count = lambda rows, facet, c: rows.groupBy(c.alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")
    parts = [count(active, "kind", F.col("kind")), count(t.records, "status", F.col("status")), count(active, "total", F.lit("active")), count(t.events.where("event_type = 'signup'"), "pending", F.col("event_type"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"{W} SELECT project, count(*) AS n FROM records WHERE status = 'active' GROUP BY project ORDER BY n DESC, project")
def agg2_by_project(t):
    return t.records.where("status = 'active'").groupBy("project").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "project")


@query(f"""{W}, c AS (SELECT project, count(*) FILTER (status = 'active' AND kind = 'fact') AS n FROM records GROUP BY project), s AS (SELECT sum(n) AS total FROM c)
SELECT project, n, n = 0 AND total > 0 AS warn FROM c, s""")
def agg3_mismatch_warning(t):
    c = t.records.groupBy("project").agg(F.count(F.when((F.col("status") == "active") & (F.col("kind") == "fact"), 1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return c.select("project", "n", ((F.col("n") == 0) & (total > 0)).alias("warn"))


@query("""SELECT node, count(*) AS degree FROM (SELECT l_orderkey AS node FROM lineitem UNION ALL SELECT l_partkey + 1000000 FROM lineitem) GROUP BY node""")
def agg4_degree(t):
    from loam.operators.graph import degrees

    return degrees(t.lineitem.select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target")))


@query("""WITH e AS (SELECT l_orderkey, l_suppkey % 5 AS s, l_partkey AS ref, max(l_discount) AS c FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS n_evidence, max(c) AS confidence, array_to_string(list_sort(list_distinct(list('s' || s))), ',') AS sources FROM e GROUP BY l_orderkey""")
def agg6_merge_evidence(t):
    rows = t.lineitem.select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("source"), F.col("l_partkey").alias("reference"), F.col("l_discount").alias("confidence"))
    return R.merge_evidence(rows, "l_orderkey")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def agg7_latest_state(t):
    from loam.operators.lifecycle import latest_state

    return latest_state(t.events.select(F.col("user_id").alias("entity"), F.col("event_type").alias("state"), "ts", "event_id"), "ts", "event_id").select(F.col("entity").alias("user_id"), "state")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id < 50 GROUP BY event_type HAVING count(*) >= 3")
def agg19_batch_hints(t):
    return t.events.where("user_id < 50").groupBy("event_type").agg(F.count("*").alias("n")).where("n >= 3")


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS records, count(DISTINCT l_partkey) AS entities, count(*) AS links FROM lineitem GROUP BY l_suppkey""")
def agg25_impact_counts(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("records"), F.countDistinct("l_partkey").alias("entities"), F.count("*").alias("links"))


@query(f"""{W}, a AS (SELECT 'audit' AS part, event_id::VARCHAR AS value, 1::BIGINT AS n FROM events ORDER BY ts DESC, event_id LIMIT 20)
SELECT 'kind' AS part, kind AS value, count(*) AS n FROM records WHERE status = 'active' GROUP BY kind UNION ALL SELECT * FROM a""")
def agg26_dashboard(t):
    stats = t.records.where("status = 'active'").groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("part"), "value", "n")
    audit = R.newest(t.events, 20, time="ts", tie="event_id").select(F.lit("audit"), F.col("event_id").cast("string"), F.lit(1).cast("long"))
    return stats.unionAll(audit)


@query(f"""{W} SELECT id, kind, rank FROM (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, id) AS rank FROM records) WHERE rank <= 3""")
def win2_rank_in_kind(t):
    w = Window.partitionBy("kind").orderBy(F.col("confidence").desc(), "id")
    return t.records.select("id", "kind", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@query("""SELECT event_id FROM (SELECT event_id, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r > 1 AND ts <= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def win3_stale_pending(t):
    from loam.operators.governance import stale_pending

    rows = t.events.select("event_id", "ts", F.struct("event_type", "user_id").alias("kind"))
    return stale_pending(rows, "kind", "ts", "event_id", F.lit("2024-01-31").cast("timestamp"), 7).select("event_id")


@query("""SELECT l_orderkey, l_partkey, r FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 3""")
def win8_top_related(t):
    # the SQL leaves lines of one price and number open; settled by part, so that reruns agree. Its nulls come last
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), F.col("l_linenumber").asc_nulls_last(), "l_partkey")
    return t.lineitem.select("l_orderkey", "l_partkey", F.row_number().over(w).cast("long").alias("r")).where("r <= 3")


@query(f"""{W}, x AS (SELECT l_suppkey AS path, id, kind, created_s FROM (SELECT DISTINCT l_suppkey, l_orderkey % 1000 AS id FROM lineitem) JOIN records USING (id))
SELECT path, id, r FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY {RANK} DESC, created_s DESC, id) AS r FROM x) WHERE r <= 5""")
def win9_path_details(t):
    links = t.lineitem.select(F.col("l_suppkey").alias("path"), (F.col("l_orderkey") % 1000).alias("id")).distinct()
    rows = links.join(t.records.select("id", "kind", "created_at"), "id")
    w = Window.partitionBy("path").orderBy(risk_rank(risk_of(F.col("kind"))).desc(), F.col("created_at").desc(), "id")
    return rows.select("path", "id", F.row_number().over(w).cast("long").alias("r")).where("r <= 5")


@query("""WITH n AS (SELECT conv_id, max(turn) AS now FROM conversations GROUP BY conv_id), l AS (SELECT conv_id, role, max(turn) AS last FROM conversations GROUP BY ALL)
SELECT conv_id, role, now - last AS idle FROM l JOIN n USING (conv_id) WHERE now - last >= 3""")
def win10_idle_details(t):
    from loam.operators.packing import idle_details

    refs = t.conversations.select(F.col("conv_id").alias("session"), F.col("role").alias("id"), "turn")
    return idle_details(refs, 3).select(F.col("session").alias("conv_id"), F.col("id").alias("role"), "idle")


@query(f"{W} SELECT id, kind, confidence FROM records ORDER BY confidence DESC, id LIMIT 25 OFFSET 10")
def srt1_top_page(t):
    return t.records.orderBy(F.col("confidence").desc(), "id").offset(10).limit(25).select("id", "kind", "confidence")


@query(f"{W} SELECT id, {RANK} AS severity, len(string_split(text, chr(10))) AS reasons FROM records WHERE status = 'active' ORDER BY severity DESC, reasons DESC, created_s, id LIMIT 40")
def srt4_report_order(t):
    rows = t.records.where("status = 'active'").select("id", risk_rank(risk_of(F.col("kind"))).alias("severity"), F.size(F.split("text", "\n")).cast("long").alias("reasons"), "created_at")
    return rows.orderBy(F.col("severity").desc(), F.col("reasons").desc(), "created_at", "id").limit(40).select("id", "severity", "reasons")


@query(f"{W} SELECT id, row_number() OVER (ORDER BY {RANK}, confidence, id) AS place FROM records WHERE project = 'src2'")
def srt5_eviction_order(t):
    w = Window.partitionBy("project").orderBy(risk_rank(risk_of(F.col("kind"))), "confidence", "id")
    return t.records.where("project = 'src2'").select("id", F.row_number().over(w).cast("long").alias("place"))


@query(f"{W} SELECT kind, count(*) AS n, {RANK} AS rank FROM records GROUP BY kind ORDER BY rank DESC, kind")
def srt6_kind_order(t):
    return t.records.groupBy("kind").agg(F.count("*").alias("n")).withColumn("rank", risk_rank(risk_of(F.col("kind")))).orderBy(F.col("rank").desc(), "kind")


@query("SELECT node, sum(n) AS n FROM (SELECT l_orderkey AS node, 1 AS n FROM lineitem UNION ALL SELECT l_suppkey + 5000000, 1 FROM lineitem) GROUP BY node")
def set1_union_endpoints(t):
    both = t.lineitem.select(F.col("l_orderkey").alias("node")).unionAll(t.lineitem.select(F.col("l_suppkey") + 5000000))
    return both.groupBy("node").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS id, array_to_string(list_sort(list(l_partkey)), ',') AS links FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2 UNION ALL
SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2 AND l_orderkey % 2 = 0) GROUP BY l_orderkey""")
def set2_merge_details(t):
    from loam.operators.packing import merge_details

    per = lambda rows: rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("links"))
    merged = merge_details(per(t.lineitem.where("l_linenumber <= 2")), per(t.lineitem.where("l_linenumber >= 2 AND l_orderkey % 2 = 0")))
    return merged.select("id", F.array_join(F.transform(F.array_sort("links"), lambda x: x.cast("string")), ",").alias("links"))


@query("""SELECT vec_id AS id, max(s) AS similarity FROM (SELECT vec_id, embedding[1]::DOUBLE AS s FROM embeddings WHERE label < 6 UNION ALL SELECT vec_id, embedding[2]::DOUBLE FROM embeddings WHERE label > 3) GROUP BY vec_id""")
def set3_best_of_rounds(t):
    one = t.embeddings.where("label < 6").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("similarity"))
    two = t.embeddings.where("label > 3").select("vec_id", F.get("embedding", F.lit(1)).cast("double"))
    return one.unionAll(two).groupBy("id").agg(F.max("similarity").alias("similarity"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'error') UNION SELECT user_id, event_type FROM events WHERE value > 10")
def set4_distinct_union(t):
    e = t.events.select("user_id", "event_type", "value")
    return e.where("event_type IN ('view', 'error')").drop("value").union(e.where("value > 10").drop("value")).distinct()


@query("""SELECT 'added' AS side, p_partkey FROM (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3 EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 10 <> 4)
UNION ALL SELECT 'removed', p_partkey FROM (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 4 EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)""")
def set5_except_both_ways(t):
    old, new = t.part.where("p_partkey % 10 <> 4").select("p_partkey"), t.part.where("p_partkey % 10 <> 3").select("p_partkey")
    return new.exceptAll(old).select(F.lit("added").alias("side"), "p_partkey").unionAll(old.exceptAll(new).select(F.lit("removed"), "p_partkey"))


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS ts FROM benchmark)
SELECT doc_id, item_id, CASE WHEN len(ts) > 0 THEN floor(len(list_filter(ts, lambda x: contains(lower(text), x))) / len(ts)::DOUBLE * 1e6 + 0.5) / 1e6 ELSE 0 END AS share
FROM documents JOIN b ON item_id = doc_id // 25""")
def mth6_term_overlap(t):
    terms = t.benchmark.select("item_id", text.overlap_tokens(F.col("text")).alias("ts"))
    pairs = t.documents.select("doc_id", "text", F.floor(F.col("doc_id") / 25).alias("item_id")).join(terms, "item_id")
    return pairs.select("doc_id", "item_id", scoring.half_up(scoring.term_overlap(F.col("text"), F.col("ts")), 6).alias("share"))


TOK = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 2))"


@query(f"""WITH p AS (SELECT a.doc_id, {TOK.format('a.text')} AS x, {TOK.format('b.text')} AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, len(list_intersect(x, y)) AS shared, len(list_distinct(list_concat(x, y))) AS either,
CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE ELSE 0 END AS jaccard,
CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE ELSE 0 END AS overlap FROM p""")
def set6_token_sets(t):
    d = t.documents.select("doc_id", text.overlap_tokens(F.col("text")).alias("x"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    x, y = F.col("x"), F.col("y")
    return pairs.select(
        "doc_id", F.size(F.array_intersect(x, y)).cast("long").alias("shared"), F.size(F.array_union(x, y)).cast("long").alias("either"),
        scoring.jaccard(x, y).alias("jaccard"), scoring.overlap_coefficient(x, y).alias("overlap"),
    )


@query("""SELECT user_id, array_to_string(list_sort(list_filter(['click', 'purchase', 'signup', 'error', 'view'], lambda x: NOT list_contains(s, x))), ',') AS missing
FROM (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY user_id)""")
def set7_missing_roles(t):
    seen = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    every = F.array(*[F.lit(x) for x in ("click", "purchase", "signup", "error", "view")])
    return seen.select("user_id", F.array_join(F.array_sort(F.array_except(every, "s")), ",").alias("missing"))
