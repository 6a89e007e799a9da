"""Batch twins of the streaming jobs over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.registry.base import query
from loam.streaming import jobs


def events(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'mistake' WHEN 'signup' THEN 'decision' ELSE 'fact' END AS kind, sha256(event_type || '|' || user_id || '|' || props) AS hash,
array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'failure' END, CASE WHEN value > 40 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS signals FROM events""")
def stm1_normalize_events(t):
    return jobs.normalize_events(events(t)).select("event_id", "event_type", "kind", "hash", "signals")


@query("SELECT count(DISTINCT event_type || '|' || user_id || '|' || props) AS firsts FROM events")
def stm2_first_events(t):
    return jobs.first_events(jobs.normalize_events(events(t))).agg(F.count("*").alias("firsts"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, s""")
def stm3_quiet_batches(t):
    return jobs.quiet_batches(events(t)).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 21600000000 AS level, NULL::BIGINT AS us, false AS allowed FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, i, event_id, CASE WHEN full_ >= 7200000000 THEN full_ - 7200000000 ELSE full_ END, us, full_ >= 7200000000
FROM (SELECT e.user_id, e.i, e.event_id, e.us, least(21600000000, f.level + coalesce(e.us - f.us, 0)) AS full_ FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT event_id, user_id, allowed, CASE WHEN allowed THEN level // 7200000000 ELSE 0 END AS remaining, CASE WHEN allowed THEN 0 ELSE 7200000000 - level END AS retry_after_us FROM f WHERE i > 0""")
def stm5_bursts(t):
    return jobs.bursts_batch(events(t))


@query("""SELECT user_id, min(epoch_us(ts)) AS created_us, max_by(event_type, (ts, event_id)) AS state FROM events WHERE event_type IN ('click', 'signup') GROUP BY user_id""")
def stm6_session_upsert(t):
    from loam.operators.records import upsert

    rows = events(t).where("event_type IN ('click', 'signup')").select("user_id", F.col("ts").alias("created_at"), F.struct("ts", "event_id").alias("updated_at"), F.col("event_type").alias("state"))
    out = upsert(rows.where("updated_at.event_id < 500"), rows.where("updated_at.event_id >= 500"), ["user_id"])
    return out.select("user_id", F.unix_micros("created_at").alias("created_us"), "state")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def stm7_latest_states(t):
    return jobs.latest_states(events(t))


@query("SELECT epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY ALL")
def stm9_window_counts(t):
    out = jobs.window_counts(events(t))
    return out.select(F.unix_millis("start").alias("start_ms"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"))
