"""Structured Streaming jobs. Each has a batch twin in the operators; tests replay a table and compare.

Every job takes a streaming (or batch) DataFrame of events and returns the transformed one, so the
caller chooses source, sink and trigger. State is keyed and bounded by watermarks or timeouts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from loam.functions import text as T
from loam.operators import folds, lifecycle
from loam.plans import ordered
from loam.plans.bucketed import Bucketed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def normalize_events(events: DataFrame) -> DataFrame:
    """Envelope of raw events: redacted and cut payload, hash, kind, risk signals, whether review is needed."""
    shown = T.redact_event_text(F.coalesce("props", F.lit("")))
    cut = T.truncate_words(shown["text"], 180, " ... [TRUNCATED_HOOK_PAYLOAD]")
    kind = F.when(F.col("event_type") == "error", "mistake").when(F.col("event_type") == "signup", "decision").otherwise("fact")
    rows = events.select("event_id", "ts", "user_id", "event_type", "value", shown["redacted"].alias("redacted"), cut.alias("payload"), kind.alias("kind"))
    rows = rows.withColumn("hash", F.sha2(F.concat_ws("|", "event_type", "user_id", "payload"), 256))
    signals = F.array_compact(F.array(F.when(F.col("redacted"), F.lit("secret")), F.when(F.col("event_type") == "error", F.lit("failure")), F.when(F.col("value") > 40, F.lit("large"))))
    return rows.withColumn("signals", F.array_join(signals, ",")).withColumn("review", F.size(signals) > 0)


def first_events(envelopes: DataFrame, late: str = "30 days") -> DataFrame:
    """The first event of each payload hash; duplicates later than the watermark count as new."""
    if envelopes.isStreaming:
        return envelopes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])
    return envelopes.dropDuplicates(["hash"])


def quiet_batches(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: bursts of changes per key, closed after a quiet gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_states(events: DataFrame) -> DataFrame:
    """user_id, state, continuously; read it in update mode."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


GOOD = ("purchase", "signup", "view")


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, mode: str, late: str) -> DataFrame:
    """Rows (with ``ts``) through a processor with event-time timers, whose state lives in RocksDB beside the executors."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = rows.withWatermark("ts", late).groupBy(key)
    return grouped.transformWithStateInPandas(processor, out, mode, "EventTime")


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[us]").astype(np.int64)


class _Timed(StatefulProcessor):
    """Keeps one value a key, and drops it when event time has passed ``stays`` microseconds beyond the key's last row."""

    fields: str

    def __init__(self, stays: int):
        self.stays = stays

    def init(self, handle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.fields)

    def put(self, value: tuple, last: int) -> None:
        self.value.update(value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(last + self.stays) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Feedback(_Timed):
    fields = "state int, n long"

    def __init__(self, stays: int):
        super().__init__(stays)
        self.machine = folds.feedback_table(lifecycle.GAIN, lifecycle.LOSS, lifecycle.KEEP, lifecycle.STEP)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, n = tuple(self.value.get()) if self.value.exists() else (self.machine.start, 0)
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        good = own["event_type"].isin(GOOD).to_numpy().astype(np.int64)
        after = self.machine.number(self.machine.enter(int(state).to_bytes(4, "little"), self.machine.run(good)))
        self.put((after, n + len(own)), int(_micros(own["ts"])[-1]))
        yield pd.DataFrame({"user_id": [key[0]], "score": [(after - 1000) / 1000], "n": [n + len(own)]})


def running_feedback(events: DataFrame, late: str = "1 hour", idle_days: int = 365) -> DataFrame:
    """user_id, score, n after each batch: the feedback fold as keyed state, dropped when a key is idle for ``idle_days``.

    Within a batch events are folded by (ts, event_id); a batch must not hold events older than the last.
    """
    rows = events.select("user_id", "ts", "event_id", "event_type")
    return _keyed(rows, "user_id", _Feedback(idle_days * 86_400_000_000), "user_id long, score double, n long", "Update", late)


class _Bursts(_Timed):
    fields = "level long, last long"

    def __init__(self, machine: folds.Bucket):
        super().__init__(machine.capacity)  # by then the bucket is full again: the state says nothing
        self.machine = machine

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.dumps([int(x) for x in self.value.get()]).encode() if self.value.exists() else None
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        times = _micros(own["ts"])
        told = self.machine.walk(state, times)
        level, last = json.loads(self.machine.enter(state, self.machine.run(times)))
        self.put((level, last), last)
        yield own[["event_id"]].reset_index(drop=True).assign(user_id=key[0], **told)


def _bucket(capacity: int, refill_us: int) -> folds.Bucket:
    return folds.Bucket(capacity * refill_us, refill_us)


CAPACITY, REFILL_US = 3, 7_200_000_000


def bursts(events: DataFrame, capacity: int = CAPACITY, refill_us: int = REFILL_US, late: str = "1 hour") -> DataFrame:
    """event_id, user_id, allowed, remaining, retry_after_us: token bucket per key over event time, a token each ``refill_us``.

    A key's state falls when its bucket would be full again.
    """
    return _keyed(events.select("user_id", "ts", "event_id"), "user_id", _Bursts(_bucket(capacity, refill_us)), f"event_id long, user_id long, {folds.Bucket.outputs}", "Append", late)


def bursts_batch(events: DataFrame, capacity: int = CAPACITY, refill_us: int = REFILL_US) -> DataFrame:
    """Batch twin of ``bursts``: the same machine over runs of a key's events."""
    out = ordered.scan(events, "user_id", ["ts", "event_id"], {"_us": F.unix_micros("ts")}, _bucket(capacity, refill_us))
    return out.select("event_id", "user_id", "allowed", "remaining", "retry_after_us")


class _Idle(_Timed):
    fields = "ids array<string>, turns array<long>"

    def __init__(self, idle: int, stays: int):
        super().__init__(stays)
        self.idle = idle

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids, turns = (list(x) for x in self.value.get()) if self.value.exists() else ([], [])
        last, end = dict(zip(ids, turns, strict=True)), 0
        for pdf in rows:
            end = max(end, int(_micros(pdf["ts"]).max()))
            for i, turn in pdf.groupby("id")["turn"].max().items():
                last[i] = max(int(turn), last.get(i, int(turn)))
        now = max(last.values())
        # what is idle is told once and forgotten; a later reference makes it new
        gone = {i: t for i, t in last.items() if now - t >= self.idle}
        stays = {i: t for i, t in last.items() if i not in gone}
        self.put((list(stays), list(stays.values())), end)
        yield pd.DataFrame([(key[0], i, t, now - t) for i, t in gone.items()], columns=["session", "id", "last", "idle"])


def idle_expiry(refs: DataFrame, idle: int = 3, late: str = "1 hour", closed_days: int = 7) -> DataFrame:
    """session, id, last, idle of streamed references (session, id, turn, ts): each detail when no reference came for ``idle`` turns.

    A session without references for ``closed_days`` is closed and its state dropped.
    """
    rows = refs.select("session", "id", "turn", "ts")
    return _keyed(rows, "session", _Idle(idle, closed_days * 86_400_000_000), "session long, id string, last long, idle long", "Append", late)


def upsert_sink(path: str, keys: list[str], buckets: int = 16):
    """foreachBatch function that folds each batch into a bucketed table, one row a key.

    Only the buckets that hold keys of the batch are rewritten; a replayed batch changes nothing; versions that no
    later one needs are removed.
    """
    from loam.operators.records import upsert

    def sink(batch: DataFrame, epoch: int) -> None:
        try:
            stored = Bucketed(batch.sparkSession, path)
        except FileNotFoundError:
            stored = Bucketed.create(batch.limit(0), path, keys, buckets)
        stored.upsert(batch, lambda old, new: upsert(old, new, keys), epoch)
        stored.vacuum()

    return sink
