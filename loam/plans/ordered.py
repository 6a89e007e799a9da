"""Folds over the ordered rows of a key that are spread over tasks.

Rows are dealt by ranges of (key, order), so a key with half of all rows lies in half of the partitions: its history
is cut into runs. A run is summed up as what it makes of any state before it; such transitions compose, so the
runs of a key are joined in a tree of ``FAN`` at a time, and no task ever holds a key's history. Where a row's own result
is wanted, the states in front of the runs are found down the tree, and every run is walked from its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.plans.materialize import keep, small_side

#: Rows of a run, about, and runs or joined runs that are joined at once.
RUN_ROWS, FAN = 100_000, 64


class Machine(Protocol):
    """What a fold does to a state. Inputs are int64 arrays, one for each input column; transitions and states are bytes."""

    outputs: str  # DDL of what a row gets

    def run(self, *inputs: np.ndarray) -> bytes:
        """The transition of a run of rows."""

    def join(self, a: bytes, b: bytes) -> bytes:
        """The transition of a, then b."""

    def enter(self, state: bytes | None, transition: bytes) -> bytes:
        """The state after a transition; None is the state in front of a key's first row."""

    def walk(self, state: bytes | None, *inputs: np.ndarray) -> dict[str, np.ndarray]:
        """What each row of a run gets."""


def _dealt(rows: DataFrame, key: str, order: list[str], inputs: dict[str, Column], keep_: list[str]) -> tuple[DataFrame, int]:
    """Rows in ranges of (key, order), sorted, with ``run``; and the number of ranges."""
    n = rows.count()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // RUN_ROWS))
    shaped = rows.select(key, *[c for c in dict.fromkeys([*order, *keep_]) if c != key], *[v.cast("long").alias(k) for k, v in inputs.items()])
    return shaped.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("run", F.spark_partition_id()), parts


def _transitions(dealt: DataFrame, key: str, inputs: list[str], machine: Machine) -> DataFrame:
    """key, run, t, n: the transition and the rows of every run, in one pass over sorted rows."""
    kind = dealt.select(key).dtypes[0][1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple = ()
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_pydict({key: [own[0]], "run": [own[1]], "t": [machine.run(*columns)], "n": [len(columns[0])]}, schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0).with_name(key), ("run", pa.int32()), ("t", pa.binary()), ("n", pa.int64())])
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
            arrays = [batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(inputs))]
            run = batch.column(1)[0].as_py()
            for a, b in zip(cuts, cuts[1:], strict=False):
                this = (batch.column(0)[a].as_py(), run)
                if held and this != own:
                    yield flush()
                    held = []
                own = this
                held.append([x[a:b] for x in arrays])
        if held:
            yield flush()

    return dealt.select(key, "run", *inputs).mapInArrow(scan, f"`{key}` {kind}, run int, t binary, n long")


def _joined(runs: DataFrame, key: str, machine: Machine) -> DataFrame:
    """Runs joined ``FAN`` at a time."""
    kind = runs.select(key).dtypes[0][1]

    def join(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        ts = pdf["t"].tolist()
        t = ts[0]
        for other in ts[1:]:
            t = machine.join(t, other)
        return pd.DataFrame({"k": [keys[0]], "run": [keys[1]], "t": [t], "n": [pdf["n"].sum()]})

    up = runs.withColumn("up", F.floor(F.col("run") / FAN).cast("int")).groupBy(key, "up").applyInPandas(join, f"k {kind}, run int, t binary, n long")
    return up.withColumnRenamed("k", key)


def _spanning(runs: DataFrame, key: str) -> DataFrame:
    """The keys (``_span``) of several runs: two neighbouring ranges share one key at most, so there are fewer than ranges."""
    several = runs.groupBy(key).agg(F.count("*").alias("_m")).where("_m > 1").select(F.col(key).alias("_span"))
    return small_side(keep(several, "spanning"))


def fold(rows: DataFrame, key: str, order: list[str], inputs: dict[str, Column], machine: Machine) -> DataFrame:
    """key, state (bytes), n: what the ordered rows of each key leave. Only keys of several runs are joined."""
    dealt, parts = _dealt(rows, key, order, inputs, [])
    every = keep(_transitions(dealt, key, list(inputs), machine), "runs")
    spanning = _spanning(every, key)
    same = F.col(key).eqNullSafe(F.col("_span"))
    runs = every.join(spanning, same, "left_semi")
    while True:
        runs, parts = _joined(runs, key, machine), -(-parts // FAN)
        if parts == 1:
            break
    enter = F.pandas_udf(lambda ts: ts.map(lambda t: machine.enter(None, bytes(t))), "binary")
    whole = every.join(spanning, same, "left_anti").select(key, "t", "n").unionByName(runs.select(key, "t", "n"))
    return whole.select(key, enter("t").alias("state"), "n")


def _entries(runs: DataFrame, key: str, machine: Machine, parts: int) -> DataFrame:
    """key, run, state and rows in front of every run (null state: the first)."""
    kind = runs.select(key).dtypes[0][1]
    ddl = f"k {kind}, run int, state binary, before long"

    def walked(k, pdf: pd.DataFrame, state: bytes | None, before: int) -> pd.DataFrame:
        out = []
        for run, t, n in pdf.sort_values("run")[["run", "t", "n"]].itertuples(index=False):
            out.append((k, run, state, before))
            state, before = machine.enter(state, t), before + n
        return pd.DataFrame(out, columns=["k", "run", "state", "before"])

    if parts <= FAN:
        return runs.groupBy(key).applyInPandas(lambda keys, pdf: walked(keys[0], pdf, None, 0), ddl).withColumnRenamed("k", key)
    above = _entries(keep(_joined(runs, key, machine), "runs"), key, machine, -(-parts // FAN)).withColumnRenamed("run", "up")
    below = runs.withColumn("up", F.floor(F.col("run") / FAN).cast("int"))

    def down(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        state = right["state"].iloc[0]
        return walked(keys[0], left, None if state is None else bytes(state), int(right["before"].iloc[0]))

    return below.groupBy(key, "up").cogroup(above.groupBy(key, "up")).applyInPandas(down, ddl).withColumnRenamed("k", key)


def scan(rows: DataFrame, key: str, order: list[str], inputs: dict[str, Column], machine: Machine) -> DataFrame:
    """key, order columns, ``place`` (number of the row in its key, from 1) and the machine's outputs for every row.

    Transitions are made of the few keys that lie in several ranges; all others start from nothing. Runs are walked one
    after another in a task, not as groups of their own, so many short keys cost little more than their rows.
    """
    dealt, parts = _dealt(rows, key, order, inputs, [])
    dealt = keep(dealt, "dealt")
    names, kinds = list(inputs), dict(dealt.dtypes)
    others = [c for c in dict.fromkeys(order) if c != key]
    spanning = _spanning(dealt.select(key, "run").distinct(), key)
    runs = keep(_runs_of_groups(dealt.join(spanning, F.col(key).eqNullSafe(F.col("_span")), "left_semi"), key, order, names, machine), "runs")
    entries = _entries(runs, key, machine, parts).select(F.col(key).alias("_span"), F.col("run").alias("_at"), "state", "before")
    entries = small_side(keep(entries, "entries"))
    met = dealt.join(entries, F.col(key).eqNullSafe(F.col("_span")) & (F.col("run") == F.col("_at")), "left")
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in (key, *others)] + ["place long", machine.outputs])
    width = len(others) + 1

    def walked(pieces: list[pa.RecordBatch]) -> list[pa.Array]:
        """Columns of one key's rows in one run."""
        joined = lambda i: pa.concat_arrays([p.column(i) for p in pieces])
        state, before = pieces[0].column(width + 1)[0].as_py(), pieces[0].column(width + 2)[0].as_py() or 0
        got = machine.walk(state, *[joined(width + 3 + i).to_numpy(zero_copy_only=False) for i in range(len(names))])
        n = sum(p.num_rows for p in pieces)
        return [*map(joined, range(width)), pa.array(np.arange(before + 1, before + n + 1)), *map(pa.array, got.values())]

    def packed(done: list[list[pa.Array]], got: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done, strict=True)], names=got)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple = ()
        held: list[pa.RecordBatch] = []
        done: list[list[pa.Array]] = []
        got = [key, *others, "place", *told]
        for batch in batches:
            codes = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = batch.column(width).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                this = (batch.column(0)[a].as_py(), int(at[a]))
                if held and this != own:
                    done.append(walked(held))
                    held = []
                own = this
                held.append(batch.slice(a, b - a))
            if done:
                yield packed(done, got)
                done = []
        if held:
            yield packed([walked(held)], got)

    told = [c.split()[0] for c in machine.outputs.split(", ")]
    rows_ = met.select(key, *others, "run", "state", "before", *names).repartition(parts, "run").sortWithinPartitions("run", key, *others)
    return rows_.mapInArrow(walk, ddl)


def _runs_of_groups(dealt: DataFrame, key: str, order: list[str], names: list[str], machine: Machine) -> DataFrame:
    """As ``_transitions``, of rows that were kept and may be read in other splits."""
    kind = dealt.select(key).dtypes[0][1]

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in order if c != key])
        return pd.DataFrame({"k": [keys[0]], "run": [keys[1]], "t": [machine.run(*[pdf[c].to_numpy() for c in names])], "n": [len(pdf)]})

    return dealt.groupBy(key, "run").applyInPandas(run, f"k {kind}, run int, t binary, n long").withColumnRenamed("k", key)
