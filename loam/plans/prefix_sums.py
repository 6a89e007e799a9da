"""Running sums per group without one task per group.

Rows are ordered by a hex digest column. A digest prefix splits every group into small leaves that
are summed on their own; the leaves' totals are summed in levels of 256, so that no window holds
more than a few hundred rows however large a group is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF_ROWS = 128


def running_offset(rows: DataFrame, group: str, digest: str, ties: list[str], value: str, n_rows: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the rows of the group that sort before it.

    Order within a group is (digest, *ties). ``n_rows`` only sizes the leaves.
    """
    depth = max(0, math.ceil(math.log(max(n_rows, 1) / LEAF_ROWS, 16))) if n_rows > LEAF_ROWS else 0
    leaf = F.substring(digest, 1, depth)
    order = Window.partitionBy(group, "_leaf").orderBy(digest, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_leaf", leaf).withColumn("_in", F.coalesce(F.sum(value).over(order), F.lit(0)))
    if not depth:
        return inner.withColumnRenamed("_in", out).drop("_leaf")
    totals = rows.groupBy(group, leaf.alias("_leaf")).agg(F.sum(value).alias("_sum"))
    steps, at, level = [], depth, totals.withColumn("_key", F.col("_leaf"))
    level = level.select(group, "_key", "_sum")
    while at > 0:
        up = max(0, at - 2)
        w = Window.partitionBy(group, "_up").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
        named = level.withColumn("_up", F.substring("_key", 1, up)).withColumn("_off", F.coalesce(F.sum("_sum").over(w), F.lit(0)))
        steps.append(named.select(group, "_key", "_up", "_off"))
        level = level.groupBy(group, F.substring("_key", 1, up).alias("_key")).agg(F.sum("_sum").alias("_sum"))
        at = up
    whole = steps[-1].select(group, "_key", "_off")
    for lower in reversed(steps[:-1]):
        upper = whole.select(group, F.col("_key").alias("_up"), F.col("_off").alias("_more"))
        whole = lower.join(upper, [group, "_up"]).select(group, "_key", (F.col("_off") + F.col("_more")).alias("_off"))
    offs = whole.select(group, F.col("_key").alias("_leaf"), "_off")
    return inner.join(offs, [group, "_leaf"]).withColumn(out, F.col("_in") + F.col("_off")).drop("_leaf", "_in", "_off")
