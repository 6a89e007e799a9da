"""Small helpers for column expressions and column names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with columns named like ``names`` renamed to ``<name>_input``, so that columns of these names can be added."""
    wanted = {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in wanted:
            df = df.withColumnRenamed(c, spare(df, f"{c}_input"))
    return df
