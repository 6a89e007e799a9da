"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loam.plans.materialize import spread
from loam.schemas import records
from loam.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables as attributes; ``records`` is the record view of ``documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "records":
            return records(self.documents)
        df = table(self.spark, self.sf_dir, name)
        return spread(df) if name == "documents" else df


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its own name, with its oracle if SQL can express it."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register
