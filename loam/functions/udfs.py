"""Registered SQL functions, table functions and pluggable embedders, renderers and adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loam.functions import chunking

COSINE = """CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
RETURN CASE WHEN size(a) = size(b) THEN
  greatest(-1D, least(1D, coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x),
    sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x)) * sqrt(aggregate(transform(b, x -> x * x), 0D, (s, x) -> s + x))), 0D))) END"""


def register_sql(spark: SparkSession) -> None:
    """``cosine_similarity`` for SQL: an expression that the optimizer inlines."""
    spark.sql(COSINE)


class _Chunks:
    """Chunks of a text, see ``chunking.chunks_of``; a null text has none."""

    def eval(self, text: str, limit: int) -> Iterator[tuple[int, int, int, int]]:
        if text is not None:
            for number, _, start, stop, words in chunking.chunks_of(text, limit):
                yield number, start, stop, words


def chunk_table():
    """Table function (text, limit) -> index, start, stop, words, for ``LATERAL`` joins; rows come and go in Arrow batches."""
    return udtf(_Chunks, returnType="index int, start int, stop int, words int", useArrow=True)


def register_chunks(spark: SparkSession) -> None:
    spark.udtf.register("text_chunks", chunk_table())


EMBEDDERS: dict[str, tuple[int, Callable[[pd.Series], pd.Series]]] = {}


def register_embedder(name: str, dims: int, embed: Callable[[pd.Series], pd.Series]) -> None:
    """``embed`` maps a batch of texts to a batch of vectors of ``dims`` numbers."""
    EMBEDDERS[name] = (dims, embed)


def healthy(name: str) -> bool:
    """Whether an embedder is registered and answers a probe with a vector of its length."""
    try:
        dims, f = EMBEDDERS[name]
        out = f(pd.Series(["health check"]))
        return len(out) == 1 and len(out.iloc[0]) == dims
    except Exception:  # whatever an embedder may raise
        return False


def embed(rows: DataFrame, name: str, text: str = "text", out: str = "vec") -> DataFrame:
    """``rows`` with vectors by a registered embedder; wrong or missing vectors become null."""
    dims, f = EMBEDDERS[name]

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) if v is not None and len(v) == dims else None for v in f(s.fillna(""))])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return rows.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text)))


def _letters(s: pd.Series) -> pd.Series:
    """A tiny built-in embedder: shares of letters a to z."""
    import numpy as np

    def one(t: str):
        raw = np.frombuffer(t.lower().encode("ascii", "ignore"), dtype=np.uint8)
        counts = np.bincount(raw[(raw >= 97) & (raw < 123)] - 97, minlength=26).astype(float)
        return counts / max(counts.sum(), 1.0)

    return s.map(one)


register_embedder("letters", 26, _letters)

RENDERERS: dict[str, Callable[[Column], Column]] = {}
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_renderer(kind: str, render: Callable[[Column], Column]) -> None:
    RENDERERS[kind] = render


def render(kind: Column, text: Column) -> Column:
    """The text by its kind's renderer, as it is for kinds without one."""
    out = F.when(F.lit(False), text)
    for name, f in RENDERERS.items():
        out = out.when(kind == name, f(text))
    return out.otherwise(text)


def register_adapter(agent: str, adapt: Callable[[DataFrame], DataFrame]) -> None:
    ADAPTERS[agent] = adapt


def adapt(events: DataFrame, agent: str = "agent") -> DataFrame:
    """Events of each known agent through its adapter, the rest as they are."""
    out = events.where(~F.col(agent).isin(*ADAPTERS)) if ADAPTERS else events
    for name, f in ADAPTERS.items():
        out = out.unionByName(f(events.where(F.col(agent) == name)))
    return out
