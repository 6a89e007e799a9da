"""Record schema, enumerations and the binding of the given tables to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in declared order, and each kind's risk.
KINDS = ("preference", "fact", "decision", "session_summary", "tooling", "code_context", "procedure", "mistake", "trade_rule", "security_rule")
KIND_RISK = dict(zip(KINDS, ("low", "low", "medium", "medium", "low", "medium", "high", "high", "critical", "critical"), strict=True))
RISK_ORDER = {"low": 1, "medium": 2, "high": 3, "critical": 4}
STATUSES = ("active", "archived", "expired")
VISIBILITY = ("private", "team", "public")
EDGE_RELATIONS = ("supports", "contradicts", "depends_on", "derived_from", "supersedes", "relates_to")
NEEDS_RATIONALE = ("contradicts", "supersedes", "depends_on")
ROLE_PERMISSIONS = {
    "viewer": ("memory:read", "memory:search"),
    "proposer": ("memory:read", "memory:search", "memory:propose"),
    "approver": ("memory:read", "memory:search", "memory:propose", "memory:approve", "memory:reject"),
    "admin": ("memory:read", "memory:search", "memory:propose", "memory:approve", "memory:reject", "memory:delete", "role:manage"),
}

EVIDENCE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("source", "reference", "note")]))
RECORD = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        *[T.StructField(n, T.StringType()) for n in ("project", "kind", "text", "status", "visibility", "source", "content_hash")],
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", EVIDENCE),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *[T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at", "expires_at")],
    ]
)

EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def pick(values, index: Column) -> Column:
    """The value at ``index`` (from 0) of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lookup(values: dict, key: Column) -> Column:
    """Literal map lookup, null for other keys."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def risk_of(kind: Column) -> Column:
    return lookup(KIND_RISK, kind)


def risk_rank(risk: Column) -> Column:
    return lookup(RISK_ORDER, risk)


def records(documents: DataFrame) -> DataFrame:
    """``documents`` as records: kind by id, status by id, confidence, creation time, kind's risk."""
    i = F.col("doc_id")
    status = F.when(i % 7 == 0, "archived").when(i % 11 == 0, "expired").otherwise("active")
    return documents.select(
        i.alias("id"), F.col("source").alias("project"), pick(KINDS, i % 10).alias("kind"), "text", status.alias("status"),
        F.col("lang").alias("visibility"), ((i % 100) / 100.0).alias("confidence"), "n_chars",
        F.timestamp_seconds(F.lit(EPOCH) + i * 3600).alias("created_at"),
    )


# The same binding for the oracles.
RECORDS_SQL = f"""records AS (
  SELECT doc_id AS id, source AS project, {list(KINDS)!r}[(doc_id % 10 + 1)::INT] AS kind, text,
         CASE WHEN doc_id % 7 = 0 THEN 'archived' WHEN doc_id % 11 = 0 THEN 'expired' ELSE 'active' END AS status,
         lang AS visibility, (doc_id % 100) / 100.0::DOUBLE AS confidence, n_chars, {EPOCH} + doc_id * 3600 AS created_s
  FROM documents)"""


def case_sql(values: dict, key: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())
    return f"CASE {key} {whens} END"
