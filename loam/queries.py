"""The registered queries of the core operators and their DuckDB oracles."""

from __future__ import annotations

from loam.registry import base
from loam.registry import jobs, pipelines, records, search, streams, text  # noqa: F401  register themselves

QUERIES = base.QUERIES
ORACLE = base.ORACLE
FLAGSHIP = "ret3_bm25_top5"
