"""Evaluation cases from JSON texts: a plain list of cases, or an object with ``cases``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASE = (
    "struct<id:string,query:string,limit:int,expected_memory_ids:array<string>,expected_kinds:array<string>,expected_text:array<string>,open_paths:array<string>,"
    "task_type:string,model_context_tokens:int,budget_ratio:double,evidence_mode:string,retrieval_rounds:int>"
)


def eval_cases(raw: DataFrame) -> DataFrame:
    """All columns of ``raw`` but ``value``, place, and the fields of every case in the JSON text ``value``.

    A text that is neither form has no cases.
    """
    plain = F.from_json("value", f"array<{CASE}>")
    nested = F.from_json("value", f"struct<cases:array<{CASE}>>")["cases"]
    cases = F.when(F.ltrim("value").startswith("["), plain).otherwise(nested)
    rest = [c for c in raw.columns if c != "value"]
    return raw.select(*rest, F.posexplode(cases).alias("place", "c")).select(*rest, "place", "c.*")


def read_eval_cases(spark, path: str) -> DataFrame:
    """Cases of the JSON files under ``path``, one text a file."""
    return eval_cases(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))
