"""Source trees: files and the entities declared in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import structure
from loam.functions import text as T

SKIPPED = ("node_modules", "dist", "build", "vendor", "target", "coverage", "__pycache__")
def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...], most_bytes: int = 512_000) -> DataFrame:
    """path, text of the files below ``root`` by extension and size; hidden and skipped folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hidden = r"/(\.[^/]+|" + "|".join(SKIPPED) + r")/"
    kept = files.where(T.extension(F.col("path")).isin(*extensions) & (F.col("length") <= most_bytes) & ~F.col("path").rlike(hidden))
    return kept.select("path", F.decode("content", "utf-8").alias("text"))


def entities(files: DataFrame, most: int = structure.MOST) -> DataFrame:
    """path, type, symbol, line_no, line_end, parent, fingerprint: each file, and what it declares, once per type and symbol."""
    typed = files.select("path", "text", T.language_of(F.col("path")).alias("language"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text, language in pdf.itertuples(index=False):
                lines = (text or "").split("\n")
                rows += [(path, *e, lines[e[2] - 1]) for e in structure.entities_of(text or "", language, most)]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "type", "symbol", "line_no", "line_end", "parent", "line"])

    found = typed.mapInPandas(scan, "path string, type string, symbol string, line_no int, line_end int, parent string, line string")
    found = found.withColumn("fingerprint", T.djb2(F.col("line"))).drop("line")
    none = lambda kind: F.lit(None).cast(kind)
    text = F.coalesce("text", F.lit(""))
    whole = files.select(
        "path", F.lit("file").alias("type"), none("string").alias("symbol"), none("int").alias("line_no"), F.size(F.split(text, "\n")).alias("line_end"), none("string").alias("parent"), T.djb2(text).alias("fingerprint")
    )
    return whole.unionByName(found)


def new_entities(found: DataFrame, known: DataFrame) -> DataFrame:
    """Entities whose key isn't known yet."""
    key = T.entity_key(F.col("path"), F.col("type"), F.col("symbol"), F.col("line_no"), F.lit(None))
    return found.withColumn("key", key).join(known.select("key").distinct(), "key", "left_anti")
