"""Cut points: write a step's rows to the cluster's shared folder and read them back.

A lost executor then costs a re-read, never the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, on a local master only, one of our own where unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-loam-")
    return _OWN[app]


def keep(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder, if asked in a folder for each value of the number ``by``, and return it as read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table in as many partitions as there are cores, where its files make fewer splits; a larger one as it is.

    For work on long texts, which is bound by CPU.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Most rows of a kept table that may be broadcast; every caller's rows are a few short columns.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small; otherwise left for a shuffled join.

    Call it on kept tables, whose count is read from file footers.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
