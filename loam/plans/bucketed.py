"""Tables cut into buckets by key, changed by rewriting only the buckets that a change touches.

A table is a folder: ``data/<write>/bucket=<b>`` holds the Parquet files of one write, ``manifest/<v>`` one JSON line that says
which writes of which buckets make up version v. A version counts once its manifest is complete, so a writer
that fails leaves nothing behind that a reader sees, and two writers can't both make version v. Batches carry a
number: one that is not above the last written is a replay and changes nothing. Readers ask for single buckets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files of a bucket beyond which an append rewrites it as a whole.
MOST_PIECES = 8


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


class Bucketed:
    """A bucketed table, at the version that was the last one when it was opened or changed by this object."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = max((int(v) for v in _names(spark, f"{self.path}/manifest") if "_SUCCESS" in _names(spark, f"{self.path}/manifest/{v}")), default=-1)
        if self.version < 0:
            raise FileNotFoundError(f"no table at {path}")
        self.manifest = json.loads(spark.read.text(f"{self.path}/manifest/{self.version}").first()[0])

    @staticmethod
    def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64, spread: Column | None = None, **more) -> Bucketed:
        """A new table of ``rows`` in buckets by a hash of ``keys``; ``spread`` cuts a bucket into several files; ``more`` is kept in the manifest."""
        table = object.__new__(Bucketed)
        table.spark, table.path, table.version = rows.sparkSession, path.rstrip("/"), -1
        table.manifest = {"keys": keys, "buckets": buckets, "schema": rows.schema.json(), "batch": -1, "data": {}, "more": more}
        table._put(rows, None, False, -1, spread, more)
        return table

    @property
    def more(self) -> dict:
        return self.manifest["more"]

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.manifest["schema"]))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.manifest["keys"]), F.lit(self.manifest["buckets"])).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the key columns fall into: as many as the table has, at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def folders(self, buckets: list[int] | None = None) -> list[str]:
        wanted = None if buckets is None else {str(b) for b in buckets}
        return [f"{self.path}/data/{w}/bucket={b}" for b, ws in self.manifest["data"].items() if wanted is None or b in wanted for w in ws]

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: no other file is listed or opened."""
        folders = self.folders(buckets)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def replace(self, rows: DataFrame, buckets: list[int], batch: int | None = None, spread: Column | None = None, stay: DataFrame | None = None, **more) -> None:
        """``rows`` and ``stay`` become the whole content of ``buckets``; ``stay`` is what is left of ``read(buckets)``, which lies by bucket and is not shuffled."""
        if not self._replayed(batch):
            self._put(rows, buckets, True, batch, spread, more, stay)

    def append(self, rows: DataFrame, batch: int | None = None, spread: Column | None = None) -> None:
        """Adds rows beside those there; a bucket of many pieces is rewritten as one."""
        if self._replayed(batch):
            return
        full = [int(b) for b, vs in self.manifest["data"].items() if len(vs) >= MOST_PIECES]
        full = sorted(set(full) & set(self.touched(rows))) if full else []
        whole = rows.unionByName(self.read(full)) if full else rows
        self._put(whole, full, False, batch, spread, {})

    def upsert(self, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> None:
        """Folds changes into the buckets of their keys: ``fold(stored, changes)`` gets all rows of these buckets."""
        if self._replayed(batch):
            return
        buckets = self.touched(changes)
        self._put(fold(self.read(buckets), changes), buckets, True, batch, None, {})

    def vacuum(self) -> int:
        """Removes data and manifests of earlier versions, for when nobody reads them any more; returns the folders removed."""
        used = {f for f in self.folders()}
        gone = [f"{self.path}/manifest/{v}" for v in _names(self.spark, f"{self.path}/manifest") if int(v) != self.version]
        for v in _names(self.spark, f"{self.path}/data"):
            gone += [f for b in _names(self.spark, f"{self.path}/data/{v}") if b.startswith("bucket=") and (f := f"{self.path}/data/{v}/{b}") not in used]
        for f in gone:
            fs, p = _fs(self.spark, f)
            fs.delete(p, True)
        return len(gone)

    def _replayed(self, batch: int | None) -> bool:
        return batch is not None and batch <= self.manifest["batch"]

    def _put(self, rows: DataFrame, buckets: list[int] | None, whole: bool, batch: int | None, spread: Column | None, more: dict, stay: DataFrame | None = None) -> None:
        version = self.version + 1
        names = [c for c in self.schema.names]
        out = rows.select(*names).withColumn("bucket", self.bucket())
        # all files of a bucket lie in few tasks: one, or one for each value of ``spread``
        out = out.repartition(*[c for c in (F.col("bucket"), spread) if c is not None])
        if stay is not None:
            out = out.unionByName(stay.select(*names).withColumn("bucket", self.bucket()))
        write = f"{version}-{uuid.uuid4().hex[:12]}"  # its own, whoever else writes this version
        folder = f"{self.path}/data/{write}"
        out.write.partitionBy("bucket").parquet(folder)
        written = [b.removeprefix("bucket=") for b in _names(self.spark, folder) if b.startswith("bucket=")]
        data = {b: list(vs) for b, vs in self.manifest["data"].items()}
        for b in buckets or ():
            data.pop(str(b), None)
        for b in written:
            if whole and int(b) not in set(buckets or ()):
                raise ValueError(f"a row belongs to bucket {b}, which is not replaced")
            data.setdefault(b, []).append(write)
        manifest = self.manifest | {"data": data, "batch": self.manifest["batch"] if batch is None else batch, "more": self.manifest["more"] | more}
        place = f"{self.path}/manifest/{version}"
        complete = "_SUCCESS" in _names(self.spark, place)
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("error" if complete else "overwrite").text(place)
        self.manifest, self.version = manifest, version
