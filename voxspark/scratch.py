"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, as in tests, a temporary folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="voxspark-"))
    return _FALLBACK[0]


#: Lets Spark remove the shuffle files of an execution when it ends; a kept table is never computed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """A folder of written tables: each cuts the lineage and outlives any executor.

    A table must stay until all that reads it has run: :meth:`drop` removes single ones,
    :meth:`finish` all but an operator's result, which it writes, and :meth:`clear` all.
    """

    def __init__(self, spark: SparkSession, name: str = "op"):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/voxspark-{name}-{uuid.uuid4().hex[:12]}"
        self._kept: list[tuple[DataFrame, str, str | None]] = []  # frame, folder, table

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and read it back."""
        where = self.path(name)
        with _shuffles_cleaned(self.spark):
            df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._kept.append((out, where, None))
        return out

    def keep_bucketed(self, df: DataFrame, key: str, buckets: int, name: str = "b") -> DataFrame:
        """Write df bucketed by key, so that joins on key leave this side where it is."""
        where, table = self.path(name), f"voxspark_{name}_{uuid.uuid4().hex}"
        with _shuffles_cleaned(self.spark):
            df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).option("path", where).saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the name alone: the frame keeps folder and buckets
        self._kept.append((out, where, None))
        return out

    def finish(self, result: DataFrame, name: str = "result") -> DataFrame:
        """Write the result and remove what it was made from."""
        before = [df for df, *_ in self._kept]
        out = self.keep(result, name)
        self.drop(*before)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame, where, table in self._kept:
            if any(frame is f for f in frames):
                self._remove(where, table)
        self._kept = [k for k in self._kept if not any(k[0] is f for f in frames)]

    def clear(self) -> None:
        for _, where, table in self._kept:
            self._remove(where, table)
        self._kept.clear()
        self._remove(self.root, None)

    def _remove(self, folder: str, table: str | None) -> None:
        if table:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
