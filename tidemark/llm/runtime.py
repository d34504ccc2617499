"""Shared folders, materialised intermediate tables and small column helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows of a batch between the JVM and Python: with texts of some kilobytes a batch holds a few megabytes.
ARROW_ROWS = 1024


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker's memory follows a batch and not the default of 10,000 texts; and the
    package on the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine, as in tests) gets a temporary folder; a cluster is refused,
    since its machines could not read each other's files.
    """
    # a runtime setting of the session counts too, then the configuration the context began with
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run, in a folder of its own below the shared one.

    ``write`` cuts the lineage: the returned frame reads the written files, so a lost executor costs no recomputation
    of what came before.  ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession, hours: float) -> int:
    """Remove tables of runs that ended long ago: folders below the shared one that haven't changed for ``hours``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() < (time.time() - 3600 * hours) * 1000] if fs.exists(root) else []
    for path in old:
        fs.delete(path, True)
    return len(old)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` is called so (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (and ``more``) alone; a null text is empty.  Other columns, whatever their names, go."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def row_key() -> Column:
    """64 bits that tell a row by its doc_id and text; rows that agree in both share it."""
    return F.xxhash64("doc_id", "text")


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose `row_key` isn't in the column doc_id of ``keys``: rows go by what they hold themselves,
    not by others that share their doc_id, and with a doc_id of null as well."""
    (key,) = fresh(docs, "key")
    gone = keys.select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
