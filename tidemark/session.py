"""Spark session defaults of the engine."""

from __future__ import annotations

import os
import site
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, then ``conf`` (underscores for dots)."""
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable for Python workers, once a session: where it is neither installed nor on their path (the
    driver's folder or PYTHONPATH), Spark's file server hands out a zip of it."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    if root in known or getattr(context, "_tidemark_shipped", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "tidemark.zip")
        with zipfile.ZipFile(path, "w") as out:
            for at, _, names in os.walk(os.path.join(root, "tidemark")):
                for name in names:
                    if name.endswith(".py"):
                        out.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), root))
        context.addPyFile(path)
    context._tidemark_shipped = True
