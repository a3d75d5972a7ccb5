"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_sent: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Settings the operators count on, and this package's modules for Python workers that lack them."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "wayframe.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        out.write(full := os.path.join(folder, n), os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(path)  # Spark's own file server hands it to the executors
        _sent.add(app)
    return tune(spark)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
