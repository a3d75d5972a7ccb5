"""How a query is registered: a Spark function and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import tune
from .inputs import INPUTS, SPARK_INPUTS

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the inputs derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark, explodes=True), folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in INPUTS:
            if name not in self._made:
                text = SPARK_INPUTS.get(name, INPUTS[name])
                self._made[name] = self.sql(text.replace("TASKS", str(self.spark.sparkContext.defaultParallelism)))
            return self._made[name]
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run a SELECT that names the given tables or derived inputs."""
        used = _names(text)
        for n in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def _names(text: str) -> list[str]:
    found = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", text)
    return sorted({n for n in found if n in TABLES or n in INPUTS})


def _needs(name: str, seen: list[str]) -> list[str]:
    for n in _names(INPUTS[name]):
        if n in INPUTS and n not in seen:
            _needs(n, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_inputs(text: str) -> str:
    """Put the derived inputs a SQL text names in front of it as common table expressions."""
    seen: list[str] = []
    for n in _names(text):
        if n in INPUTS:
            _needs(n, seen)
    ctes = ",\n".join(f"{n} AS (\n{INPUTS[n].strip()}\n)" for n in seen)
    body = text.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if not ctes:
        return body
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            # Lower-case ``by`` is only ever a coordinate here, and a reserved word there.
            ORACLES[name] = re.sub(r'(?<!["\'])\bby\b', '"by"', with_inputs(sql))
        return fn
    return wrap
