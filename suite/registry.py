"""Query registration and the shared table views.

A view is one SELECT that both Spark and DuckDB run; it only renames and shapes a test table into catalogue or
ingest terms, so that an operator and its checking SQL start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gatehouse.session import scratch_path
from suite.views import VIEWS

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
_NAME = re.compile(r"\{(\w+)\}")


class Tables:
    """Base tables and views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in BASE_TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._known[name] = self.sql(VIEWS[name])
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{name: self(name) for name in set(_NAME.findall(text))})

    def scratch(self, label: str) -> str:
        return scratch_path(self.spark, label)


@dataclass(frozen=True)
class Registered:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(name: str, sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under ``name`` with its checking SQL."""

    def add(function):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Registered(
            lambda spark, folder: function(Tables(spark, folder)), None if sql is None else expand(sql)
        )
        return function

    return add


def expand(sql: str) -> str:
    """Checking SQL with the views it names put in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name not in BASE_TABLES and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    views = ", ".join(f"{name} AS ({_NAME.sub(_bare, VIEWS[name])})" for name in order)
    body = _NAME.sub(_bare, sql).strip()
    if not views:
        return body
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if own is None:
        return f"WITH {views} {body}"
    return f"WITH {own.group(1) or ''}{views}, {body[own.end():]}"


def _bare(found: re.Match) -> str:
    return found.group(1)
