"""Registry of the catalogued queries: a Spark job and, where one exists, the
equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class QuerySpec:
    name: str
    operator: str  # inventory id(s), e.g. "J2" or "B2"
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, operator: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = QuerySpec(name, operator, fn, sql)
        return fn
    return register


def with_ctes(*ctes: str, body: str) -> str:
    """``WITH cte1, cte2 body`` (ctes already in ``name AS (...)`` form)."""
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
