"""Query registry: each key maps to a Spark builder over the fixture views and,
where the operator is SQL-expressible, an independently written DuckDB oracle.

Plan modules register with the ``@query`` decorator; ``__spark_entry__`` only
exposes the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Fixtures, duckdb_with


@dataclass
class QuerySpec:
    key: str
    build: Callable[[Fixtures], DataFrame]
    views: list[str] = field(default_factory=list)
    oracle: str | None = None
    section: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def query(key: str, views: tuple[str, ...] | list[str] = (), oracle: str | None = None, section: str = ""):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = QuerySpec(key, fn, list(views), oracle, section)
        return fn

    return deco


def oracle_text(spec: QuerySpec) -> str | None:
    if spec.oracle is None:
        return None
    head = duckdb_with(spec.views)
    body = spec.oracle.strip()
    if head and body[:4].upper() == "WITH":
        return head.rstrip() + ",\n" + body[4:].lstrip()
    return head + body


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def make(spec: QuerySpec):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spec.build(Fixtures(spark, sf_dir))

        run.__name__ = spec.key
        return run

    return {k: make(s) for k, s in REGISTRY.items()}


def oracle_sqls() -> dict[str, str]:
    out = {}
    for k, s in REGISTRY.items():
        t = oracle_text(s)
        if t is not None:
            out[k] = t
    return out
