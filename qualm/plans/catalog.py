"""Registered queries: one per inventory row, each with its DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables (or data
Spark derives from them). ``doubles`` names the double columns that both sides
round to 6 places for comparison; ``sql`` is None where no SQL twin is
practical (checked against brute force in tests instead).
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import round_doubles, round_sql


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list[str]


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles=()):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, list(doubles))
        return fn
    return deco


def load_all():
    """Import the modules that register queries (idempotent)."""
    from . import q_tables, q_eval, q_vectors, q_kmeans, q_text, q_sweep, q_io  # noqa: F401
    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def wrap(q: Query):
        return lambda spark, sf_dir: round_doubles(q.fn(spark, sf_dir))
    return {n: wrap(q) for n, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return {n: round_sql(q.sql, q.doubles) for n, q in REGISTRY.items() if q.sql}
