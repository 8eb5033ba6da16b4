"""Queries by name, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidefold.sources.model import Model, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    """Registers ``f(model)`` as query ``name``; ``text`` may name model tables."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if text:
            SQL[name] = oracle(text)
        return f

    return keep
