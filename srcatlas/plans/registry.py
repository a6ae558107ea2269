"""Registry of named queries: Spark callable + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, oracle: Callable[[], str] | str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``oracle`` is the equivalent DuckDB statement (or a function building
    it); leave it out for operators that have no SQL form.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle if callable(oracle) else (lambda s=oracle: s)
        return fn
    return deco


def load_all() -> None:
    from . import q_files, q_catalog, q_analysis, q_docs, q_text, q_vectors, q_keywords  # noqa: F401
