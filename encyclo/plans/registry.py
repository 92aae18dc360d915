"""Registry of the library's queries: one Spark plan per operator plus its DuckDB oracle.

Each query is a function ``(spark, sf_dir) -> DataFrame`` reading the whole
driver tables (through the role views of ``sources.fixtures``).  ``oracle`` is
the equivalent SQL for DuckDB, or ``None`` when the operator is not
expressible there (models, iterative graph search) -- those are tested
against brute force on small fixtures in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from . import q_corpus, q_learn, q_pages, q_relational, q_vectors  # noqa: F401
    return REGISTRY
