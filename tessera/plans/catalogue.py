"""All queries of the engine with their SQL, by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import catalog
from tessera import sql as engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name``, with its SQL where there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def same(name: str, sql: str, oracle: str | None = None) -> None:
    """Register a query whose text the engine runs as SQL; ``oracle`` where the other dialect differs."""
    used = [t for t in catalog.TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog.register(spark, sf_dir, used)
        return engine.run(spark, sql)

    query(name, oracle or sql)(run)


from . import breadth, iceberg_table, more, operators, tpch  # noqa: E402, F401  the modules register their queries
