"""name -> query, and name -> DuckDB SQL, for everything but the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.sources.archive import HERE, ORACLE as OTHER, Dialect, run, statement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in DuckDB, where SQL can say it."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def archived(body: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """Register a query said in SQL over the archive, under its function's name; the oracle is the same statement in the other dialect."""

    def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, body(HERE))

    planned.__name__, planned.__doc__ = body.__name__, body.__doc__
    query(body.__name__, statement(body(OTHER)))(planned)
    return body
