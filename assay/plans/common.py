"""Registration: a query is a function of (table getter) -> DataFrame; its SQL names bound tables freely."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import bound, with_bindings

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function, which gets `t(name)` for a table or bound table (made from bound ones
    that are given by name)."""

    def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table, **given: bound(spark, sf_dir, table, **given))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = with_bindings(sql.strip())
        return f

    return keep
