"""Registry of the engine's own queries, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _counted(sql: str) -> str:
    """sql with count(*) FILTER for count_if, which DuckDB returns as a 128-bit number."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def query(name: str, oracle: str | None = None, ints: tuple[str, ...] = ()):
    """Registers a query and its SQL; ints: columns that are 32-bit here and 64-bit there."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            sql = _counted(oracle)
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(f'{c}::INTEGER AS {c}' for c in ints)}) FROM ({sql})" if ints else sql
        return f

    return register


def _load() -> None:
    import importlib
    import pkgutil

    from loomery import plans

    for module in pkgutil.iter_modules(plans.__path__, "loomery.plans."):
        importlib.import_module(module.name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["h01_hybrid_retrieval"](spark, sf_dir)
