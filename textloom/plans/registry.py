"""The register of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _wide(run: Query) -> Query:
    """Integers of a result as long ones, as SQL counts them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(*[F.col(f"`{c}`").cast("bigint").alias(c) if kind == "int" else F.col(f"`{c}`") for c, kind in df.dtypes])

    return query


def register(name: str, run: Query, sql: str | None = None) -> None:
    """A query and, where SQL can express it over whole tables, its SQL."""
    _QUERIES[name] = run if sql is None else _wide(run)
    if sql is not None:
        _SQL[name] = sql.replace(" as int)", " as bigint)")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
