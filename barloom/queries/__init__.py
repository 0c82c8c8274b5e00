"""Registered queries: name -> query(spark, sf_dir), and DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under the name of the operator that it applies."""

    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(*(((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def rounded_sql(sql: str, *doubles: str, digits: int = 6) -> str:
    """The like around a DuckDB query."""
    body = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles)
    head, _, main = sql.rpartition("\nSELECT ")
    return f"{head}\nSELECT * REPLACE ({body}) FROM (SELECT {main})"
