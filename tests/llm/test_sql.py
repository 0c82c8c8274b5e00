"""Corpus queries that SQL can express, against DuckDB on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from barloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, medium, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{medium}/{t}.parquet'")
    df = QUERIES[name](spark, medium)
    plain = lambda r: tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(plain, df.select(*names).collect())) == sorted(map(plain, cur.fetchall()))
