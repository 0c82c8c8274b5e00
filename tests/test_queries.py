"""Every market query against its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from barloom.catalog import ORACLE_SQL, QUERIES
from barloom.plans.rules import parse_alert, parse_rule

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.date):
        return str(v)[:19].replace("T", " ")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())


def test_rule_grammar():
    assert (parse_rule("RSI < 30").op, parse_rule("rsi=30").op, parse_rule("above_sma50").value) == ("<", "==", 0.5)
    assert parse_alert("abc rsi >= 70").symbol == "ABC"
    for bad in ("", "rsi <", "nothing < 3", "rsi < x"):
        with pytest.raises(ValueError):
            parse_rule(bad)
