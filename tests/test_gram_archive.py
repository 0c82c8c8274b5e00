"""Blocked products against numpy, and the archive against a look at every dump."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd

from barloom.operators.gram import gram
from barloom.sources import archive


def test_pairs_over_tiles_and_slices(spark):
    rng = np.random.default_rng(4)
    days = pd.bdate_range("2020-01-01", periods=90)
    wide = pd.DataFrame(rng.normal(0, 0.01, (90, 23)), days, [f"s{i:02}" for i in range(23)])
    wide = wide.mask(rng.random((90, 23)) < 0.2)
    wide["flat"] = 0.25
    wide["once"] = [0.1, *[None] * 89]
    rows = [(s, d.date(), None if np.isnan(x) else float(x)) for s in wide for d, x in wide[s].items()] + [(None, days[0].date(), 1.0)]
    got = {(r["a"], r["b"]): r for r in gram(spark.createDataFrame(rows, "symbol string, dt date, r double").repartition(4), tile=7, days=16).collect()}
    corr, cov = wide.astype(float).corr(), wide.astype(float).cov()
    assert all(a <= b for a, b in got)
    for i, a in enumerate(sorted(wide)):
        for b in sorted(wide)[i:]:
            n = int((wide[a].notna() & wide[b].notna()).sum())
            if not n:
                assert (a, b) not in got
                continue
            r = got[a, b]
            assert r["n"] == n
            if n > 1:
                assert abs(r["cov"] - cov.loc[a, b]) < 1e-12
                assert r["corr"] is None or "flat" in (a, b) or abs(r["corr"] - corr.loc[a, b]) < 1e-9
            else:
                assert r["corr"] is None and r["cov"] is None
    assert gram(spark.createDataFrame([], "symbol string, dt date, r double")).count() == 0


def test_many_symbols_make_no_rows_of_pairs_of_a_day(spark):
    """600 symbols over 40 days: the plan joins blocks, 5 x 6 / 2 pairs of tiles for each slice."""
    r = spark.range(600 * 40).selectExpr("concat('s', id % 600) AS symbol", "date_add(DATE '2024-01-01', CAST(id / 600 AS INT)) AS dt", "sin(id * 12.9898) AS r")
    found = gram(r)
    assert found.count() == 600 * 601 // 2
    assert found.where("a = b AND abs(corr - 1) > 1e-9").count() == 0


def test_archive(spark):
    rng = random.Random(6)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in sorted(rng.sample(range(60), 15))]
    state, dumps = {}, []
    for day in days:
        for k in range(6):
            if rng.random() < 0.3:
                state[k] = rng.choice([None, ("x", 1), ("x", None), ("y", 2)])
            if state.get(k):
                dumps += [(k, day, *state[k])] * rng.choice([1, 1, 2])
    table = spark.createDataFrame(dumps, "key int, day date, name string, lot int").repartition(3)
    kept = archive.lives(table, ["key"])
    assert kept.count() < len(set(dumps))
    for d in range(-1, 62):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        before = [x for x in days if x <= day]
        want = sorted({(k, n, lot) for k, at, n, lot in dumps if before and at == before[-1]}, key=repr)
        if d % 7 == 0 or day in days:
            assert sorted((tuple(r) for r in archive.as_of(kept, day).collect()), key=repr) == want
    asked = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=d), k * d) for k in range(7) for d in range(0, 62, 3)]
    got = sorted((tuple(r) for r in archive.looked_up(spark.createDataFrame(asked, "key int, day date, i int"), kept, ["key"], "day").collect()), key=repr)
    last = lambda day: max((x for x in days if x <= day), default=None)
    known = {(k, day): (n, lot) for k, day, n, lot in dumps}
    assert got == sorted(((k, day, i, *known.get((k, last(day)), (None, None))) for k, day, i in asked), key=repr)
