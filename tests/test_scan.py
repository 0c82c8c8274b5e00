"""Recursive series in many pieces give what one pass gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import book, models, recursive, scan, simulate
from barloom.operators.scan import pieces

BARS = "symbol string, dt date, open double, high double, low double, close double, volume long, up boolean, down boolean"


@pytest.fixture(scope="module")
def bars(spark):
    """One long series, a short one, one of a single bar, and a null symbol; closes with gaps."""
    rng = np.random.default_rng(3)
    rows = []
    for symbol, n in (("long", 3000), ("short", 120), ("one", 1), (None, 700)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        days = pd.bdate_range("2001-01-01", periods=n).date
        for i in range(n):
            o = float(close[i] * (1 + rng.normal(0, 0.01)))
            c = float(close[i])
            rows.append((symbol, days[i], o, max(o, c) * 1.01, min(o, c) * 0.99, c, int(rng.integers(1, 99)), bool(rng.random() < 0.05), bool(rng.random() < 0.05)))
    return spark.createDataFrame(rows, BARS).repartition(5).cache()


def same(a, b, columns):
    key = lambda r: (r["symbol"] or "", r["dt"])
    left, right = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(left) == len(right) > 0
    for x, y in zip(left, right, strict=True):
        for c in columns:
            u, v = x[c], y[c]
            assert (u is None) == (v is None) and (u == v or abs(u - v) <= 1e-9 * max(1, abs(u))), (x, y, c)


def test_pieces(spark, bars):
    cut = pieces(bars, most=200)
    sizes = cut.cut(bars).groupBy("symbol", scan.PIECE).count().collect()
    assert cut.many and max(r["count"] for r in sizes) < 500 and sum(r["count"] for r in sizes) == 3821
    assert not pieces(bars, most=3000).many and not pieces(bars.where("false")).many
    k = scan.numbered(cut.cut(bars), cut).where("symbol = 'long'").orderBy("dt").collect()
    assert [r["k"] for r in k] == list(range(3000))


def test_means(bars):
    some = bars.withColumn("x", F.when(F.dayofmonth("dt") % 7 > 1, F.col("close"))).withColumn("none", F.lit(None).cast("double"))
    some = some.withColumn("late", F.when(F.col("dt") > "2004-06-01", F.col("close")))
    means = [("a", "close", 0.1, 5), ("b", "x", 0.3, 0), ("c", "none", 0.2, 1), ("d", "late", 0.01, 400)]
    cut = pieces(some, most=100)
    one, many = recursive.smooth(some, means), recursive.smooth(some, means, cut=cut)
    assert cut.many and many.columns == one.columns
    same(one, many, [m[0] for m in means])
    plain = some.where("symbol = 'long'").orderBy("dt").toPandas()
    got = many.where("symbol = 'long'").orderBy("dt").toPandas()
    for name, source, alpha, warm_up in means:
        want = plain[source].astype(float).ewm(alpha=alpha, adjust=False, min_periods=warm_up).mean()
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, equal_nan=True)


def test_indicators(bars):
    asked = [("ema", 10), ("rsi", 14), ("atr", 14), ("adx", 14), ("macd", 26), ("macd_signal", 9)]
    cut = pieces(bars, most=250)
    same(recursive.with_recursive(bars, asked), recursive.with_recursive(bars, asked, cut=cut), [f"{k}_{n}" for k, n in asked])


def test_trend_filter(bars):
    named = bars.where("symbol IS NOT NULL")
    cut = pieces(named, most=250)
    one, many = models.kalman_trend(named), models.kalman_trend(named, cut=cut)
    same(one, many, ["level", "slope", "band", "z"])
    assert {r["symbol"] for r in many.select("symbol").distinct().collect()} == {"long", "short"}


@pytest.mark.parametrize(
    "x",
    [simulate.Execution(), simulate.Execution(stop=("percent", 4.0), target=("atr", 3.0), cooldown=6, allow_short=False), simulate.Execution(stop=("atr", 2.0), trailing=True, atr_min=0.5)],
    ids=["signals", "stops", "trailing"],
)
def test_simulator(bars, x):
    signals = bars.withColumns({"long_entry": F.col("up"), "long_exit": F.col("down"), "short_entry": F.col("down"), "short_exit": F.col("up")})
    cut = pieces(signals, most=300)
    columns = ["k", "pos", "ret", "equity", "entry_k", "entry_price", "exit_price", "direction", "exit_reason", "return_pct", "bars_held"]
    same(simulate.simulate(signals, x), simulate.simulate(signals, x, cut=cut), columns)


def test_a_position_held_throughout(bars):
    """One entry and no exit goes through all pieces; it ends with the data."""
    first = F.col("dt") == "2001-01-03"
    signals = bars.where("symbol = 'long'").withColumns({"long_entry": first, "long_exit": F.lit(False), "short_entry": F.lit(False), "short_exit": F.lit(False)})
    done = simulate.simulate(signals, cut=pieces(signals, most=600))
    closed = done.where("exit_reason IS NOT NULL").collect()
    assert [(r["entry_k"], r["exit_reason"], r["k"]) for r in closed] == [(3, "end-of-data", 2999)]


def test_account_in_pieces(spark):
    """Refusals depend on all fills before; pieces give what one pass gives, and what a plain account says."""
    rng = np.random.default_rng(8)
    rows = [(str(rng.choice(["a", "b"])), i, str(rng.choice(["BUY", "SELL", "HOLD"], p=[0.5, 0.45, 0.05])), float(rng.integers(0, 9)), float(rng.integers(1, 50)), None) for i in range(900)]
    fills = spark.createDataFrame(rows, "instrument string, seq long, side string, qty double, price double, extra int").repartition(4)
    cut = pieces(fills, "instrument", "seq", most=150)
    many = {(r["instrument"], r["seq"]): (r["status"], r["cash"], r["held"]) for r in book.traded(fills, 500.0, cut=cut).collect()}
    cash, held, want = {"a": 500.0, "b": 500.0}, {"a": 0.0, "b": 0.0}, {}
    for who, seq, side, qty, price, _ in rows:
        ok = qty > 0 and (side == "BUY" and qty * price <= cash[who] or side == "SELL" and qty <= held[who])
        if ok:
            way = 1 if side == "BUY" else -1
            cash[who], held[who] = cash[who] - way * qty * price, held[who] + way * qty
        want[who, seq] = "ok" if ok else "refused: not a trade" if side == "HOLD" or qty <= 0 else "refused: cash" if side == "BUY" else "refused: not held", cash[who], held[who]
    assert cut.many and many == want and len({s for s, *_ in want.values()}) == 4
    assert book.traded(fills.where("false"), 1.0).count() == 0


def test_account_runs_every_fill_once(spark, tmp_path, monkeypatch):
    """No piece is run from an assumed state; accounts that pause for pieces, or begin late, and one without a name go on from their own state."""
    fills = [(who, i, "SELL" if i % 3 == 2 else "BUY", float(i % 7), 1.0 + i % 5, None) for i in range(1200) for who in ("all", "pause", "late", None) if who == "all" or (i < 90 or i > 1000) == (who == "pause") and (who != "late" or i > 700)]
    fills = spark.createDataFrame(fills, "instrument string, seq long, side string, qty double, price double, extra int").repartition(4).cache()
    cut = pieces(fills, "instrument", "seq", most=100)
    step = book.relay

    def seen(rows, cut, run, schema):
        def noted(piece, state):
            with open(f"{tmp_path}/{piece['instrument'].iloc[0]}-{piece['seq'].iloc[0]}", "a") as f:
                f.write(f"{len(piece)}\n")
            return run(piece, state)

        return step(rows, cut, noted, schema)

    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one = order(book.traded(fills, 300.0))
    monkeypatch.setattr(book, "relay", seen)
    assert cut.count > 5 and order(book.traded(fills, 300.0, cut=cut)) == one
    runs = [f.read_text().split() for f in tmp_path.iterdir()]
    assert {len(r) for r in runs} == {1} and sum(int(r[0]) for r in runs) == fills.count() == len(one)
