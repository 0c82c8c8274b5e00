"""Backtest queries: the moving-average cross on bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators import backtest as bt
from ..sources.views import BARS, bars
from . import query, rounded, rounded_sql
from .indicators import LAG, W, full

S = Series()
KEY = ["symbol"]
BT = f"""{BARS}, sg AS (SELECT symbol, dt, close, row_number() OVER {W}) - 1 AS k, {LAG} AS pc,
  CASE WHEN {full('avg', 'close', 50)} IS NULL THEN 0.0 WHEN {full('avg', 'close', 20)} > {full('avg', 'close', 50)} THEN 1.0 ELSE -1.0 END AS sig FROM bars),
 ps AS (SELECT *, CAST(coalesce(lag(sig) OVER {W}), 0) AS DOUBLE) AS pos, coalesce(close / pc - 1, 0) AS chg FROM sg),
 rt AS (SELECT *, pos * chg - abs(pos - coalesce(lag(pos) OVER {W}), 0)) * 0.001 AS ret FROM ps),
 bt AS (SELECT symbol, dt, k, close, pos, ret, 10000.0 * product(1 + ret) OVER {W} ROWS UNBOUNDED PRECEDING) AS equity FROM rt)"""
TRADES = f"""{BT}, ch AS (SELECT *, pos <> coalesce(lag(pos) OVER {W}), 0) AS turned FROM bt),
 ent AS (SELECT symbol, dt AS entry_dt, k AS entry_k, close AS entry_price, CAST(sign(pos) AS BIGINT) AS direction FROM ch WHERE turned),
 nx AS (SELECT *, lead(entry_dt) OVER w AS xdt, lead(entry_k) OVER w AS xk, lead(entry_price) OVER w AS xp FROM ent WINDOW w AS (PARTITION BY symbol ORDER BY entry_k)),
 lst AS (SELECT symbol, max(dt) AS ldt, max(k) AS lk, max_by(close, k) AS lp FROM bt GROUP BY symbol),
 trades AS (SELECT symbol, entry_dt, coalesce(xdt, ldt) AS exit_dt, direction, entry_price, coalesce(xp, lp) AS exit_price,
   direction * (coalesce(xp, lp) / entry_price - 1) - 0.002 AS return_pct, coalesce(xk, lk) - entry_k AS bars_held FROM nx JOIN lst USING (symbol) WHERE direction <> 0)"""


def done(spark, sf_dir: str) -> DataFrame:
    return bt.run(bt.sma_cross(bars(spark, sf_dir), KEY), KEY)


@query("run_backtest", f"WITH {BT}\nSELECT symbol, dt, pos, round(ret, 6) + 0.0 AS ret, round(ln(equity), 6) + 0.0 AS log_equity FROM bt")
def run_backtest(spark, sf_dir: str) -> DataFrame:
    return rounded(done(spark, sf_dir).select("symbol", "dt", "pos", "ret", F.ln("equity").alias("log_equity")))


@query("extract_trades", rounded_sql(f"WITH {TRADES}\nSELECT * FROM trades", "entry_price", "exit_price", "return_pct"))
def extract_trades(spark, sf_dir: str) -> DataFrame:
    return rounded(bt.trades(done(spark, sf_dir), KEY))


METRIC_SQL = {
    "total_return": "max_by(equity, k) / 10000.0 - 1",
    "cagr": "CASE WHEN count(*) < 2 OR min_by(equity, k) <= 0 THEN 0.0 WHEN max_by(equity, k) / min_by(equity, k) <= 0 THEN -1.0 ELSE pow(max_by(equity, k) / min_by(equity, k), 252.0 / (count(*) - 1)) - 1 END",
    "sharpe": "CASE WHEN count(*) < 2 OR stddev_samp(ret) <= greatest(abs(avg(ret)), 1.0) * 1e-12 THEN 0.0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252.0) END",
    "sortino": "avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252.0)",
    "volatility": "stddev_samp(ret) * sqrt(252.0)",
    "max_drawdown": "min(dd)",
    "exposure": "avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0.0 END)",
}
MARKED = f"{TRADES}, md AS (SELECT *, equity / max(equity) OVER {W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bt)"
WIDE = f"{MARKED}, wide AS (SELECT symbol, {', '.join(f'CAST({s} AS DOUBLE) AS {n}' for n, s in METRIC_SQL.items())} FROM md GROUP BY symbol)"
PER_TRADE = "CAST(count(*) AS BIGINT) AS num_trades, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(CASE WHEN return_pct > 0 THEN return_pct ELSE 0 END) / nullif(-sum(CASE WHEN return_pct < 0 THEN return_pct ELSE 0 END), 0) AS profit_factor"
ALL = f"{WIDE}, tr AS (SELECT symbol, {PER_TRADE} FROM trades GROUP BY symbol), met AS (SELECT *, CASE WHEN max_drawdown = 0 THEN 0.0 ELSE cagr / abs(max_drawdown) END AS calmar FROM wide JOIN tr USING (symbol))"


@query("backtest_metrics", rounded_sql(f"WITH {ALL}\nSELECT * FROM met", *METRIC_SQL, "win_rate", "profit_factor", "calmar"))
def backtest_metrics(spark, sf_dir: str) -> DataFrame:
    return rounded(bt.metrics(done(spark, sf_dir), KEY))


for _name in (*METRIC_SQL, "calmar", "win_rate", "profit_factor"):

    def _one(spark, sf_dir: str, name=_name) -> DataFrame:
        return rounded(bt.metrics(done(spark, sf_dir), KEY).select("symbol", name))

    query(f"stat_{_name}", rounded_sql(f"WITH {ALL}\nSELECT symbol, {_name} FROM met", _name))(_one)


GRID = [(f, s) for f in (5, 10, 20) for s in (10, 20, 50)]


_GRID_SQL = f"""WITH {BARS}, pr AS (SELECT * FROM (VALUES (5, 10), (5, 20), (5, 50), (10, 20), (10, 50), (20, 50)) t(fast, slow)),
 n AS (SELECT *, row_number() OVER {W}) AS k, sum(close) OVER {W} ROWS UNBOUNDED PRECEDING) AS total FROM bars),
 g AS (SELECT CAST(fast AS BIGINT) AS fast, CAST(slow AS BIGINT) AS slow, n.symbol, n.dt, n.close, n.k - 1 AS k,
   CASE WHEN n.k >= slow THEN (n.total - coalesce(a.total, 0)) / fast - (n.total - coalesce(b.total, 0)) / slow END AS gap
   FROM n CROSS JOIN pr LEFT JOIN n a ON a.symbol = n.symbol AND a.k = n.k - fast LEFT JOIN n b ON b.symbol = n.symbol AND b.k = n.k - slow),
 sg AS (SELECT *, CASE WHEN gap IS NULL THEN 0.0 WHEN round(gap, 9) > 0 THEN 1.0 ELSE -1.0 END AS sig, lag(close) OVER (PARTITION BY fast, slow, symbol ORDER BY dt) AS pc FROM g),
 ps AS (SELECT *, CAST(coalesce(lag(sig) OVER (PARTITION BY fast, slow, symbol ORDER BY dt), 0) AS DOUBLE) AS pos, coalesce(close / pc - 1, 0) AS chg FROM sg),
 rt AS (SELECT *, pos * chg - abs(pos - coalesce(lag(pos) OVER (PARTITION BY fast, slow, symbol ORDER BY dt), 0)) * 0.001 AS ret FROM ps)
SELECT fast, slow, symbol, {METRIC_SQL['sharpe']} AS sharpe, {METRIC_SQL['volatility']} AS volatility FROM rt GROUP BY fast, slow, symbol"""
_SEARCHED = _GRID_SQL.replace("\nSELECT fast", ", gs AS (SELECT fast") + ")\nSELECT CAST(count(*) AS BIGINT) AS n_trials, round(stddev_samp(sharpe), 6) AS sharpe_sd FROM gs"


@query("grid_search", rounded_sql(_GRID_SQL, "sharpe", "volatility"))
def grid_search(spark, sf_dir: str) -> DataFrame:
    return rounded(bt.grid(bars(spark, sf_dir), GRID).select("fast", "slow", "symbol", "sharpe", "volatility"))


@query("trials_of", _SEARCHED)
def trials_of(spark, sf_dir: str) -> DataFrame:
    """How many runs a search made and how far their Sharpe ratios spread."""
    return rounded(bt.grid(bars(spark, sf_dir), GRID).agg(F.count(F.lit(1)).alias("n_trials"), F.stddev_samp("sharpe").alias("sharpe_sd")))
