"""Indicator queries over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators.recursive import with_recursive
from ..sources.views import BARS, bars
from . import query, rounded, rounded_sql

S = Series()
W = "(PARTITION BY symbol ORDER BY dt"


def frame(n: int) -> str:
    return f"OVER {W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {agg}({x}) {frame(n)} END"


def ema_sql(x: str, alpha: float, n: int, source: str, name: str, warm: int, at: str = "k") -> str:
    """Exponential mean as a weighted running sum; x is never NULL and k counts rows from 0. Good for some thousand rows."""
    return f"""CASE WHEN {at} >= {warm - 1} THEN pow({1 - alpha!r}, {at}) * sum({x} * CASE WHEN {at} = 0 THEN 1 ELSE {alpha!r} END * pow({1 - alpha!r}, -{at}))
  OVER {W} ROWS UNBOUNDED PRECEDING) END AS {name}"""


def over_bars(name: str, columns: dict[str, tuple], where: str | None = None) -> None:
    """A query of window columns over bars: name -> (maker of the Spark column, DuckDB expression)."""

    def run(spark, sf_dir: str) -> DataFrame:
        return rounded(bars(spark, sf_dir).select("symbol", "dt", *(c().alias(n) for n, (c, _) in columns.items())))

    query(name, rounded_sql(f"WITH {BARS}\nSELECT symbol, dt, " + ", ".join(f"{s} AS {n}" for n, (_, s) in columns.items()) + " FROM bars", *columns))(run)


LAG = f"lag(close) OVER {W})"
over_bars("sma", {"sma20": (lambda: S.sma("close", 20), full("avg", "close", 20))})
mid, dev = full("avg", "close", 20), full("stddev_pop", "close", 20)
over_bars("bollinger", {"middle": (lambda: S.bollinger("close")["middle"], mid), "upper": (lambda: S.bollinger("close")["upper"], f"{mid} + 2 * {dev}"), "lower": (lambda: S.bollinger("close")["lower"], f"{mid} - 2 * {dev}")})
over_bars("returns", {"r": (lambda: S.returns("close"), f"close / nullif({LAG}, 0) - 1")})
over_bars("log_returns", {"r": (lambda: S.log_returns("close"), f"ln(close / nullif({LAG}, 0))")})
over_bars("momentum", {"mom": (lambda: S.momentum("close"), f"close / nullif(lag(close, 63) OVER {W}), 0) - 1")})
over_bars("drawdown", {"dd": (lambda: S.drawdown("close"), f"close / max(close) OVER {W} ROWS UNBOUNDED PRECEDING) - 1")})
over_bars("true_range", {"tr": (lambda: S.true_range(), f"greatest(high - low, abs(high - {LAG}), abs(low - {LAG}))")})
over_bars("vwap", {"vwap": (lambda: S.vwap(), f"sum((high + low + close) / 3 * volume) OVER {W} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER {W} ROWS UNBOUNDED PRECEDING), 0)")})
over_bars("williams_r", {"wr": (lambda: S.williams_r(), f"-100 * ({full('max', 'high', 14)} - close) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0)")})
over_bars("realized_vol_parkinson", {"pk": (lambda: S.parkinson(), f"sqrt({full('avg', 'pow(ln(high / low), 2)', 21)} / (4 * ln(2.0)) * 252)")})
over_bars("feature_ret5", {"ret5": (lambda: S.momentum("close", 5), f"close / nullif(lag(close, 5) OVER {W}), 0) - 1")})
over_bars("feature_ret1", {"ret1": (lambda: S.returns("close"), f"close / nullif({LAG}, 0) - 1")})
over_bars("feature_range", {"rng": (lambda: (F.col("high") - F.col("low")) / F.col("close"), "(high - low) / close")})
over_bars("feature_zscore", {"z": (lambda: F.try_divide(F.col("close") - S.sma("close", 20), S.stdev("close", 20)), f"(close - {full('avg', 'close', 20)}) / nullif({full('stddev_samp', 'close', 20)}, 0)")})
over_bars("feature_volume_z", {"vz": (lambda: F.try_divide(F.col("volume") - S.sma("volume", 20), S.stdev("volume", 20)), f"(volume - {full('avg', 'volume', 20)}) / nullif({full('stddev_samp', 'volume', 20)}, 0)")})
over_bars("sma_cross_signal", {"signal": (lambda: F.when(S.sma("close", 50).isNull(), 0.0).when(S.sma("close", 20) > S.sma("close", 50), 1.0).otherwise(-1.0), f"CASE WHEN {full('avg', 'close', 50)} IS NULL THEN 0.0 WHEN {full('avg', 'close', 20)} > {full('avg', 'close', 50)} THEN 1.0 ELSE -1.0 END")})
over_bars("momentum_signal", {"signal": (lambda: F.coalesce(F.signum(S.momentum("close")), F.lit(0.0)), f"coalesce(CAST(sign(close / nullif(lag(close, 63) OVER {W}), 0) - 1) AS DOUBLE), 0.0)")})
over_bars("buy_hold_signal", {"signal": (lambda: F.lit(1.0), "CAST(1.0 AS DOUBLE)")})
over_bars("forward_cumulative", {f"fwd{h}": (lambda h=h: F.ln(S.lead("close", h)) - F.ln("close"), f"ln(lead(close, {h}) OVER {W})) - ln(close)") for h in (1, 3, 5)})
over_bars("highest_lowest", {"hi": (lambda: S.highest("high", 20), full("max", "high", 20)), "lo": (lambda: S.lowest("low", 20), full("min", "low", 20))})


@query("stochastic", rounded_sql(f"""WITH {BARS}, s AS (SELECT *, 100 * (close - {full('min', 'low', 14)}) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) AS k FROM bars)
SELECT symbol, dt, k, {full('avg', 'k', 3)} AS d FROM s""", "k", "d"))
def stochastic(spark, sf_dir: str) -> DataFrame:
    k = bars(spark, sf_dir).withColumn("k", S.stochastic_k())
    return rounded(k.select("symbol", "dt", "k", S.sma("k", 3).alias("d")))


SIGNED = f"CASE WHEN close > {LAG} THEN volume WHEN close < {LAG} THEN -volume ELSE 0 END"


@query("obv", f"""WITH {BARS}, s AS (SELECT symbol, dt, {SIGNED} AS v FROM bars)
SELECT symbol, dt, round(sum(v) OVER {W} ROWS UNBOUNDED PRECEDING), 6) AS obv FROM s""")
def obv(spark, sf_dir: str) -> DataFrame:
    signed = bars(spark, sf_dir).withColumn("v", F.coalesce(F.signum(F.col("close") - S.lag("close")), F.lit(0.0)) * F.col("volume"))
    return rounded(signed.select("symbol", "dt", F.sum("v").over(S.so_far).alias("obv")))


@query("cci", rounded_sql(f"""WITH {BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars),
 m AS (SELECT *, {full('avg', 'tp', 20)} AS mean, list(tp) {frame(20)} AS xs FROM t)
SELECT symbol, dt, (tp - mean) / nullif(0.015 * list_avg(list_transform(xs, lambda v: abs(v - mean))), 0) AS cci FROM m""", "cci"))
def cci(spark, sf_dir: str) -> DataFrame:
    typical = bars(spark, sf_dir).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    typical = typical.withColumn("mean", S.sma("typical", 20)).withColumn("xs", F.collect_list("typical").over(S.last(20)))
    mad = F.aggregate("xs", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("mean"))) / F.size("xs")
    return rounded(typical.select("symbol", "dt", F.try_divide(F.col("typical") - F.col("mean"), 0.015 * mad).alias("cci")))


@query("realized_vol_cc", rounded_sql(f"""WITH {BARS}, r AS (SELECT symbol, dt, ln(close / {LAG}) AS r FROM bars)
SELECT symbol, dt, {full('stddev_samp', 'r', 21)} * sqrt(252.0) AS rv FROM r""", "rv"))
def realized_vol_cc(spark, sf_dir: str) -> DataFrame:
    r = bars(spark, sf_dir).withColumn("r", S.log_returns("close"))
    return rounded(r.select("symbol", "dt", S.realized_vol("r", 21).alias("rv")))


@query("feature_vol20", rounded_sql(f"""WITH {BARS}, r AS (SELECT symbol, dt, close / {LAG} - 1 AS r FROM bars)
SELECT symbol, dt, {full('stddev_samp', 'r', 20)} AS vol20 FROM r""", "vol20"))
def feature_vol20(spark, sf_dir: str) -> DataFrame:
    r = bars(spark, sf_dir).withColumn("r", S.returns("close"))
    return rounded(r.select("symbol", "dt", S.stdev("r", 20).alias("vol20")))


NUMBERED = f"{BARS}, n AS (SELECT *, row_number() OVER {W}) - 1 AS k, {LAG} AS pc FROM bars)"


def recursive(name: str, asked: list[tuple[str, int]], sql: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return rounded(with_recursive(bars(spark, sf_dir), asked).select("symbol", "dt", *(f"{k}_{n}" for k, n in asked)))

    query(name, rounded_sql(sql, *(f"{k}_{n}" for k, n in asked)))(run)


recursive("ema", [("ema", 12)], f"WITH {NUMBERED}\nSELECT symbol, dt, {ema_sql('close', 2 / 13, 12, 'n', 'ema_12', 12)} FROM n")
RSI = f"""{NUMBERED}, c AS (SELECT *, k - 1 AS j, greatest(close - pc, 0) AS up, greatest(pc - close, 0) AS dn FROM n WHERE k > 0),
 g AS (SELECT symbol, dt, k, {ema_sql('up', 1 / 14, 14, 'c', 'au', 14, 'j')}, {ema_sql('dn', 1 / 14, 14, 'c', 'ad', 14, 'j')} FROM c),
 rsi AS (SELECT n.symbol, n.dt, n.k, n.close, CASE WHEN ad = 0 THEN 100.0 ELSE 100 - 100 / (1 + au / ad) END AS rsi_14 FROM n LEFT JOIN g USING (symbol, dt))"""
recursive("rsi", [("rsi", 14)], f"WITH {RSI}\nSELECT symbol, dt, rsi_14 FROM rsi")
MACD = f"""{NUMBERED}, e AS (SELECT symbol, dt, k, close, {ema_sql('close', 2 / 13, 12, 'n', 'f', 12)}, {ema_sql('close', 2 / 27, 26, 'n', 's', 26)} FROM n),
 l AS (SELECT symbol, dt, k - 25 AS j, f - s AS line FROM e WHERE k >= 25),
 g AS (SELECT symbol, dt, line, {ema_sql('line', 0.2, 9, 'l', 'sig', 1, 'j')} FROM l),
 macd AS (SELECT n.symbol, n.dt, n.k, n.close, g.line AS macd_26, g.sig AS macd_signal_9 FROM n LEFT JOIN g USING (symbol, dt))"""
recursive("macd", [("macd", 26), ("macd_signal", 9)], f"WITH {MACD}\nSELECT symbol, dt, macd_26, macd_signal_9 FROM macd")
ATR = f"{NUMBERED}, t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM n), atr AS (SELECT symbol, dt, k, {ema_sql('tr', 1 / 14, 14, 't', 'atr_14', 14)} FROM t)"
recursive("atr", [("atr", 14)], f"WITH {ATR}\nSELECT symbol, dt, atr_14 FROM atr")
recursive("adx", [("adx", 14)], f"""WITH {NUMBERED}, d AS (SELECT *, high - lag(high) OVER {W}) AS up, lag(low) OVER {W}) - low AS dn FROM n),
 m AS (SELECT symbol, dt, k, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS q, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM d),
 e AS (SELECT symbol, dt, k, {ema_sql('p', 1 / 14, 14, 'm', 'sp', 14)}, {ema_sql('q', 1 / 14, 14, 'm', 'sq', 14)}, {ema_sql('tr', 1 / 14, 14, 'm', 'st', 14)} FROM m),
 x AS (SELECT symbol, dt, k - 13 AS j, 100 * abs(100 * sp / st - 100 * sq / st) / (100 * sp / st + 100 * sq / st) AS dx FROM e WHERE k >= 13),
 g AS (SELECT symbol, dt, {ema_sql('dx', 1 / 14, 14, 'x', 'a', 14, 'j')} FROM x)
SELECT n.symbol, n.dt, g.a AS adx_14 FROM n LEFT JOIN g USING (symbol, dt)""")


def signal(name: str, asked: list[tuple[str, int]], make, sql: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return rounded(make(with_recursive(bars(spark, sf_dir), asked)).select("symbol", "dt", F.col("signal").cast("double").alias("signal")))

    query(name, rounded_sql(sql, "signal"))(run)


signal("ema_cross_signal", [("ema", 12), ("ema", 26)], lambda d: d.withColumn("signal", F.when(F.col("ema_26").isNull(), 0.0).when(F.col("ema_12") > F.col("ema_26"), 1.0).otherwise(-1.0)),
       f"WITH {NUMBERED}, e AS (SELECT symbol, dt, {ema_sql('close', 2 / 13, 12, 'n', 'f', 12)}, {ema_sql('close', 2 / 27, 26, 'n', 's', 26)} FROM n)\nSELECT symbol, dt, CAST(CASE WHEN s IS NULL THEN 0 WHEN f > s THEN 1 ELSE -1 END AS DOUBLE) AS signal FROM e")
signal("macd_trend_signal", [("macd", 26), ("macd_signal", 9)], lambda d: d.withColumn("signal", F.when(F.col("macd_26").isNull(), 0.0).when(F.round(F.col("macd_26") - F.col("macd_signal_9"), 9) > 0, 1.0).otherwise(-1.0)),
       f"WITH {MACD}\nSELECT symbol, dt, CAST(CASE WHEN macd_26 IS NULL THEN 0 WHEN round(macd_26 - macd_signal_9, 9) > 0 THEN 1 ELSE -1 END AS DOUBLE) AS signal FROM macd")


def held(d: DataFrame, raw, leave_long, leave_short, ready) -> DataFrame:
    """Marks carried forward, exits written over them, and carried forward again."""
    d = d.withColumn("raw", raw).withColumn("holding", F.last("raw", ignorenulls=True).over(S.so_far))
    exits = ((F.col("holding") == 1) & leave_long) | ((F.col("holding") == -1) & leave_short)
    d = d.withColumn("mark", F.when(F.coalesce(exits, F.lit(False)), 0.0).otherwise(F.col("raw")))
    return d.withColumn("signal", F.when(ready, F.coalesce(F.last("mark", ignorenulls=True).over(S.so_far), F.lit(0.0))).otherwise(0.0))


HELD = f"""h AS (SELECT *, last_value(raw IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING) AS holding FROM m),
 x AS (SELECT *, CASE WHEN (holding = 1 AND leave_long) OR (holding = -1 AND leave_short) THEN 0 ELSE raw END AS mark FROM h)
SELECT symbol, dt, CAST(CASE WHEN ready THEN coalesce(last_value(mark IGNORE NULLS) OVER {W} ROWS UNBOUNDED PRECEDING), 0) ELSE 0 END AS DOUBLE) AS signal FROM x"""
signal("rsi_reversion_signal", [("rsi", 14)], lambda d: held(d, F.when(F.col("rsi_14") < 30, 1.0).when(F.col("rsi_14") > 70, -1.0), F.col("rsi_14") > 50, F.col("rsi_14") < 50, F.col("rsi_14").isNotNull()),
       f"WITH {RSI}, m AS (SELECT symbol, dt, CASE WHEN rsi_14 < 30 THEN 1 WHEN rsi_14 > 70 THEN -1 END AS raw, rsi_14 > 50 AS leave_long, rsi_14 < 50 AS leave_short, rsi_14 IS NOT NULL AS ready FROM rsi), {HELD}")


@query("bollinger_breakout_signal", rounded_sql(f"""WITH {BARS}, q AS (SELECT symbol, dt, close, {mid} AS mid, {dev} AS dev FROM bars),
 m AS (SELECT symbol, dt, CASE WHEN close > mid + 2 * dev THEN 1 WHEN close < mid - 2 * dev THEN -1 END AS raw, close < mid AS leave_long, close > mid AS leave_short, mid IS NOT NULL AS ready FROM q), {HELD}""", "signal"))
def bollinger_breakout_signal(spark, sf_dir: str) -> DataFrame:
    d = bars(spark, sf_dir).withColumns({k: v for k, v in S.bollinger("close").items() if k != "pct_b"})
    close = F.col("close")
    out = held(d, F.when(close > F.col("upper"), 1.0).when(close < F.col("lower"), -1.0), close < F.col("middle"), close > F.col("middle"), F.col("middle").isNotNull())
    return rounded(out.select("symbol", "dt", "signal"))


@query("feature_rsi", rounded_sql(f"WITH {RSI}\nSELECT symbol, dt, (rsi_14 - 50) / 50 AS f FROM rsi", "f"))
def feature_rsi(spark, sf_dir: str) -> DataFrame:
    return rounded(with_recursive(bars(spark, sf_dir), [("rsi", 14)]).select("symbol", "dt", ((F.col("rsi_14") - 50) / 50).alias("f")))


@query("feature_ema_gap", rounded_sql(f"WITH {NUMBERED}, e AS (SELECT symbol, dt, {ema_sql('close', 2 / 13, 12, 'n', 'f', 12)}, {ema_sql('close', 2 / 27, 26, 'n', 's', 26)} FROM n)\nSELECT symbol, dt, f / s - 1 AS gap FROM e", "gap"))
def feature_ema_gap(spark, sf_dir: str) -> DataFrame:
    return rounded(with_recursive(bars(spark, sf_dir), [("ema", 12), ("ema", 26)]).select("symbol", "dt", (F.col("ema_12") / F.col("ema_26") - 1).alias("gap")))
