"""Screener, quote, volume, candle and event-study queries over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators import candles, events, screener, volume
from ..operators.gram import gram
from ..plans.rules import parse_alert, parse_rule
from ..sources.views import BARS, bars
from ..streaming.bus import checked
from . import query, rounded, rounded_sql
from .indicators import LAG, RSI, W, frame, full

S = Series()
LAST = "row_number() OVER (PARTITION BY symbol ORDER BY dt DESC)"
BACK = {"ret_1d": 1, "ret_1w": 5, "ret_1mo": 21, "ret_3mo": 63}
METRICS = f"""{RSI}, rr AS (SELECT n.*, rsi.rsi_14, close / pc - 1 AS r FROM n JOIN (SELECT symbol, dt, rsi_14 FROM rsi) rsi USING (symbol, dt)),
 mt AS (SELECT symbol, close AS price, {', '.join(f'CASE WHEN k > {b} THEN close / lag(close, {b}) OVER {W}) - 1 END AS {a}' for a, b in BACK.items())}, rsi_14 AS rsi,
   CASE WHEN count(r) OVER {W} ROWS UNBOUNDED PRECEDING) > 2 THEN stddev_samp(r) OVER {W} ROWS UNBOUNDED PRECEDING) * sqrt(252.0) END AS vol_ann,
   close / max(close) {frame(126)} - 1 AS from_high, CASE WHEN count(volume) {frame(63)} >= 10 THEN volume / nullif(avg(volume) {frame(63)}, 0) END AS vol_surge,
   CASE WHEN close > {full('avg', 'close', 50)} THEN 1.0 ELSE 0.0 END AS above_sma50, CASE WHEN close > {full('avg', 'close', 200)} THEN 1.0 ELSE 0.0 END AS above_sma200, {LAST} AS rn FROM rr),
 metrics AS (SELECT symbol, price, ret_1d, ret_1w, ret_1mo, ret_3mo, rsi, vol_ann, from_high, vol_surge, CAST(above_sma50 AS DOUBLE) AS above_sma50, CAST(above_sma200 AS DOUBLE) AS above_sma200 FROM mt WHERE rn = 1)"""
NAMES = ("price", *BACK, "rsi", "vol_ann", "from_high", "vol_surge", "above_sma50", "above_sma200")


@query("screener_compute_metrics", rounded_sql(f"WITH {METRICS}\nSELECT * FROM metrics", *NAMES))
def compute_metrics(spark, sf_dir: str) -> DataFrame:
    return rounded(screener.metrics(bars(spark, sf_dir)))


@query("screener_run_screen", rounded_sql(f"WITH {METRICS}\nSELECT * FROM metrics WHERE rsi < 60 AND vol_ann > 0.1", *NAMES))
def run_screen(spark, sf_dir: str) -> DataFrame:
    return rounded(screener.screen(screener.metrics(bars(spark, sf_dir)), [parse_rule("rsi<60"), parse_rule("vol_ann > 0.1")]))


@query("screener_parse_rule", rounded_sql(f"WITH {METRICS}\nSELECT symbol, above_sma50 FROM metrics WHERE above_sma50 > 0.5", "above_sma50"))
def bare_rule(spark, sf_dir: str) -> DataFrame:
    return rounded(screener.screen(screener.metrics(bars(spark, sf_dir)), [parse_rule("above_sma50")]).select("symbol", "above_sma50"))


ALERTS = ("ECONOMY > 800", "LARGE rsi < 50", "PROMO vol_surge >= 0.5", "SMALL < 1", "MEDIUM rsi = 3")
HIT = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS alert, symbol, {c} AS value, coalesce({c} {o} {v}, FALSE) AS fired FROM metrics WHERE symbol = '{s}'"
    for i, (s, c, o, v) in enumerate((("ECONOMY", "price", ">", 800), ("LARGE", "rsi", "<", 50), ("PROMO", "vol_surge", ">=", 0.5), ("SMALL", "price", "<", 1), ("MEDIUM", "rsi", "=", 3)))
)


@query("alert_check_all", f"WITH {METRICS}\nSELECT alert, symbol, round(value, 6) + 0.0 AS value, fired FROM ({HIT}) t")
def alert_check_all(spark, sf_dir: str) -> DataFrame:
    """Alerts joined to the newest metrics of their symbols; each is compared by its own operator, all in one pass."""
    table = screener.metrics(bars(spark, sf_dir))
    values = table.unpivot("symbol", [F.col(c).cast("double").alias(c) for c in NAMES], "metric", "value")
    alerts = spark.createDataFrame([(i, a.symbol, a.metric, a.op, a.value) for i, a in enumerate(map(parse_alert, ALERTS))], "alert long, symbol string, metric string, op string, level double")
    return rounded(checked(values, alerts).select("alert", "symbol", "value", "fired"))


@query("last_quotes", rounded_sql(f"""WITH {BARS}, q AS (SELECT symbol, dt, close AS price, {LAG} AS prev_close, volume, high, low, {LAST} AS rn FROM bars)
SELECT symbol, dt, price, prev_close, price - prev_close AS change, coalesce(price / nullif(prev_close, 0) - 1, 0) * 100 AS change_pct, volume, high, low FROM q WHERE rn = 1""", "price", "prev_close", "change", "change_pct", "volume", "high", "low"))
def last_quotes(spark, sf_dir: str) -> DataFrame:
    return rounded(quotes(bars(spark, sf_dir)))


def quotes(b: DataFrame) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    two = b.withColumn("rn", F.row_number().over(newest)).where("rn <= 2").groupBy("symbol").agg(F.max(F.when(F.col("rn") == 1, F.struct("dt", "close", "volume", "high", "low"))).alias("l"), F.max(F.when(F.col("rn") == 2, F.col("close"))).alias("prev_close"))
    return two.select("symbol", "l.dt", F.col("l.close").alias("price"), "prev_close", (F.col("l.close") - F.col("prev_close")).alias("change"), (F.coalesce(F.try_divide("l.close", "prev_close") - 1, F.lit(0.0)) * 100).alias("change_pct"), "l.volume", "l.high", "l.low")


@query("quotes_priority_union", rounded_sql(f"""WITH {BARS}, q AS (SELECT symbol, close AS price, {LAST} AS rn FROM bars), a AS (SELECT symbol, price FROM q WHERE rn = 1 AND symbol < 'M'), b AS (SELECT symbol, price * 2 AS price FROM q WHERE rn = 1)
SELECT symbol, price, 'first' AS source FROM a UNION ALL SELECT symbol, price, 'second' FROM b WHERE symbol NOT IN (SELECT symbol FROM a)""", "price"))
def quotes_priority_union(spark, sf_dir: str) -> DataFrame:
    """Rows of the first source win; symbols it lacks come from the second."""
    q = quotes(bars(spark, sf_dir)).select("symbol", "price")
    a, b = q.where("symbol < 'M'").withColumn("source", F.lit("first")), q.select("symbol", (F.col("price") * 2).alias("price"), F.lit("second").alias("source"))
    return rounded(a.unionByName(b.join(a, "symbol", "left_anti")))


@query("bulk_day_change", rounded_sql(f"WITH {BARS}, q AS (SELECT symbol, close / {LAG} - 1 AS chg, {LAST} AS rn FROM bars)\nSELECT symbol, chg FROM q WHERE rn = 1", "chg"))
def bulk_day_change(spark, sf_dir: str) -> DataFrame:
    return rounded(quotes(bars(spark, sf_dir)).select("symbol", (F.col("price") / F.col("prev_close") - 1).alias("chg")))


@query("heatmap_sector_mean", rounded_sql(f"""WITH {BARS}, q AS (SELECT symbol, close / {LAG} - 1 AS chg, {LAST} AS rn FROM bars)
SELECT CASE WHEN symbol < 'M' THEN 'A-L' ELSE 'M-Z' END AS sector, avg(chg) AS mean_change, CAST(count(chg) AS BIGINT) AS priced FROM q WHERE rn = 1 GROUP BY 1""", "mean_change"))
def heatmap_sector_mean(spark, sf_dir: str) -> DataFrame:
    chg = quotes(bars(spark, sf_dir)).select(F.when(F.col("symbol") < "M", "A-L").otherwise("M-Z").alias("sector"), (F.col("price") / F.col("prev_close") - 1).alias("chg"))
    return rounded(chg.groupBy("sector").agg(F.avg("chg").alias("mean_change"), F.count("chg").alias("priced")))


@query("sparks", f"WITH {BARS}, q AS (SELECT symbol, dt, close, {LAST} AS rn FROM bars)\nSELECT symbol, rn AS back, round(close, 6) AS close FROM q WHERE rn <= 30")
def sparks(spark, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    return rounded(bars(spark, sf_dir).withColumn("back", F.row_number().over(newest).cast("long")).where("back <= 30").select("symbol", "back", "close"))


@query("history_window", rounded_sql(f"WITH {BARS}\nSELECT * FROM bars WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'", "open", "high", "low", "close", "volume"))
def history_window(spark, sf_dir: str) -> DataFrame:
    return rounded(bars(spark, sf_dir).where("dt BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'"))


@query("weekly_bars", rounded_sql(f"""WITH {BARS}
SELECT symbol, CAST(dt + CAST((12 - isodow(dt)) % 7 AS INTEGER) AS DATE) AS week, min_by(open, dt) AS open, max(high) AS high, min(low) AS low, max_by(close, dt) AS close FROM bars GROUP BY 1, 2""", "open", "high", "low", "close"))
def weekly_bars(spark, sf_dir: str) -> DataFrame:
    """Weeks end on Friday."""
    week = F.next_day(F.date_sub("dt", 1), "FRI")
    return rounded(bars(spark, sf_dir).groupBy("symbol", week.alias("week")).agg(F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close")))


B = "b AS (SELECT *, abs(close - open) AS body, close > open AS up, close < open AS dn, high - greatest(open, close) AS upper, least(open, close) - low AS lower, abs(close - open) / CASE WHEN high > low THEN high - low END AS share FROM bars)"
LAGS = ", ".join(f"lag({x}, {i}) OVER {W}) AS {x}{i}" for i in (1, 2) for x in ("open", "close", "body", "up", "dn", "share"))
STRONG = "share >= 0.6 AND share1 >= 0.6 AND share2 >= 0.6"
PAUSE = "body1 <= 0.3 * (body2 + body) / 2"
TESTS = {
    "doji": "share <= 0.1", "bullish marubozu": "share >= 0.9 AND up", "bearish marubozu": "share >= 0.9 AND dn",
    "hammer": "lower >= 2 * nullif(body, 0) AND upper <= 0.25 * nullif(body, 0)", "shooting star": "upper >= 2 * nullif(body, 0) AND lower <= 0.25 * nullif(body, 0)",
    "bullish engulfing": "up AND dn1 AND open < close1 AND close > open1", "bearish engulfing": "dn AND up1 AND open > close1 AND close < open1",
    "bullish harami": "up AND dn1 AND open > close1 AND close < open1", "bearish harami": "dn AND up1 AND open < close1 AND close > open1",
    "piercing line": "up AND dn1 AND open < close1 AND close > (open1 + close1) / 2 AND close < open1", "dark cloud cover": "dn AND up1 AND open > close1 AND close < (open1 + close1) / 2 AND close > open1",
    "morning star": f"dn2 AND {PAUSE} AND up AND close > (open2 + close2) / 2", "evening star": f"up2 AND {PAUSE} AND dn AND close < (open2 + close2) / 2",
    "three white soldiers": f"up2 AND up1 AND up AND {STRONG} AND close1 > close2 AND close > close1", "three black crows": f"dn2 AND dn1 AND dn AND {STRONG} AND close1 < close2 AND close < close1",
}
DETECT = f"{BARS}, {B}, l AS (SELECT *, {LAGS} FROM b), det AS (" + " UNION ALL ".join(f"SELECT symbol, dt, '{p}' AS pattern, '{candles.DIRECTIONS[p]}' AS direction FROM l WHERE {t}" for p, t in TESTS.items()) + ")"


@query("candles_detect_all", f"WITH {DETECT}\nSELECT * FROM det")
def candles_detect_all(spark, sf_dir: str) -> DataFrame:
    return candles.detect(bars(spark, sf_dir))


AHEAD = " UNION ALL ".join(f"SELECT symbol, dt, CAST({h} AS BIGINT) AS horizon, ln(lead(close, {h}) OVER {W})) - ln(close) AS fwd FROM bars" for h in (1, 3, 5))


@query("candles_pattern_record", rounded_sql(f"""WITH {DETECT}, a AS (SELECT * FROM ({AHEAD}) t WHERE fwd IS NOT NULL), base AS (SELECT symbol, horizon, 100 * avg(fwd) AS baseline_pct FROM a GROUP BY 1, 2)
SELECT symbol, pattern, horizon, CAST(count(*) AS BIGINT) AS n, 100 * avg(fwd) AS mean_pct, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, any_value(baseline_pct) AS baseline_pct
FROM a JOIN det USING (symbol, dt) JOIN base USING (symbol, horizon) GROUP BY 1, 2, 3""", "mean_pct", "hit_rate", "baseline_pct"))
def candles_pattern_record(spark, sf_dir: str) -> DataFrame:
    return rounded(candles.record(bars(spark, sf_dir)).select("symbol", "pattern", "horizon", "n", "mean_pct", "hit_rate", "baseline_pct"))


@query("candles_recent", f"WITH {DETECT}\nSELECT symbol, dt, pattern, direction FROM det JOIN (SELECT symbol, max(dt) AS last FROM bars GROUP BY symbol) m USING (symbol) WHERE dt >= last - 3")
def candles_recent(spark, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    last = b.groupBy("symbol").agg(F.max("dt").alias("last"))
    return candles.detect(b).join(last, "symbol").where(F.col("dt") >= F.date_sub("last", 3)).drop("last")


@query("candles_scan", f"""WITH {DETECT}, q AS (SELECT symbol, dt, close / {LAG} - 1 AS chg, {LAST} AS rn FROM bars)
SELECT symbol, dt, pattern, direction, round(chg, 6) + 0.0 AS chg FROM det JOIN q USING (symbol, dt) WHERE rn = 1""")
def candles_scan(spark, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    now = quotes(b).select("symbol", "dt", (F.col("price") / F.col("prev_close") - 1).alias("chg"))
    return rounded(candles.detect(b).join(now, ["symbol", "dt"]).orderBy(F.col("direction") == "neutral", F.desc(F.abs("chg"))))


Z = f"""{BARS}, r AS (SELECT symbol, dt, close, ln(close / {LAG}) AS r, row_number() OVER {W}) - 1 AS k FROM bars),
 z AS (SELECT *, r / CASE WHEN count(r) OVER {W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) = 63 THEN nullif(stddev_samp(r) OVER {W} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING), 0) END AS z FROM r)"""


@query("standardised_returns", rounded_sql(f"WITH {Z}\nSELECT symbol, dt, z FROM z", "z"))
def standardised_returns(spark, sf_dir: str) -> DataFrame:
    return rounded(events.standardised(bars(spark, sf_dir)).select("symbol", "dt", "z"))


@query("shock_days", rounded_sql(f"WITH {Z}\nSELECT symbol, dt, z FROM z WHERE z <= -2.0", "z"))
def shock_days(spark, sf_dir: str) -> DataFrame:
    return rounded(events.shocks(bars(spark, sf_dir)).select("symbol", "dt", "z"))


@query("drop_overlapping", f"""WITH RECURSIVE {Z}, e AS (SELECT symbol, k, row_number() OVER (PARTITION BY symbol ORDER BY k) AS i FROM z WHERE z <= -2.0),
 g AS (SELECT symbol, k, i, k AS kept, TRUE AS take FROM e WHERE i = 1 UNION ALL SELECT e.symbol, e.k, e.i, CASE WHEN e.k - g.kept > 10 THEN e.k ELSE g.kept END, e.k - g.kept > 10 FROM g JOIN e ON e.symbol = g.symbol AND e.i = g.i + 1)
SELECT symbol, k FROM g WHERE take""")
def drop_overlapping(spark, sf_dir: str) -> DataFrame:
    return events.spaced(events.shocks(bars(spark, sf_dir)).select("symbol", "k"), 10)


def spaced_sql(source: str, gap: int) -> str:
    """Named subqueries up to kp: the events of a source (z below -2) that come more than `gap` bars after the last one kept."""
    return f"""e AS (SELECT symbol, k, row_number() OVER (PARTITION BY symbol ORDER BY k) AS i FROM {source} WHERE z <= -2.0),
 g AS (SELECT symbol, k, i, k AS kept, TRUE AS take FROM e WHERE i = 1 UNION ALL SELECT e.symbol, e.k, e.i, CASE WHEN e.k - g.kept > {gap} THEN e.k ELSE g.kept END, e.k - g.kept > {gap} FROM g JOIN e ON e.symbol = g.symbol AND e.i = g.i + 1),
 kp AS (SELECT symbol, k, take FROM g WHERE take)"""


FIGURES = """CAST(count(own) AS BIGINT) AS n, 100 * avg(own) AS mean_pct, 100 * quantile_cont(own, 0.5) AS median_pct, avg(CASE WHEN own > 0 THEN 1.0 WHEN own <= 0 THEN 0.0 END) AS hit_rate,
 CASE WHEN count(own) > 2 AND stddev_samp(own) > 1e-12 THEN avg(own) / (stddev_samp(own) / sqrt(count(own))) END AS t,
 CAST(count(CASE WHEN k > 63 THEN 1 END) AS BIGINT) AS base_n, 100 * avg(CASE WHEN k > 63 THEN fwd END) AS base_mean_pct"""
COUNTED = ("mean_pct", "median_pct", "hit_rate", "t", "base_mean_pct")
FWD = " UNION ALL ".join(f"SELECT symbol, k, z, CAST({h} AS BIGINT) AS horizon, ln(lead(close, {h}) OVER {W})) - ln(close) AS fwd FROM z" for h in events.HORIZONS)


@query("event_study", rounded_sql(f"""WITH RECURSIVE {Z}, {spaced_sql('z', 21)}, f AS (SELECT t.*, CASE WHEN kp.take THEN fwd END AS own FROM ({FWD}) t LEFT JOIN kp ON kp.symbol = t.symbol AND kp.k = t.k WHERE fwd IS NOT NULL)
SELECT symbol, horizon, {FIGURES} FROM f GROUP BY symbol, horizon""", *COUNTED))
def event_study(spark, sf_dir: str) -> DataFrame:
    return rounded(events.study(bars(spark, sf_dir)))


@query("classify_today", rounded_sql(f"WITH {Z}\nSELECT symbol, max_by(z, dt) AS z, CASE WHEN max_by(z, dt) <= -2 THEN 'shock down' WHEN max_by(z, dt) >= 2 THEN 'shock up' ELSE 'normal' END AS label FROM z WHERE z IS NOT NULL GROUP BY symbol", "z"))
def classify_today(spark, sf_dir: str) -> DataFrame:
    last = events.standardised(bars(spark, sf_dir)).where("z IS NOT NULL").groupBy("symbol").agg(F.max_by("z", "dt").alias("z"))
    return rounded(last.withColumn("label", F.when(F.col("z") <= -2, "shock down").when(F.col("z") >= 2, "shock up").otherwise("normal")))


XFWD = " UNION ALL ".join(f"SELECT symbol, k, z, CAST({h} AS BIGINT) AS horizon, lead(total, {h}) OVER {W}) - total AS fwd FROM xt" for h in events.HORIZONS)


@query("excess_event_study", rounded_sql(f"""WITH RECURSIVE {Z}, mk AS (SELECT dt, ln(close / lag(close) OVER (ORDER BY dt)) AS market FROM bars WHERE symbol = 'ECONOMY'),
 xz AS (SELECT z.symbol, z.dt, z.z, z.r - mk.market AS ex, row_number() OVER (PARTITION BY z.symbol ORDER BY z.dt) - 1 AS k FROM z JOIN mk USING (dt) WHERE z.r IS NOT NULL AND market IS NOT NULL), xt AS (SELECT *, sum(ex) OVER {W} ROWS UNBOUNDED PRECEDING) AS total FROM xz),
 {spaced_sql('xz', 21)}, f AS (SELECT t.*, CASE WHEN kp.take THEN fwd END AS own FROM ({XFWD}) t LEFT JOIN kp ON kp.symbol = t.symbol AND kp.k = t.k WHERE fwd IS NOT NULL)
SELECT symbol, horizon, {FIGURES} FROM f GROUP BY symbol, horizon""", *COUNTED))
def excess_event_study(spark, sf_dir: str) -> DataFrame:
    """What follows shocks beyond what one symbol, the benchmark, does on the same days."""
    b = bars(spark, sf_dir)
    return rounded(events.excess_study(b, b.where("symbol = 'ECONOMY'").select("dt", "close")))


PROFILE = f"""{BARS}, sp AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY symbol),
 pf AS (SELECT symbol, CAST(i AS BIGINT) AS bin, lo + i * (hi - lo) / 24 AS low_edge, lo + (i + 1) * (hi - lo) / 24 AS high_edge,
   greatest(least(high, lo + (i + 1) * (hi - lo) / 24) - greatest(low, lo + i * (hi - lo) / 24), 0) / greatest(high - low, 1e-12) * volume AS part
   FROM bars JOIN sp USING (symbol) CROSS JOIN range(24) t(i)),
 prof AS (SELECT symbol, bin, low_edge, high_edge, sum(part) AS volume FROM pf GROUP BY 1, 2, 3, 4)"""


@query("volume_profile", rounded_sql(f"WITH {PROFILE}\nSELECT symbol, bin, volume FROM prof WHERE volume > 0", "volume", digits=4))
def volume_profile(spark, sf_dir: str) -> DataFrame:
    return rounded(volume.profile(bars(spark, sf_dir)).where("volume > 0").select("symbol", "bin", "volume"), 4)


@query("volume_poc", rounded_sql(f"WITH {PROFILE}\nSELECT symbol, min_by((low_edge + high_edge) / 2, (-volume, bin)) AS poc FROM prof GROUP BY symbol", "poc"))
def volume_poc(spark, sf_dir: str) -> DataFrame:
    return rounded(volume.value_area(volume.profile(bars(spark, sf_dir))).select("symbol", "poc"))


@query("volume_value_area", None)
def volume_value_area(spark, sf_dir: str) -> DataFrame:
    return rounded(volume.value_area(volume.profile(bars(spark, sf_dir), last=120)))


PRE = f"OVER {W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
DAYS = f"""{BARS}, dv AS (SELECT symbol, dt, (2 * close - low - high) / greatest(high - low, 1e-12) AS clv, coalesce(avg(volume) {PRE}, volume) AS av, volume,
   CASE WHEN count(volume) {PRE} > 2 THEN stddev_samp(volume) {PRE} END AS sd FROM bars),
 dd AS (SELECT symbol, dt, clv, CASE WHEN av > 0 THEN volume / av ELSE 1.0 END AS ratio, CASE WHEN sd > 0 THEN (volume - av) / sd ELSE 0.0 END AS z FROM dv)"""


@query("classify_day", rounded_sql(f"""WITH {DAYS}
SELECT symbol, dt, clv, ratio, z, CASE WHEN ratio > 1.5 AND clv > 0.3 THEN 'accumulation' WHEN ratio > 1.5 AND clv < -0.3 THEN 'distribution' WHEN ratio > 1.5 THEN 'churn' WHEN ratio < 0.6 THEN 'quiet' ELSE 'normal' END AS day_type FROM dd""", "clv", "ratio", "z"))
def classify_day(spark, sf_dir: str) -> DataFrame:
    return rounded(volume.day_types(bars(spark, sf_dir)).select("symbol", "dt", "clv", "ratio", "z", "day_type"))


@query("obv_divergence", f"""WITH {BARS}, s AS (SELECT symbol, dt, close, CASE WHEN close > {LAG} THEN volume WHEN close < {LAG} THEN -volume ELSE 0 END AS v, {LAST} AS back FROM bars),
 o AS (SELECT *, sum(v) OVER {W} ROWS UNBOUNDED PRECEDING) AS obv FROM s),
 t AS (SELECT symbol, count(*) AS n, avg(CASE WHEN back <= 20 THEN close END) - avg(CASE WHEN back BETWEEN 21 AND 40 THEN close END) AS p, avg(CASE WHEN back <= 20 THEN obv END) - avg(CASE WHEN back BETWEEN 21 AND 40 THEN obv END) AS f FROM o GROUP BY symbol)
SELECT symbol, CASE WHEN n < 42 THEN 'none' WHEN p > 0 AND f < 0 THEN 'bearish' WHEN p < 0 AND f > 0 THEN 'bullish' ELSE 'none' END AS divergence FROM t""")
def obv_divergence(spark, sf_dir: str) -> DataFrame:
    return volume.divergence(bars(spark, sf_dir))


DIVERGED = f"""s AS (SELECT symbol, dt, close, CASE WHEN close > {LAG} THEN volume WHEN close < {LAG} THEN -volume ELSE 0 END AS v, {LAST} AS back FROM bars),
 o AS (SELECT *, sum(v) OVER {W} ROWS UNBOUNDED PRECEDING) AS obv FROM s),
 t AS (SELECT symbol, count(*) AS n, avg(CASE WHEN back <= 20 THEN close END) - avg(CASE WHEN back BETWEEN 21 AND 40 THEN close END) AS p, avg(CASE WHEN back <= 20 THEN obv END) - avg(CASE WHEN back BETWEEN 21 AND 40 THEN obv END) AS f FROM o GROUP BY symbol),
 dg AS (SELECT symbol, CASE WHEN n < 42 THEN 'none' WHEN p > 0 AND f < 0 THEN 'bearish' WHEN p < 0 AND f > 0 THEN 'bullish' ELSE 'none' END AS divergence FROM t)"""


@query("analyze_volume", rounded_sql(f"""WITH {DAYS}, {PROFILE.replace(BARS + ', ', '', 1)}, {DIVERGED}, pc AS (SELECT symbol, min_by((low_edge + high_edge) / 2, (-volume, bin)) AS poc FROM prof GROUP BY symbol), l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM dd)
SELECT symbol, ratio, z, CASE WHEN ratio > 1.5 AND clv > 0.3 THEN 'accumulation' WHEN ratio > 1.5 AND clv < -0.3 THEN 'distribution' WHEN ratio > 1.5 THEN 'churn' WHEN ratio < 0.6 THEN 'quiet' ELSE 'normal' END AS day_type, divergence, poc, CASE WHEN ratio > 2.0 THEN 'surge' ELSE 'none' END AS note FROM l JOIN dg USING (symbol) JOIN pc USING (symbol) WHERE rn = 1""", "ratio", "z", "poc"))
def analyze_volume(spark, sf_dir: str) -> DataFrame:
    """The newest day's volume, what kind of day it is, whether price and volume diverge, and where most was traded."""
    b = bars(spark, sf_dir)
    newest = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    last = volume.day_types(b).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    both = last.select("symbol", "ratio", "z", "day_type").join(volume.divergence(b), "symbol").join(volume.value_area(volume.profile(b)).select("symbol", "poc"), "symbol")
    return rounded(both.withColumn("note", F.when(F.col("ratio") > 2, "surge").otherwise("none")))


@query("correlation_matrix", rounded_sql(f"""WITH {BARS}, r AS (SELECT symbol, dt, close / {LAG} - 1 AS r FROM bars)
SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS corr, CAST(count(*) AS BIGINT) AS n FROM r a JOIN r b ON a.dt = b.dt AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30""", "corr"))
def correlation_matrix(spark, sf_dir: str) -> DataFrame:
    """Pairs of symbols on the days both have, from blocked products of days and symbols."""
    r = bars(spark, sf_dir).withColumn("r", S.returns("close"))
    return rounded(gram(r).where("a < b AND n >= 30").select("a", "b", "corr", "n"))


@query("covariance_matrix", rounded_sql(f"""WITH {BARS}, r AS (SELECT symbol, dt, close / {LAG} - 1 AS r FROM bars)
SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.r, b.r) * 252 AS cov FROM r a JOIN r b ON a.dt = b.dt AND a.symbol <= b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""", "cov"))
def covariance_matrix(spark, sf_dir: str) -> DataFrame:
    """Annualised, of every pair of symbols and of each with itself."""
    r = bars(spark, sf_dir).withColumn("r", S.returns("close"))
    return rounded(gram(r).select("a", "b", (F.col("cov") * 252).alias("cov")))


@query("aligned_returns", rounded_sql(f"""WITH {BARS}, r AS (SELECT symbol, dt, close / {LAG} - 1 AS r FROM bars)
SELECT dt, CAST(count(r) AS BIGINT) AS n, avg(r) AS mean FROM r WHERE r IS NOT NULL GROUP BY dt""", "mean"))
def aligned_returns(spark, sf_dir: str) -> DataFrame:
    r = bars(spark, sf_dir).withColumn("r", S.returns("close")).where("r IS NOT NULL")
    return rounded(r.groupBy("dt").agg(F.count("r").alias("n"), F.avg("r").alias("mean")))
