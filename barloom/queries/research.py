"""Research queries over an archive of option contracts: decay, clocks, expiry days, parity, news and participants.

The archive has a row for each day, expiry (this month's or the next one's), strike and right: close, volume and oi.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import options as op
from ..functions import text as tx
from ..functions.series import Series
from ..operators import book, events
from ..sources.views import BARS, PARTICIPANTS, bars, participants, table, trades
from . import query, rounded, rounded_sql
from .chains import cdf
from .indicators import LAG, W
from .market import Z
from .texts import SENT

S = Series()
DAY = "CAST(l_shipdate AS DATE)"
ARCHIVE = f"""lp AS (SELECT *, p_retailprice * (1 - l_discount) AS px FROM lineitem JOIN part ON l_partkey = p_partkey),
 con AS (SELECT CASE WHEN p_size <= 25 THEN 'NIFTY' ELSE 'BANK' END AS symbol, {DAY} AS dt, CASE WHEN l_linenumber <= 3 THEN last_day({DAY}) ELSE last_day({DAY} + INTERVAL 1 MONTH) END AS expiry, CAST(1000 + 20 * (p_size % 5) AS DOUBLE) AS strike, CASE l_returnflag WHEN 'A' THEN 'CE' ELSE 'PE' END AS right_, avg(l_extendedprice / 1000) AS close, sum(l_quantity) AS volume, count(*) AS oi FROM lp WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
 spt AS (SELECT CASE WHEN p_size <= 25 THEN 'NIFTY' ELSE 'BANK' END AS symbol, {DAY} AS dt, avg(px) AS spot FROM lp GROUP BY ALL),
 both_ AS (SELECT c.symbol, c.dt, c.expiry, c.strike, c.close AS ce, p.close AS pe, c.volume AS cv, p.volume AS pv, spot, date_diff('day', c.dt, c.expiry) AS dte FROM con c JOIN con p ON c.symbol = p.symbol AND c.dt = p.dt AND c.expiry = p.expiry AND c.strike = p.strike JOIN spt ON spt.symbol = c.symbol AND spt.dt = c.dt WHERE c.right_ = 'CE' AND p.right_ = 'PE'),
 atm AS (SELECT * EXCLUDE (rn), ce + pe AS straddle, (ce + pe) / spot / 0.8 / sqrt(greatest(dte, 1) / 365.0) AS iv FROM (SELECT *, row_number() OVER (PARTITION BY symbol, dt, expiry ORDER BY abs(strike - spot), strike) AS rn FROM both_) t WHERE rn = 1)"""


def underlying() -> Column:
    return F.when(F.col("p_size") <= 25, "NIFTY").otherwise("BANK").alias("symbol")


def contracts(spark, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    expiry = F.when(F.col("l_linenumber") <= 3, F.last_day(day)).otherwise(F.last_day(F.add_months(day, 1)))
    rows = trades(spark, sf_dir).where(F.col("l_returnflag").isin("A", "R"))
    keys = [underlying(), day.alias("dt"), expiry.alias("expiry"), (1000 + 20 * (F.col("p_size") % 5)).cast("double").alias("strike"), F.when(F.col("l_returnflag") == "A", "CE").otherwise("PE").alias("right_")]
    return rows.groupBy(*keys).agg(F.avg(F.col("l_extendedprice") / 1000).alias("close"), F.sum("l_quantity").alias("volume"), F.count(F.lit(1)).alias("oi"))


def both_sides(spark, sf_dir: str) -> DataFrame:
    """Calls joined to puts of the same day, expiry and strike, and to the day's spot."""
    c = contracts(spark, sf_dir)
    key = ["symbol", "dt", "expiry", "strike"]
    of = lambda right, px, v: c.where(F.col("right_") == right).select(*key, F.col("close").alias(px), F.col("volume").alias(v))
    spot = trades(spark, sf_dir).groupBy(underlying(), F.to_date("l_shipdate").alias("dt")).agg(F.avg("px").alias("spot"))
    return of("CE", "ce", "cv").join(of("PE", "pe", "pv"), key).join(spot, ["symbol", "dt"]).withColumn("dte", F.datediff("expiry", "dt"))


def atm_panel(spark, sf_dir: str) -> DataFrame:
    """The strike nearest to spot of each day and expiry, its straddle and the volatility that implies."""
    nearest = Window.partitionBy("symbol", "dt", "expiry").orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")
    rows = both_sides(spark, sf_dir).withColumn("rn", F.row_number().over(nearest)).where("rn = 1").drop("rn").withColumn("straddle", F.col("ce") + F.col("pe"))
    return rows.withColumn("iv", F.col("straddle") / F.col("spot") / 0.8 / F.sqrt(F.greatest("dte", F.lit(1)) / 365.0))


EDGES = ((-1, 5), (5, 10), (10, 20), (20, 40), (40, 70))
BUCKET = "CASE " + " ".join(f"WHEN dte > {a} AND dte <= {b} THEN '({a}, {b}]'" for a, b in EDGES) + " END"


def bucket() -> Column:
    """Of days to expiry; the right edge belongs to a bucket, the left one does not."""
    out = F.lit(None).cast("string")
    for a, b in EDGES:
        out = F.when((F.col("dte") > a) & (F.col("dte") <= b), f"({a}, {b}]").otherwise(out)
    return out.alias("bucket")


@query("atm_panel", rounded_sql(f"WITH {ARCHIVE}\nSELECT symbol, dt, expiry, strike, straddle, iv FROM atm", "straddle", "iv"))
def atm_panel_query(spark, sf_dir: str) -> DataFrame:
    return rounded(atm_panel(spark, sf_dir).select("symbol", "dt", "expiry", "strike", "straddle", "iv"))


@query("archive_coverage", f"WITH {ARCHIVE}\nSELECT symbol, expiry, min(dt) AS first, max(dt) AS last, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT strike) AS BIGINT) AS strikes, CAST(date_diff('day', max(dt), expiry) AS INTEGER) AS dte_last, max(dt) >= expiry AS observed FROM con GROUP BY 1, 2")
def archive_coverage(spark, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).groupBy("symbol", "expiry").agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.count(F.lit(1)).alias("n"), F.count_distinct("strike").alias("strikes"))
    return c.withColumns({"dte_last": F.datediff("expiry", "last"), "observed": F.col("last") >= F.col("expiry")})


@query("straddle_by_dte", rounded_sql(f"WITH {ARCHIVE}\nSELECT {BUCKET} AS bucket, CAST(count(*) AS BIGINT) AS n, avg(straddle) AS premium, avg(iv) AS iv, quantile_cont(cv + pv, 0.5) AS volume FROM atm GROUP BY 1", "premium", "iv", "volume", digits=3))
def straddle_by_dte(spark, sf_dir: str) -> DataFrame:
    return rounded(atm_panel(spark, sf_dir).groupBy(bucket()).agg(F.count(F.lit(1)).alias("n"), F.avg("straddle").alias("premium"), F.avg("iv").alias("iv"), F.percentile(F.col("cv") + F.col("pv"), 0.5).alias("volume")), 3)


VIX = "vx AS (SELECT CAST(l_shipdate AS DATE) AS dt, 10 + 100 * avg(l_tax) AS vix FROM lineitem GROUP BY 1)"
TDAYS = "(SELECT count(*) FROM range(1, 80) r(i) WHERE i <= dte AND isodow(dt + CAST(i AS INTEGER)) <= 5)"
CLOCK = f"""{ARCHIVE}, {VIX}, cal AS (SELECT dt AS d0, expiry AS e0, dte AS n0, (SELECT count(*) FROM range(1, 80) r(i) WHERE i <= dte AND isodow(dt + CAST(i AS INTEGER)) <= 5) AS tdays FROM (SELECT DISTINCT dt, expiry, dte FROM atm) u),
 ck AS (SELECT symbol, atm.dt, expiry, iv, vix, straddle / spot / 0.8 / sqrt(greatest(tdays, 1) / 252.0) AS iv_trading FROM atm JOIN vx USING (dt) JOIN cal ON d0 = atm.dt AND e0 = expiry)"""


def vix(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg((10 + 100 * F.avg("l_tax")).alias("vix"))


def clocked(spark, sf_dir: str) -> DataFrame:
    """Implied volatility by calendar days and by working days, with the day's index of volatility."""
    days = F.when(F.col("dte") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("dte", F.lit(1))), F.lit(0), lambda a, i: a + (F.weekday(F.date_add("dt", i)) < 5).cast("int"))).otherwise(0)
    p = atm_panel(spark, sf_dir).withColumn("tdays", days).join(vix(spark, sf_dir), "dt")
    return p.withColumn("iv_trading", F.col("straddle") / F.col("spot") / 0.8 / F.sqrt(F.greatest("tdays", F.lit(1)) / 252.0))


@query("clock_iv", rounded_sql(f"WITH {CLOCK}\nSELECT symbol, expiry, avg(iv_trading / iv) AS ratio, max_by(iv, dt) - min_by(iv, dt) AS change, max_by(iv_trading, dt) - min_by(iv_trading, dt) AS change_trading, avg(vix) AS vix FROM ck GROUP BY 1, 2", "ratio", "change", "change_trading", "vix"))
def clock_iv(spark, sf_dir: str) -> DataFrame:
    moved = lambda c: F.max_by(c, "dt") - F.min_by(c, "dt")
    return rounded(clocked(spark, sf_dir).groupBy("symbol", "expiry").agg(F.avg(F.col("iv_trading") / F.col("iv")).alias("ratio"), moved("iv").alias("change"), moved("iv_trading").alias("change_trading"), F.avg("vix").alias("vix")))


TERM = f"{CLOCK}, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, dt ORDER BY expiry) AS rn FROM ck), tm AS (SELECT a.symbol, a.dt, a.iv AS front, b.iv AS nxt, a.iv_trading AS front_t, b.iv_trading AS next_t FROM rk a JOIN rk b ON a.symbol = b.symbol AND a.dt = b.dt AND a.rn = 1 AND b.rn = 2)"


def term(spark, sf_dir: str) -> DataFrame:
    """The two nearest expiries of each day side by side."""
    by_expiry = Window.partitionBy("symbol", "dt").orderBy("expiry")
    r = clocked(spark, sf_dir).withColumn("rn", F.row_number().over(by_expiry))
    near, far = (r.where(F.col("rn") == n).select("symbol", "dt", F.col("iv").alias(a), F.col("iv_trading").alias(b)) for n, a, b in ((1, "front", "front_t"), (2, "nxt", "next_t")))
    return near.join(far, ["symbol", "dt"])


@query("expiry_spread", rounded_sql(f"WITH {TERM}\nSELECT symbol, dt, front - nxt AS spread FROM tm", "spread"))
def expiry_spread(spark, sf_dir: str) -> DataFrame:
    return rounded(term(spark, sf_dir).select("symbol", "dt", (F.col("front") - F.col("nxt")).alias("spread")))


@query("spread_on_one_clock", rounded_sql(f"WITH {TERM}\nSELECT symbol, CAST(count(*) AS BIGINT) AS n, avg(front_t - next_t) AS mean, corr(front_t, next_t) AS corr, avg(front_t - next_t) / (stddev_samp(front_t - next_t) / sqrt(count(*))) AS t FROM tm GROUP BY 1", "mean", "corr", "t"))
def spread_on_one_clock(spark, sf_dir: str) -> DataFrame:
    d = F.col("front_t") - F.col("next_t")
    return rounded(term(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.corr("front_t", "next_t").alias("corr"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1))))).alias("t")))


@query("cross_expiry", rounded_sql(f"WITH {TERM}, tc AS (SELECT *, front - lag(front) OVER (PARTITION BY symbol ORDER BY dt) AS df, nxt - lag(nxt) OVER (PARTITION BY symbol ORDER BY dt) AS dn FROM tm)\nSELECT symbol, CAST(count(*) AS BIGINT) AS n, corr(front, nxt) AS levels, corr(df, dn) AS changes FROM tc GROUP BY 1", "levels", "changes"))
def cross_expiry(spark, sf_dir: str) -> DataFrame:
    t = term(spark, sf_dir)
    t = t.withColumns({"df": F.col("front") - S.lag("front"), "dn": F.col("nxt") - S.lag("nxt")})
    return rounded(t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.corr("front", "nxt").alias("levels"), F.corr("df", "dn").alias("changes")))


@query("parity_error", rounded_sql(f"""WITH {ARCHIVE}, er AS (SELECT {BUCKET} AS bucket, 100 * (ce - pe - (spot - strike * exp(-0.065 * dte / 365.0))) / spot AS e FROM both_)
SELECT bucket, CAST(count(*) AS BIGINT) AS n, avg(e) AS mean, quantile_cont(e, 0.5) AS median, stddev_samp(e) AS sd, quantile_cont(e, 0.05) AS p5, quantile_cont(e, 0.95) AS p95, avg(CASE WHEN abs(e) > 0.2 THEN 1.0 ELSE 0.0 END) AS beyond FROM er GROUP BY 1""", "mean", "median", "sd", "p5", "p95", "beyond"))
def parity_error(spark, sf_dir: str) -> DataFrame:
    """Put-call parity: call less put against spot less the discounted strike, in percent of spot."""
    e = 100 * (F.col("ce") - F.col("pe") - (F.col("spot") - F.col("strike") * F.exp(-0.065 * F.col("dte") / 365.0))) / F.col("spot")
    rows = both_sides(spark, sf_dir).select(bucket(), e.alias("e"))
    return rounded(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.percentile("e", 0.5).alias("median"), F.stddev_samp("e").alias("sd"), F.percentile("e", 0.05).alias("p5"), F.percentile("e", 0.95).alias("p95"), F.avg((F.abs("e") > 0.2).cast("double")).alias("beyond")))


@query("candles_by_dte", f"WITH {ARCHIVE}, d AS (SELECT *, date_diff('day', dt, expiry) AS dte FROM con)\nSELECT {BUCKET} AS bucket, CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN volume > 20 THEN 1 END) AS BIGINT) AS traded, CAST(count(DISTINCT (symbol, expiry, strike, right_)) AS BIGINT) AS contracts, CAST(count(DISTINCT dt) AS BIGINT) AS dates FROM d GROUP BY 1")
def candles_by_dte(spark, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).withColumn("dte", F.datediff("expiry", "dt"))
    return c.groupBy(bucket()).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("volume") > 20).alias("traded"), F.count_distinct("symbol", "expiry", "strike", "right_").alias("contracts"), F.count_distinct("dt").alias("dates"))


D1 = "((ln(spot / strike) + (0.065 + 0.5 * iv0 * iv0) * t) / (iv0 * sqrt(t)))"
FROZEN = f"{ARCHIVE}, fz AS (SELECT *, first_value(iv) OVER (PARTITION BY symbol, expiry ORDER BY dt) AS iv0, greatest(dte, 1) / 365.0 AS t FROM atm), fd AS (SELECT *, {D1} AS d1, {D1} - iv0 * sqrt(t) AS d2, exp(-0.065 * t) AS b FROM fz)"


@query("decay_at_frozen_iv", rounded_sql(f"WITH {FROZEN}\nSELECT symbol, dt, expiry, straddle, spot * {cdf('d1')} - strike * b * {cdf('d2')} + strike * b * {cdf('-d2')} - spot * {cdf('-d1')} AS model, straddle / sqrt(greatest(dte, 1)) AS per_root_day FROM fd", "straddle", "model", "per_root_day", digits=1))
def decay_at_frozen_iv(spark, sf_dir: str) -> DataFrame:
    """A straddle against its price at the volatility of its first day."""
    first = F.first("iv").over(Window.partitionBy("symbol", "expiry").orderBy("dt"))
    p = atm_panel(spark, sf_dir).withColumns({"iv0": first, "t": F.greatest("dte", F.lit(1)) / 365.0})
    model = op.price("spot", "strike", "t", "iv0", F.lit(True)) + op.price("spot", "strike", "t", "iv0", F.lit(False))
    return rounded(p.select("symbol", "dt", "expiry", "straddle", model.alias("model"), (F.col("straddle") / F.sqrt(F.greatest("dte", F.lit(1)))).alias("per_root_day")), 1)


LOT = 65
TURN = f"{LOT} * (ce0 + pe0)"
CHARGES = f"(20.0 * 4 + 0.001 * {TURN} + 0.0003503 * 2 * {TURN} + 0.000001 * 2 * {TURN} + 0.00003 * {TURN} + 0.18 * (20.0 * 4 + 0.0003503 * 2 * {TURN} + 0.000001 * 2 * {TURN}))"


def charges(ce: str, pe: str) -> Column:
    """Round trip of a short straddle of one lot."""
    turn = LOT * (F.col(ce) + F.col(pe))
    open_to_tax = 4 * book.BROKERAGE + 2 * (book.EXCHANGE + book.SEBI) * turn
    return open_to_tax * (1 + book.GST) + (book.STT_SELL + book.STAMP_BUY) * turn


SHORT = """en AS (SELECT symbol, expiry, min_by(strike, dt) AS k0, min(dt) AS d0 FROM {panel} GROUP BY 1, 2), hd AS (SELECT b.symbol, b.expiry, b.dt, b.ce + b.pe AS straddle, first_value(b.ce) OVER w AS ce0, first_value(b.pe) OVER w AS pe0, lag(b.ce + b.pe) OVER w AS before, row_number() OVER (PARTITION BY b.symbol, b.expiry ORDER BY b.dt DESC) AS back, count(*) OVER (PARTITION BY b.symbol, b.expiry) AS n
   FROM both_ b JOIN en ON en.symbol = b.symbol AND en.expiry = b.expiry AND b.strike = k0 AND b.dt >= d0 WINDOW w AS (PARTITION BY b.symbol, b.expiry ORDER BY b.dt)),
 pn AS (SELECT symbol, expiry, dt, (before - straddle) * """ + str(LOT) + " - CASE WHEN back = 1 THEN " + CHARGES + " ELSE 0 END AS pnl FROM hd WHERE n >= 3 AND before IS NOT NULL)"


def short_straddle(panel: DataFrame, rows: DataFrame) -> DataFrame:
    """Daily result of a straddle sold at the strike of the panel's first day and held; charges fall on the last day."""
    entry = panel.groupBy("symbol", "expiry").agg(F.min_by("strike", "dt").alias("strike"), F.min("dt").alias("d0"))
    held = rows.join(entry, ["symbol", "expiry", "strike"]).where("dt >= d0").withColumn("straddle", F.col("ce") + F.col("pe"))
    whole = Window.partitionBy("symbol", "expiry")
    w = whole.orderBy("dt")
    held = held.withColumns({"ce0": F.first("ce").over(w), "pe0": F.first("pe").over(w), "before": F.lag("straddle").over(w), "last": F.max("dt").over(whole), "n": F.count(F.lit(1)).over(whole)})
    pnl = (F.col("before") - F.col("straddle")) * LOT - F.when(F.col("dt") == F.col("last"), charges("ce0", "pe0")).otherwise(0.0)
    return held.where("n >= 3 AND before IS NOT NULL").select("symbol", "expiry", "dt", pnl.alias("pnl"))


@query("short_straddle_pnl", rounded_sql(f"WITH {ARCHIVE}, {SHORT.format(panel='atm')}\nSELECT symbol, expiry, CAST(count(*) AS BIGINT) AS days, sum(pnl) AS pnl FROM pn GROUP BY 1, 2", "pnl", digits=3))
def short_straddle_pnl(spark, sf_dir: str) -> DataFrame:
    p = short_straddle(atm_panel(spark, sf_dir), both_sides(spark, sf_dir))
    return rounded(p.groupBy("symbol", "expiry").agg(F.count(F.lit(1)).alias("days"), F.sum("pnl").alias("pnl")), 3)


@query("short_straddle_from_panel", rounded_sql(f"WITH {ARCHIVE}, el AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, dt, expiry ORDER BY abs(strike - spot), strike) AS rn FROM both_ WHERE dte <= 21 AND cv > 0 AND pv > 0) t WHERE rn = 1), {SHORT.format(panel='el')}\nSELECT symbol, expiry, dt, pnl FROM pn", "pnl", digits=3))
def short_straddle_from_panel(spark, sf_dir: str) -> DataFrame:
    """Entered on the first day within 21 days of expiry on which both sides traded."""
    rows = both_sides(spark, sf_dir)
    nearest = Window.partitionBy("symbol", "dt", "expiry").orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")
    fit = rows.where("dte <= 21 AND cv > 0 AND pv > 0").withColumn("rn", F.row_number().over(nearest)).where("rn = 1")
    return rounded(short_straddle(fit, rows), 3)


FLAGS = f"""{BARS}, wk AS (SELECT symbol, dt, open, close, close / {LAG} - 1 AS r, isodow(dt) - 1 AS dow, CAST(date_trunc('week', dt) AS DATE) AS week FROM bars), tg AS (SELECT *, CASE WHEN dt < DATE '1996-01-01' THEN 3 ELSE 1 END AS tgt FROM wk),
 wl AS (SELECT *, dow <= tgt AND dt = max(CASE WHEN dow <= tgt THEN dt END) OVER (PARTITION BY symbol, week) AS weekly FROM tg), fl AS (SELECT *, weekly AND dt = max(CASE WHEN weekly THEN dt END) OVER (PARTITION BY symbol, date_trunc('month', dt)) AS monthly FROM wl)"""


def expiry_flags(rows: DataFrame, switch: str = "1996-01-01") -> DataFrame:
    """Adds weekly and monthly: the last trading day of a week up to its era's weekday (Thursday, later Tuesday), and the last such day of a month."""
    fits = F.weekday("dt") <= F.when(F.col("dt") < F.lit(switch).cast("date"), 3).otherwise(1)
    week, month = Window.partitionBy("symbol", F.trunc("dt", "WEEK")), Window.partitionBy("symbol", F.trunc("dt", "MM"))
    rows = rows.withColumn("weekly", F.coalesce(fits & (F.col("dt") == F.max(F.when(fits, F.col("dt"))).over(week)), F.lit(False)))
    return rows.withColumn("monthly", F.coalesce(F.col("weekly") & (F.col("dt") == F.max(F.when(F.col("weekly"), F.col("dt"))).over(month)), F.lit(False)))


def flagged(spark, sf_dir: str) -> DataFrame:
    return expiry_flags(bars(spark, sf_dir).withColumn("r", S.returns("close")))


@query("expiry_flags", f"WITH {FLAGS}\nSELECT symbol, dt, coalesce(weekly, FALSE) AS weekly, coalesce(monthly, FALSE) AS monthly FROM fl")
def expiry_flags_query(spark, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("symbol", "dt", "weekly", "monthly")


@query("expiry_moves", rounded_sql(f"""WITH {FLAGS}, ab AS (SELECT symbol, coalesce(monthly, FALSE) AS e, abs(close / open - 1) AS m FROM fl),
 st AS (SELECT symbol, count(CASE WHEN e THEN 1 END) AS n, avg(CASE WHEN e THEN m END) AS m1, avg(CASE WHEN NOT e THEN m END) AS m2, var_samp(CASE WHEN e THEN m END) / count(CASE WHEN e THEN 1 END) + var_samp(CASE WHEN NOT e THEN m END) / count(CASE WHEN NOT e THEN 1 END) AS v, avg(CASE WHEN e THEN greatest(m - 0.01, 0) END) AS payout FROM ab GROUP BY 1)
SELECT symbol, CAST(n AS BIGINT) AS n, m1 AS mean_expiry, m2 AS mean_other, m1 / m2 AS ratio, (m1 - m2) / sqrt(v) AS welch_t, payout FROM st""", "mean_expiry", "mean_other", "ratio", "welch_t", "payout"))
def expiry_moves(spark, sf_dir: str) -> DataFrame:
    """Open-to-close moves of expiry days against other days, by Welch's t, and what lies beyond one percent."""
    m = F.abs(F.col("close") / F.col("open") - 1)
    d = flagged(spark, sf_dir).select("symbol", F.when(F.col("monthly"), m).alias("e"), F.when(~F.col("monthly"), m).alias("o"))
    a = d.groupBy("symbol").agg(F.count("e").alias("n"), F.avg("e").alias("mean_expiry"), F.avg("o").alias("mean_other"), (F.var_samp("e") / F.count("e") + F.var_samp("o") / F.count("o")).alias("v"), F.avg(F.greatest(F.col("e") - 0.01, F.when(F.col("e").isNotNull(), F.lit(0.0)))).alias("payout"))
    gap = F.col("mean_expiry") - F.col("mean_other")
    return rounded(a.select("symbol", "n", "mean_expiry", "mean_other", (F.col("mean_expiry") / F.col("mean_other")).alias("ratio"), (gap / F.sqrt("v")).alias("welch_t"), "payout"))


def futures_rt_bps(notional: Column) -> Column:
    """Round trip of a future in hundredths of a percent of its value. Fixed charges: two orders, sale, exchange, regulator, stamp, tax."""
    taxed = 40.0 + (0.0000173 + 0.000001) * 2 * notional
    return (taxed * 1.18 + (0.0002 + 0.00002) * notional) / notional * 1e4


BPS = "(40.0 + 0.0002 * {0} + 0.0000173 * 2 * {0} + 0.000001 * 2 * {0} + 0.00002 * {0} + 0.18 * (40.0 + 0.0000173 * 2 * {0} + 0.000001 * 2 * {0})) / {0} * 1e4"


@query("futures_rt_bps", rounded_sql(f"WITH {BARS}\nSELECT symbol, dt, {BPS.format('(close * 65)')} AS bps FROM bars", "bps"))
def futures_bps(spark, sf_dir: str) -> DataFrame:
    return rounded(bars(spark, sf_dir).select("symbol", "dt", futures_rt_bps(F.col("close") * LOT).alias("bps")))


@query("expiry_drift", rounded_sql(f"WITH {FLAGS}, dr AS (SELECT symbol, r - {BPS.format('(close * 65)')} / 1e4 AS net, r FROM fl WHERE monthly AND r IS NOT NULL)\nSELECT symbol, CAST(count(*) AS BIGINT) AS n, avg(r) AS gross, avg(net) AS net, avg(net) / (stddev_samp(net) / sqrt(count(*))) AS t FROM dr GROUP BY 1", "gross", "net", "t"))
def expiry_drift(spark, sf_dir: str) -> DataFrame:
    """Returns of expiry days, before and after a future's round trip."""
    d = flagged(spark, sf_dir).where("monthly AND r IS NOT NULL").withColumn("net", F.col("r") - futures_rt_bps(F.col("close") * LOT) / 1e4)
    return rounded(d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("gross"), F.avg("net").alias("net"), (F.avg("net") / (F.stddev_samp("net") / F.sqrt(F.count(F.lit(1))))).alias("t")))


@query("shortest_expiry", rounded_sql(f"WITH {ARCHIVE}, sh AS (SELECT dt, min(date_diff('day', dt, expiry)) AS dte FROM con GROUP BY dt)\nSELECT CAST(date_trunc('month', dt) AS DATE) AS month, quantile_cont(CAST(dte AS DOUBLE), 0.5) AS median FROM sh GROUP BY 1", "median"))
def shortest_expiry(spark, sf_dir: str) -> DataFrame:
    near = contracts(spark, sf_dir).groupBy("dt").agg(F.min(F.datediff("expiry", "dt")).alias("dte"))
    return rounded(near.groupBy(F.trunc("dt", "MM").alias("month")).agg(F.percentile("dte", 0.5).alias("median")))


@query("symbols_to_backfill", "SELECT DISTINCT c_mktsegment AS symbol FROM customer WHERE c_mktsegment NOT IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey <= 2)")
def symbols_to_backfill(spark, sf_dir: str) -> DataFrame:
    """What is asked for and not yet stored."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    return c.select("symbol").distinct().join(c.where("c_custkey <= 2").select("symbol").distinct(), "symbol", "left_anti")


REGIME = f"""{ARCHIVE}, {VIX}, ld AS (SELECT symbol, spt.dt, vix, spot, ln(spot / lag(spot) OVER (PARTITION BY symbol ORDER BY spt.dt)) AS r FROM spt JOIN vx USING (dt)),
 rv AS (SELECT *, CASE WHEN count(r) OVER w21 = 21 THEN stddev_samp(r) OVER w21 END * sqrt(252.0) * 100 AS rv21 FROM ld WINDOW w21 AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
 gp AS (SELECT *, vix - lag(rv21) OVER (PARTITION BY symbol ORDER BY dt) AS gap, 0.7979 * spot * (vix * 0.9 / 100) * sqrt(21 / 252.0) - abs(lead(spot, 21) OVER (PARTITION BY symbol ORDER BY dt) - spot) AS pnl FROM rv)"""


def regime(spark, sf_dir: str) -> DataFrame:
    """The index of volatility beside spot: realised volatility up to the day before, the gap, and what a straddle sold for 21 days made."""
    spot = trades(spark, sf_dir).groupBy(underlying(), F.to_date("l_shipdate").alias("dt")).agg(F.avg("px").alias("spot"))
    d = spot.join(vix(spark, sf_dir), "dt").withColumn("r", S.log_returns("spot"))
    d = d.withColumn("rv21", S.stdev("r", 21) * math.sqrt(252.0) * 100)
    sold = 0.7979 * F.col("spot") * (F.col("vix") * 0.9 / 100) * math.sqrt(21 / 252.0)
    return d.withColumns({"gap": F.col("vix") - S.lag("rv21"), "pnl": sold - F.abs(S.lead("spot", 21) - F.col("spot"))})


@query("vix_and_spot", rounded_sql(f"WITH {REGIME}\nSELECT symbol, dt, vix, rv21, gap, pnl FROM gp", "vix", "rv21", "gap", "pnl"))
def vix_and_spot(spark, sf_dir: str) -> DataFrame:
    return rounded(regime(spark, sf_dir).select("symbol", "dt", "vix", "rv21", "gap", "pnl"))


@query("rich_regime", rounded_sql(f"""WITH {REGIME}, th AS (SELECT *, CASE WHEN count(gap) OVER w >= 500 THEN quantile_cont(gap, 2 / 3.0) OVER w END AS threshold, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i FROM gp WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, dt, threshold, coalesce(gap > threshold, FALSE) AS rich FROM th WHERE i % 21 = 0""", "threshold", digits=5))
def rich_regime(spark, sf_dir: str) -> DataFrame:
    """Is the gap above the upper third of all gaps before, once there are 500; every 21st day, so holdings do not overlap."""
    before = S.w.rowsBetween(Window.unboundedPreceding, -1)
    d = regime(spark, sf_dir).withColumns({"threshold": F.when(F.count("gap").over(before) >= 500, F.percentile("gap", 2 / 3).over(before)), "i": F.row_number().over(S.w) - 1})
    return rounded(d.where("i % 21 = 0").select("symbol", "dt", "threshold", F.coalesce(F.col("gap") > F.col("threshold"), F.lit(False)).alias("rich")), 5)


@query("report_noise", rounded_sql(f"""WITH {CLOCK}, lv AS (SELECT symbol, dt, avg(iv) AS x, avg(iv) - avg(iv_trading) AS off FROM ck GROUP BY 1, 2), lg AS (SELECT *, lag(x) OVER (PARTITION BY symbol ORDER BY dt) AS px FROM lv),
 ns AS (SELECT symbol, 0.5 * var_samp(off) / 2.0 AS noise, var_samp(x) AS level, var_samp(x - px) AS change, regr_slope(x, px) AS phi FROM lg GROUP BY 1)
SELECT symbol, noise, level, change, phi, phi * level / (level - noise) AS phi_corrected FROM ns""", "noise", "level", "change", "phi", "phi_corrected"))
def report_noise(spark, sf_dir: str) -> DataFrame:
    """How much of a series is the noise of its estimate (from two estimates of each day), and its autoregression with and without it."""
    lv = clocked(spark, sf_dir).groupBy("symbol", "dt").agg(F.avg("iv").alias("x"), (F.avg("iv") - F.avg("iv_trading")).alias("off"))
    lv = lv.withColumn("px", S.lag("x"))
    n = lv.groupBy("symbol").agg((0.5 * F.var_samp("off") / 2.0).alias("noise"), F.var_samp("x").alias("level"), F.var_samp(F.col("x") - F.col("px")).alias("change"), F.regr_slope("x", "px").alias("phi"))
    return rounded(n.withColumn("phi_corrected", F.col("phi") * F.col("level") / (F.col("level") - F.col("noise"))))


@query("load_panel", "SELECT event_id, 'events' AS symbol, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS local_day FROM events")
def load_panel(spark, sf_dir: str) -> DataFrame:
    """The symbol is the name of the file that a row is from, the day is that of Indian time."""
    name = F.regexp_extract(F.input_file_name(), r"([a-z]+)\.parquet", 1)
    return table(spark, sf_dir, "events").select("event_id", name.alias("symbol"), F.to_date(F.from_utc_timestamp("ts", "Asia/Kolkata")).alias("local_day"))


@query("load_contracts", f"WITH {ARCHIVE}\nSELECT symbol, dt, expiry, strike, right_, CAST(date_diff('day', dt, expiry) AS INTEGER) AS dte FROM con WHERE date_diff('day', dt, expiry) >= 0")
def load_contracts(spark, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir).withColumn("dte", F.datediff("expiry", "dt")).where("dte >= 0")
    return c.select("symbol", "dt", "expiry", "strike", "right_", "dte")


#: Charges of a short leg at premium p: a share of turnover, and a fixed part (one order, or two with the round trip).
KEPT = "(0.001 + 0.0003503 + 0.000001 + 0.18 * (0.0003503 + 0.000001))"


@query("breakeven_premium", f"SELECT p_partkey, round((20.0 * 1.18 + p_size * {LOT}) / ({LOT} * (1 - {KEPT})), 5) AS premium FROM part")
def breakeven_premium(spark, sf_dir: str) -> DataFrame:
    """The premium at which a short leg that expires earns its payout and charges: halving an interval 60 times."""
    def cost(p: Column) -> Column:
        turn = p * LOT
        taxed = book.BROKERAGE + (book.EXCHANGE + book.SEBI) * turn
        return taxed * (1 + book.GST) + book.STT_SELL * turn

    def step(a: Column, _: Column) -> Column:
        p = (a["lo"] + a["hi"]) / 2
        gain = (p - F.col("p_size")) * LOT - cost(p) > 0
        return F.struct(F.when(gain, a["lo"]).otherwise(p).alias("lo"), F.when(gain, p).otherwise(a["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(0.01).alias("lo"), F.lit(500.0).alias("hi")), step, lambda a: (a["lo"] + a["hi"]) / 2)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", found.alias("premium")), 5)


GRADE = f"""{BARS}, gd AS (SELECT symbol, dt, CASE WHEN (2 * close - low - high) / greatest(high - low, 1e-12) > 0.3 THEN 'strong close' WHEN (2 * close - low - high) / greatest(high - low, 1e-12) < -0.3 THEN 'weak close' ELSE 'none' END AS claim, lead(close) OVER {W}) / close - 1 AS nxt FROM bars),
 gv AS (SELECT claim, CASE WHEN nxt IS NULL THEN 'open' WHEN (claim = 'strong close' AND nxt > 0) OR (claim = 'weak close' AND nxt < 0) THEN 'right' ELSE 'wrong' END AS verdict FROM gd WHERE claim <> 'none')"""


@query("grade_claims", f"WITH {GRADE}\nSELECT claim, verdict, CAST(count(*) AS BIGINT) AS n FROM gv GROUP BY 1, 2")
def grade_claims(spark, sf_dir: str) -> DataFrame:
    """A day's claim against the next bar."""
    clv = (2 * F.col("close") - F.col("low") - F.col("high")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    claim = F.when(clv > 0.3, "strong close").when(clv < -0.3, "weak close").otherwise("none")
    d = bars(spark, sf_dir).select("symbol", "dt", claim.alias("claim"), (S.lead("close") / F.col("close") - 1).alias("nxt")).where("claim != 'none'")
    right = ((F.col("claim") == "strong close") & (F.col("nxt") > 0)) | ((F.col("claim") == "weak close") & (F.col("nxt") < 0))
    return d.groupBy("claim", F.when(F.col("nxt").isNull(), "open").when(right, "right").otherwise("wrong").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


NEWS = f"""{Z}, {SENT}, nd AS (SELECT DATE '1993-01-01' + CAST(doc_id * 7 % 2000 AS INTEGER) AS day, avg(score) AS score, count(*) AS c FROM sent GROUP BY 1),
 sk AS (SELECT symbol, dt, z, ln(lead(close, 5) OVER {W}) / close) AS fwd FROM z), sh AS (SELECT * FROM sk WHERE abs(z) >= 2 AND fwd IS NOT NULL),
 rx AS (SELECT symbol, dt, any_value(fwd) AS fwd, sum(score * c) / sum(c) AS mood FROM sh LEFT JOIN nd ON day BETWEEN dt - 1 AND dt GROUP BY 1, 2),
 fx AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY symbol) AS excess, CASE WHEN mood IS NULL THEN 'no news' WHEN mood > 0.05 THEN 'good' WHEN mood < -0.05 THEN 'bad' ELSE 'flat' END AS bucket FROM rx)"""


@query("news_reaction", rounded_sql(f"WITH {NEWS}\nSELECT bucket, CAST(count(*) AS BIGINT) AS n, avg(excess) AS mean, CASE WHEN count(*) >= 3 AND stddev_samp(excess) > 0 THEN avg(excess) / (stddev_samp(excess) / sqrt(count(*))) END AS t FROM fx GROUP BY 1", "mean", "t"))
def news_reaction(spark, sf_dir: str) -> DataFrame:
    """What follows shock days, over the symbol's own mean, by the mood of the news of the day and the day before.

    Each day of news is dealt to the two days it counts for, so the interval is an equality join.
    """
    from .texts import spiced

    day = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("doc_id") * 7 % 2000).cast("int"))
    mood = spiced(spark, sf_dir).select(day.alias("day"), tx.sentiment(F.col("title"))["score"].alias("score"))
    mood = mood.withColumn("dt", F.explode(F.array("day", F.date_add("day", 1)))).groupBy("dt").agg(F.avg("score").alias("mood"))
    z = events.standardised(bars(spark, sf_dir)).withColumn("fwd", F.ln(S.lead("close", 5) / F.col("close")))
    shock = z.where((F.abs("z") >= 2) & F.col("fwd").isNotNull()).join(mood, "dt", "left")
    shock = shock.withColumn("excess", F.col("fwd") - F.avg("fwd").over(Window.partitionBy("symbol")))
    named = F.when(F.col("mood").isNull(), "no news").when(F.col("mood") > 0.05, "good").when(F.col("mood") < -0.05, "bad").otherwise("flat")
    n, sd = F.count(F.lit(1)), F.stddev_samp("excess")
    return rounded(shock.groupBy(named.alias("bucket")).agg(n.alias("n"), F.avg("excess").alias("mean"), F.when((n >= 3) & (sd > 0), F.avg("excess") / (sd / F.sqrt(n))).alias("t")))


SIGNAL = f"""{BARS}, {PARTICIPANTS}, op AS (SELECT symbol, dt, ln(lead(open, 2) OVER {W}) / lead(open, 1) OVER {W})) AS fwd FROM bars), ps AS (SELECT client_type, symbol, dt, fwd, idx_fut_net AS x FROM op JOIN participants USING (dt) WHERE fwd IS NOT NULL),
 eg AS (SELECT client_type, symbol, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM ps GROUP BY 1, 2), bk AS (SELECT client_type, symbol, fwd, CASE WHEN x <= q1 THEN 1 WHEN x <= q2 THEN 2 WHEN x <= q3 THEN 3 ELSE 4 END AS quartile FROM ps JOIN eg USING (client_type, symbol))"""


@query("participant_signal", rounded_sql(f"WITH {SIGNAL}\nSELECT client_type, symbol, CAST(quartile AS INTEGER) AS quartile, CAST(count(*) AS BIGINT) AS n, avg(fwd) AS mean, CASE WHEN count(*) >= 8 AND stddev_samp(fwd) > 0 THEN avg(fwd) / (stddev_samp(fwd) / sqrt(count(*))) END AS t FROM bk GROUP BY 1, 2, 3", "mean", "t"))
def participant_signal(spark, sf_dir: str) -> DataFrame:
    """The next day's open-to-open return by quartile of each class's position: edges are quantiles, so equal positions fall together."""
    fwd = bars(spark, sf_dir).select("symbol", "dt", F.ln(S.lead("open", 2) / S.lead("open", 1)).alias("fwd")).where("fwd IS NOT NULL")
    rows = fwd.join(participants(spark, sf_dir).select("client_type", "dt", F.col("idx_fut_net").alias("x")), "dt")
    edges = rows.groupBy("client_type", "symbol").agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("q"))
    quartile = F.when(F.col("x") <= F.col("q")[0], 1).when(F.col("x") <= F.col("q")[1], 2).when(F.col("x") <= F.col("q")[2], 3).otherwise(4)
    n, sd = F.count(F.lit(1)), F.stddev_samp("fwd")
    return rounded(rows.join(edges, ["client_type", "symbol"]).groupBy("client_type", "symbol", quartile.alias("quartile")).agg(n.alias("n"), F.avg("fwd").alias("mean"), F.when((n >= 8) & (sd > 0), F.avg("fwd") / (sd / F.sqrt(n))).alias("t")))
