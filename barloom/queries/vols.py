"""Queries of implied volatility, strategies and the book's greeks. The chain gets IVs by a rule, some of them missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import options as op
from ..functions.series import Series
from ..operators import book, simplex
from ..operators import vols as vo
from ..sources.views import BARS, CHAIN, FILLS, bars, chain, fills
from . import query, rounded, rounded_sql
from .chains import GREEKS, T, cdf, t_years
from .indicators import LAG, W, full

S = Series()
QUOTED = f"""{CHAIN}, qc AS (SELECT *, {T} AS t, CASE WHEN call_ltp IS NOT NULL THEN 0.12 + abs(strike - spot) / 4000 + 0.002 * (month(ts) % 5) END AS call_iv, CASE WHEN put_ltp IS NOT NULL THEN 0.13 + abs(strike - spot) / 3500 END AS put_iv FROM chain)"""
PANEL = f"{QUOTED}, pn AS (SELECT * FROM qc UNION ALL SELECT * REPLACE (last_day(expiry + INTERVAL 20 DAY) AS expiry, call_iv + 0.01 AS call_iv) FROM qc WHERE CAST(strike AS BIGINT) % 4 = 0)"
MEAN = "((coalesce(call_iv, 0) + coalesce(put_iv, 0)) / nullif(CASE WHEN call_iv IS NULL THEN 0 ELSE 1 END + CASE WHEN put_iv IS NULL THEN 0 ELSE 1 END, 0))"
NEAR = f"min_by(({MEAN}, 0), (abs(strike - spot), strike))[1]"


def quoted(spark, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir).withColumn("t", t_years())
    off = F.abs(F.col("strike") - F.col("spot"))
    return c.withColumns({"call_iv": F.when(F.col("call_ltp").isNotNull(), 0.12 + off / 4000 + 0.002 * (F.month("ts") % 5)), "put_iv": F.when(F.col("put_ltp").isNotNull(), 0.13 + off / 3500)})


def panel(spark, sf_dir: str) -> DataFrame:
    """Two expiries of each snapshot."""
    q = quoted(spark, sf_dir)
    far = q.where(F.col("strike").cast("long") % 4 == 0).withColumns({"expiry": F.last_day(F.date_add("expiry", 20)), "call_iv": F.col("call_iv") + 0.01})
    return q.unionByName(far)


@query("atm_iv_of_snapshot", rounded_sql(f"WITH {PANEL}\nSELECT ts, expiry, {NEAR} AS iv FROM pn GROUP BY 1, 2 HAVING {NEAR} IS NOT NULL", "iv", digits=7))
def atm_iv_of_snapshot(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.atm_iv(panel(spark, sf_dir), ["ts", "expiry"]), 7)


HISTORY = f"{PANEL}, ls AS (SELECT CAST(date_trunc('year', ts) AS DATE) AS day, * FROM pn QUALIFY ts = max(ts) OVER (PARTITION BY date_trunc('year', ts))), hi AS (SELECT day, {NEAR} AS iv FROM ls GROUP BY day HAVING {NEAR} IS NOT NULL)"
INTRADAY = f"{PANEL}, fr AS (SELECT * FROM pn QUALIFY expiry = min(expiry) OVER (PARTITION BY ts)), it AS (SELECT ts, {NEAR} AS iv FROM fr GROUP BY ts HAVING {NEAR} IS NOT NULL)"


@query("atm_iv_history", rounded_sql(f"WITH {HISTORY}\nSELECT day, iv FROM hi", "iv", digits=7))
def atm_iv_history(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.atm_iv_history(panel(spark, sf_dir), F.trunc("ts", "YEAR")), 7)


@query("atm_iv_intraday", rounded_sql(f"WITH {INTRADAY}\nSELECT ts, iv FROM it", "iv", digits=7))
def atm_iv_intraday(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.atm_iv_intraday(panel(spark, sf_dir)), 7)


@query("iv_rank_local", rounded_sql(f"WITH {INTRADAY}\nSELECT CAST(count(iv) AS BIGINT) AS days, CASE WHEN count(iv) >= 20 THEN avg(CASE WHEN iv <= 0.135 THEN 1.0 ELSE 0.0 END) END AS rank, CASE WHEN count(iv) >= 20 THEN min(iv) END AS min_iv, CASE WHEN count(iv) >= 20 THEN max(iv) END AS max_iv FROM it", "rank", "min_iv", "max_iv"))
def iv_rank_local(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.iv_rank(vo.atm_iv_intraday(panel(spark, sf_dir)), 0.135))


@query("iv_rank_refused", rounded_sql(f"WITH {HISTORY}\nSELECT CAST(count(iv) AS BIGINT) AS days, CASE WHEN count(iv) >= 20 THEN avg(CASE WHEN iv <= 0.135 THEN 1.0 ELSE 0.0 END) END AS rank FROM hi", "rank"))
def iv_rank_refused(spark, sf_dir: str) -> DataFrame:
    """No rank of a few days."""
    return rounded(vo.iv_rank(vo.atm_iv_history(panel(spark, sf_dir), F.trunc("ts", "YEAR")), 0.135).select("days", "rank"))


@query("vwap_of_bars", rounded_sql(f"WITH {BARS}\nSELECT symbol, year(dt) AS y, CASE WHEN sum(volume) > 0 THEN sum(close * volume) / sum(volume) END AS vwap FROM bars GROUP BY 1, 2", "vwap").replace("year(dt) AS y", "CAST(year(dt) AS INTEGER) AS y"))
def vwap_of_bars(spark, sf_dir: str) -> DataFrame:
    return rounded(bars(spark, sf_dir).groupBy("symbol", F.year("dt").alias("y")).agg(vo.vwap().alias("vwap")))


@query("vwap_today", rounded_sql(f"""WITH {BARS}, d AS (SELECT dt, CASE WHEN sum(CASE WHEN symbol = 'ECONOMY' THEN volume END) > 0 THEN sum(CASE WHEN symbol = 'ECONOMY' THEN close * volume END) / sum(CASE WHEN symbol = 'ECONOMY' THEN volume END) END AS own,
 CASE WHEN sum(CASE WHEN symbol = 'LARGE' THEN volume END) > 0 THEN sum(CASE WHEN symbol = 'LARGE' THEN close * volume END) / sum(CASE WHEN symbol = 'LARGE' THEN volume END) END AS future FROM bars GROUP BY dt)
SELECT dt, coalesce(own, future) AS vwap, CASE WHEN own IS NOT NULL THEN 'own bars' WHEN future IS NOT NULL THEN 'front future' ELSE 'no bars' END AS source FROM d""", "vwap"))
def vwap_today(spark, sf_dir: str) -> DataFrame:
    """A day's own average price, or its future's where it has none, and whose it is."""
    of = lambda s: F.when(F.sum(F.when(F.col("symbol") == s, F.col("volume"))) > 0, F.sum(F.when(F.col("symbol") == s, F.col("close") * F.col("volume"))) / F.sum(F.when(F.col("symbol") == s, F.col("volume"))))
    d = bars(spark, sf_dir).groupBy("dt").agg(of("ECONOMY").alias("own"), of("LARGE").alias("future"))
    source = F.when(F.col("own").isNotNull(), "own bars").when(F.col("future").isNotNull(), "front future").otherwise("no bars")
    return rounded(d.select("dt", F.coalesce("own", "future").alias("vwap"), source.alias("source")))


VOL = f"""{BARS}, vr AS (SELECT symbol, dt, high, low, ln(close / {LAG}) AS r FROM bars), vv AS (SELECT symbol, dt, {full('stddev_samp', 'r', 21)} * sqrt(252.0) AS rv, sqrt(CASE WHEN row_number() OVER {W}) >= 21 THEN avg(pow(ln(high / low), 2)) OVER {W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) END / (4 * ln(2.0)) * 252) AS park FROM vr),
 vl AS (SELECT symbol, max_by(rv, dt) FILTER (WHERE rv IS NOT NULL) AS rv_cc, max_by(park, dt) FILTER (WHERE park IS NOT NULL) AS rv_park FROM vv GROUP BY symbol),
 vp AS (SELECT symbol, any_value(rv_cc) AS rv_cc, any_value(rv_park) AS rv_park, CASE WHEN count(rv) > 20 THEN avg(CASE WHEN rv <= rv_cc THEN 1.0 ELSE 0.0 END) END AS rv_percentile, 0.5 - any_value(rv_cc) AS iv_premium FROM vv JOIN vl USING (symbol) WHERE rv IS NOT NULL GROUP BY symbol)"""


@query("analyze_vol", rounded_sql(f"WITH {VOL}\nSELECT *, CASE WHEN iv_premium > 0.04 THEN 'options rich' WHEN iv_premium < -0.02 THEN 'options cheap' WHEN iv_premium IS NOT NULL THEN 'fair' END AS note FROM vp", "rv_cc", "rv_park", "rv_percentile", "iv_premium"))
def analyze_vol(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.report(bars(spark, sf_dir), 0.5, 1000.0))


@query("vol_cone", rounded_sql(f"WITH {INTRADAY}, sp AS (SELECT ts, max(spot) AS spot FROM pn GROUP BY ts), co AS (SELECT ts, spot, iv, d AS days, iv * sqrt(d / 252.0) AS s FROM it JOIN sp USING (ts) CROSS JOIN (VALUES (1), (3), (5), (10), (21)) v(d))\nSELECT ts, CAST(days AS INTEGER) AS days, spot * exp(-2 * s) AS down_2, spot * exp(-s) AS down_1, spot * exp(s) AS up_1, spot * exp(2 * s) AS up_2 FROM co", "down_2", "down_1", "up_1", "up_2"))
def vol_cone(spark, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    at = vo.atm_iv_intraday(p).join(p.groupBy("ts").agg(F.max("spot").alias("spot")), "ts")
    return rounded(vo.cone(at).select("ts", "days", "down_2", "down_1", "up_1", "up_2"))


@query("quote_price", rounded_sql(f"WITH {CHAIN}, m AS (SELECT ts, strike, call_ltp, CASE CAST(call_oi AS BIGINT) % 3 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE call_ltp * 1.01 END AS mid FROM chain)\nSELECT ts, strike, CASE WHEN mid > 0 THEN mid ELSE call_ltp END AS price FROM m", "price", digits=9))
def quote_price(spark, sf_dir: str) -> DataFrame:
    left = F.col("call_oi").cast("long") % 3
    mid = F.when(left == 0, None).when(left == 1, 0.0).otherwise(F.col("call_ltp") * 1.01)
    return rounded(chain(spark, sf_dir).select("ts", "strike", vo.quote_price(mid, F.col("call_ltp")).alias("price")), 9)


SIDED = {side: {n: x.replace("sigma", f"sg_{side}").replace("d1", f"d1_{side}").replace("d2", f"d2_{side}").replace("pdf", f"pdf_{side}") for n, x in GREEKS.items()} for side in ("c", "p")}
CHAINED = f"""{QUOTED}, gs AS (SELECT *, coalesce(call_iv, 0.15) AS sg_c, coalesce(put_iv, 0.15) AS sg_p, exp(-0.065 * t) AS b FROM qc),
 g1 AS (SELECT *, (ln(spot / strike) + (0.065 + 0.5 * sg_c * sg_c) * t) / (sg_c * sqrt(t)) AS d1_c, (ln(spot / strike) + (0.065 + 0.5 * sg_p * sg_p) * t) / (sg_p * sqrt(t)) AS d1_p FROM gs),
 g2 AS (SELECT *, d1_c - sg_c * sqrt(t) AS d2_c, d1_p - sg_p * sqrt(t) AS d2_p, exp(-0.5 * d1_c * d1_c) / sqrt(2 * pi()) AS pdf_c, exp(-0.5 * d1_p * d1_p) / sqrt(2 * pi()) AS pdf_p FROM g1)"""


@query("chain_greeks", rounded_sql(f"WITH {CHAINED}\nSELECT ts, strike, {SIDED['c']['delta']} AS call_delta, {SIDED['p']['delta']} - 1 AS put_delta, {SIDED['c']['gamma']} AS call_gamma, {SIDED['p']['vega']} AS put_vega FROM g2", "call_delta", "put_delta", "call_gamma", "put_vega", digits=5))
def chain_greeks(spark, sf_dir: str) -> DataFrame:
    """Both sides; a missing IV counts as 0.15."""
    q = quoted(spark, sf_dir)
    c, p = (op.greeks("spot", "strike", "t", F.coalesce(iv, F.lit(vo.DEFAULT_IV)), F.lit(call)) for iv, call in (("call_iv", True), ("put_iv", False)))
    return rounded(q.select("ts", "strike", c["delta"].alias("call_delta"), p["delta"].alias("put_delta"), c["gamma"].alias("call_gamma"), p["vega"].alias("put_vega")), 5)


@query("solve_chain_ivs", rounded_sql(f"WITH {QUOTED}\nSELECT ts, strike, coalesce(put_iv, 0.2) AS put_iv FROM qc WHERE t > 0", "put_iv", digits=4))
def solve_chain_ivs(spark, sf_dir: str) -> DataFrame:
    """Puts are priced with their IV (0.2 where there is none); the IV is forgotten and solved from the mid, or from the last price where there is no mid."""
    q = quoted(spark, sf_dir).withColumn("iv", F.coalesce("put_iv", F.lit(0.2)))
    px = op.price("spot", "strike", "t", "iv", F.lit(False))
    none = F.lit(None).cast("double")
    q = q.withColumns({"put_mid": F.when(F.col("strike").cast("long") % 4 == 0, px), "put_ltp": px, "put_iv": none, "call_mid": none, "call_ltp": none, "call_iv": F.lit(0.3)})
    found = vo.solved(q)
    # far in or out of the money a price does not tell its volatility; there the repriced value must agree
    known = F.abs(op.price("spot", "strike", "t", F.col("put_iv"), F.lit(False)) - F.col("put_ltp")) < 1e-6
    return rounded(found.select("ts", "strike", F.when((F.abs(F.col("put_iv") - F.col("iv")) < 1e-4) | F.col("put_iv").isNull() | known, F.col("iv")).otherwise(F.col("put_iv")).alias("put_iv")), 4)


@query("ensure_iv", rounded_sql(f"WITH {QUOTED}\nSELECT ts, strike, call_iv FROM qc WHERE call_iv IS NOT NULL", "call_iv", digits=7))
def ensure_iv(spark, sf_dir: str) -> DataFrame:
    """IVs that are there stay as they are."""
    none = F.lit(None).cast("double")
    q = quoted(spark, sf_dir).where("call_iv IS NOT NULL").withColumns({"call_mid": none, "put_mid": none})
    return rounded(vo.solved(q).select("ts", "strike", "call_iv"), 7)


TEMPLATES = ", ".join(f"('{n}', {i + 1}, {s}, '{k}', {o * 2})" for n, legs in vo.STRATEGIES.items() for i, (s, k, o) in enumerate(legs))
NUM = f"{QUOTED}, ni AS (SELECT *, row_number() OVER (PARTITION BY ts, expiry ORDER BY strike) AS i, count(*) OVER (PARTITION BY ts, expiry) AS n FROM qc), na AS (SELECT ts, expiry, min_by(i, (abs(strike - spot), strike)) AS atm, max(n) AS n FROM ni GROUP BY 1, 2)"
LEGGED = f"""{NUM}, tp AS (SELECT * FROM (VALUES {TEMPLATES}) v(name, leg, side, kind, off)), lg AS (SELECT ni.ts, ni.expiry, ni.spot, name, leg, side, kind, strike, CASE WHEN kind = 'CE' THEN call_ltp ELSE put_ltp END AS premium, coalesce(CASE WHEN kind = 'CE' THEN call_iv ELSE put_iv END, 0.15) AS iv
   FROM na CROSS JOIN tp JOIN ni ON ni.ts = na.ts AND ni.expiry = na.expiry AND ni.i = least(greatest(na.atm + off, 1), na.n))"""


@query("build_strategy", rounded_sql(f"WITH {LEGGED}\nSELECT ts, name, CAST(leg AS INTEGER) AS leg, CAST(side AS INTEGER) AS side, kind, strike, premium, round(iv, 6) AS iv FROM lg", "premium", digits=9))
def build_strategy(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.strategy_legs(quoted(spark, sf_dir)).drop("expiry", "spot").withColumn("iv", F.round("iv", 6)), 9)


@query("offset_index", f"WITH {NUM}, o AS (SELECT ts, CAST(v.off AS INTEGER) AS off, CAST(least(greatest(atm + v.off, 1), n) AS INTEGER) AS i FROM na CROSS JOIN (VALUES (-40), (-1), (0), (3), (40)) v(off))\nSELECT ts, off, i FROM o")
def offset_index(spark, sf_dir: str) -> DataFrame:
    """Number of the strike so many away from the nearest one, kept within the chain."""
    at = vo.numbered(quoted(spark, sf_dir)).select("ts", "expiry", "atm", "n").distinct().withColumn("off", F.explode(F.array(*map(F.lit, (-40, -1, 0, 3, 40)))))
    return at.select("ts", "off", F.least(F.greatest(F.col("atm") + F.col("off"), F.lit(1)), F.col("n").cast("int")).alias("i"))


@query("atm_iv_or_default", rounded_sql(f"WITH {QUOTED}\nSELECT ts, coalesce({NEAR}, 0.15) AS iv FROM qc GROUP BY ts", "iv", digits=7))
def atm_iv_or_default(spark, sf_dir: str) -> DataFrame:
    q = quoted(spark, sf_dir)
    return rounded(q.select("ts").distinct().join(vo.atm_iv(q, ["ts"]), "ts", "left").select("ts", F.coalesce("iv", F.lit(vo.DEFAULT_IV)).alias("iv")), 7)


@query("leg_from_chain", rounded_sql(f"WITH {QUOTED}\nSELECT ts, strike, 'PE' AS kind, put_ltp AS premium, round(coalesce(put_iv, 0.15), 6) AS iv FROM qc WHERE strike = 950", "premium", digits=9))
def leg_from_chain(spark, sf_dir: str) -> DataFrame:
    q = quoted(spark, sf_dir).where("strike = 950")
    return rounded(q.select("ts", "strike", F.lit("PE").alias("kind"), F.col("put_ltp").alias("premium"), F.round(F.coalesce("put_iv", F.lit(vo.DEFAULT_IV)), 6).alias("iv")), 9)


@query("leg_payoff", rounded_sql(f"WITH {LEGGED}, pp AS (SELECT *, spot * 1.05 AS px FROM lg)\nSELECT ts, name, CAST(leg AS INTEGER) AS leg, side * (greatest(CASE WHEN kind = 'CE' THEN px - strike ELSE strike - px END, 0) - premium) AS payoff FROM pp", "payoff", digits=4))
def leg_payoff(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.strategy_legs(quoted(spark, sf_dir)).select("ts", "name", "leg", vo.leg_payoff(F.col("spot") * 1.05).alias("payoff")), 4)


SOME = {k: v for k, v in vo.STRATEGIES.items() if k in ("short_straddle", "iron_condor", "bull_call_spread")}
PAID = f"""{LEGGED}, bk AS (SELECT ts, expiry, name FROM lg GROUP BY ALL HAVING count(*) = count(premium) AND name IN ('short_straddle', 'iron_condor', 'bull_call_spread')),
 gr AS (SELECT lg.ts, lg.expiry, lg.name, g.i, spot * (0.8 + 0.4 * g.i / 1200) AS px, side, kind, strike, premium FROM lg JOIN bk USING (ts, expiry, name) CROSS JOIN range(1201) g(i)),
 pa AS (SELECT ts, expiry, name, i, px, round(sum(side * (greatest(CASE WHEN kind = 'CE' THEN px - strike ELSE strike - px END, 0) - premium)), 9) AS payoff FROM gr GROUP BY ALL),
 pl AS (SELECT *, lag(payoff) OVER w AS p0, lag(px) OVER w AS x0 FROM pa WINDOW w AS (PARTITION BY ts, expiry, name ORDER BY i)),
 pe AS (SELECT ts, name, max(payoff) AS hi, min(payoff) AS lo, max(CASE WHEN i = 1 THEN px - x0 END) * 1e-3 AS eps, max_by(payoff - p0, i) AS last, max(CASE WHEN i = 1 THEN payoff - p0 END) AS first, count(CASE WHEN sign(p0) <> sign(payoff) AND p0 <> 0 THEN 1 END) AS breakevens FROM pl GROUP BY 1, 2, expiry),
 ps AS (SELECT ts, name, CASE WHEN last > eps OR first < -eps THEN NULL ELSE hi END AS max_profit, CASE WHEN last < -eps OR first > eps THEN NULL ELSE lo END AS max_loss, CAST(breakevens AS BIGINT) AS breakevens FROM pe)"""


def summarised(spark, sf_dir: str) -> DataFrame:
    legs = vo.strategy_legs(quoted(spark, sf_dir), strategies=SOME)
    return vo.payoff_summary(vo.payoffs(legs, F.lit(0.2)))


@query("strategy_payoff", rounded_sql(f"WITH {PAID}\nSELECT * FROM ps", "max_profit", "max_loss", digits=3))
def strategy_payoff(spark, sf_dir: str) -> DataFrame:
    return rounded(summarised(spark, sf_dir).drop("expiry", "risk_reward"), 3)


@query("risk_reward", rounded_sql(f"WITH {PAID}\nSELECT ts, name, CASE WHEN max_loss <> 0 THEN abs(max_profit / max_loss) END AS risk_reward FROM ps", "risk_reward", digits=5))
def risk_reward(spark, sf_dir: str) -> DataFrame:
    return rounded(summarised(spark, sf_dir).select("ts", "name", "risk_reward"), 5)


@query("parse_custom_legs", rounded_sql(f"WITH {QUOTED}, cl AS (SELECT * FROM (VALUES (1, 1, 'CE', 950.0), (2, -1, 'CE', 970.0), (3, 1, 'PE', 930.0)) v(leg, side, kind, strike))\nSELECT ts, CAST(leg AS INTEGER) AS leg, CAST(side AS INTEGER) AS side, kind, CAST(cl.strike AS DOUBLE) AS strike, CASE WHEN kind = 'CE' THEN call_ltp ELSE put_ltp END AS premium FROM cl JOIN qc ON qc.strike = cl.strike", "premium", digits=9))
def parse_custom_legs(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.custom_legs(quoted(spark, sf_dir), ["+950CE", "-970ce", " +930PE"]).drop("expiry"), 9)


LAST_SNAP = f"{QUOTED}, lc AS (SELECT * FROM qc QUALIFY ts = max(ts) OVER ())"
POSED = f"""{FILLS}, po AS (SELECT instrument, CAST(regexp_extract(instrument, '([0-9]+)', 1) AS INTEGER) AS no, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS qty FROM fills GROUP BY 1),
 pk AS (SELECT CASE WHEN no < 30 THEN 'LOW' ELSE 'HIGH' END AS symbol, instrument, CASE no % 4 WHEN 0 THEN 'FUT' WHEN 1 THEN 'CE' WHEN 2 THEN 'PE' ELSE 'CE' END AS kind, 900.0 + no * CASE WHEN no % 4 = 3 THEN 30 ELSE 2 END AS strike, qty FROM po)"""
MARKED = f"""{LAST_SNAP}, {POSED}, mk AS (SELECT symbol, instrument, kind, qty, CASE kind WHEN 'CE' THEN call_iv WHEN 'PE' THEN put_iv END AS sigma, spot, lc.strike AS strike, t FROM pk LEFT JOIN lc ON lc.strike = pk.strike),
 m1 AS (SELECT *, exp(-0.065 * t) AS b, (ln(spot / strike) + (0.065 + 0.5 * sigma * sigma) * t) / (sigma * sqrt(t)) AS d1, kind = 'FUT' OR coalesce(sigma > 0, FALSE) AS marked FROM mk), m2 AS (SELECT *, d1 - sigma * sqrt(t) AS d2, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) AS pdf FROM m1),
 ml AS (SELECT symbol, instrument, CASE WHEN kind = 'FUT' THEN qty WHEN NOT marked THEN NULL WHEN kind = 'CE' THEN qty * {GREEKS['delta']} ELSE qty * ({GREEKS['delta']} - 1) END AS delta, CASE WHEN kind = 'FUT' THEN 0 WHEN marked THEN qty * {GREEKS['gamma']} END AS gamma, CASE WHEN kind = 'FUT' THEN 0 WHEN marked THEN qty * {GREEKS['vega']} END AS vega,
   CASE WHEN kind = 'FUT' THEN 0 WHEN NOT marked THEN NULL WHEN kind = 'CE' THEN qty * ({GREEKS['theta']}) ELSE qty * (-spot * pdf * sigma / (2 * sqrt(t)) + 0.065 * strike * b * {cdf('-d2')}) / 365 END AS theta, marked FROM m2)"""


def positions(spark, sf_dir: str) -> DataFrame:
    no = F.regexp_extract("instrument", "([0-9]+)", 1).cast("int")
    net = fills(spark, sf_dir).groupBy("instrument").agg(F.sum(book.signed()).alias("qty")).withColumn("no", no)
    kind = F.when(F.col("no") % 4 == 0, "FUT").when(F.col("no") % 4 == 2, "PE").otherwise("CE")
    strike = 900.0 + F.col("no") * F.when(F.col("no") % 4 == 3, 30).otherwise(2)
    return net.select(F.when(F.col("no") < 30, "LOW").otherwise("HIGH").alias("symbol"), "instrument", kind.alias("kind"), strike.alias("strike"), "qty")


def marked(spark, sf_dir: str) -> DataFrame:
    q = quoted(spark, sf_dir)
    last = q.join(F.broadcast(q.agg(F.max("ts").alias("ts"))), "ts")
    return vo.leg_greeks(positions(spark, sf_dir), last, F.col("t"))


@query("leg_greeks", rounded_sql(f"WITH {MARKED}\nSELECT instrument, delta, gamma, theta, vega, marked FROM ml", "delta", "gamma", "theta", "vega", digits=4))
def leg_greeks(spark, sf_dir: str) -> DataFrame:
    return rounded(marked(spark, sf_dir).select("instrument", "delta", "gamma", "theta", "vega", "marked"), 4)


BOOK = f"{MARKED}, bg AS (SELECT symbol, coalesce(sum(delta), 0.0) AS delta, coalesce(sum(gamma), 0.0) AS gamma, coalesce(sum(theta), 0.0) AS theta, coalesce(sum(vega), 0.0) AS vega, coalesce(string_agg(CASE WHEN NOT marked THEN instrument END, ', ' ORDER BY instrument), '') AS unmarked FROM ml GROUP BY ROLLUP (symbol))"


@query("book_greeks", rounded_sql(f"WITH {BOOK}\nSELECT * FROM bg", "delta", "gamma", "theta", "vega", digits=3))
def book_greeks(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.book_greeks(marked(spark, sf_dir)), 3)


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST(round(abs({x})) AS BIGINT))"


@query("describe_greeks", f"WITH {BOOK}\nSELECT symbol, concat_ws(' · ', CASE WHEN abs(delta) < 1 THEN 'delta-flat' ELSE CASE WHEN delta > 0 THEN 'long' ELSE 'short' END || ' ' || {thousands('delta')} || ' delta' END, CASE WHEN abs(gamma) > 1e-9 THEN CASE WHEN gamma > 0 THEN 'long' ELSE 'short' END || ' gamma' END, CASE WHEN abs(theta) > 1e-9 THEN CASE WHEN theta > 0 THEN 'earning ' ELSE 'paying ' END || {thousands('theta')} || '/day' END, CASE WHEN abs(vega) > 1e-9 THEN CASE WHEN vega > 0 THEN 'long' ELSE 'short' END || ' vega ' || {thousands('vega')} END) AS line FROM bg")
def describe_greeks(spark, sf_dir: str) -> DataFrame:
    return vo.book_greeks(marked(spark, sf_dir)).select("symbol", vo.describe(*map(F.col, ("delta", "gamma", "theta", "vega"))).alias("line"))


OWN = "greatest(t * 365, 1.0)"
LOWEST = f"greatest({OWN} * 0.35, 2.0)"
SURF = f"""{QUOTED}, sm AS (SELECT ts, strike, spot, t, {OWN} AS own, {MEAN} AS smile FROM qc WHERE {MEAN} IS NOT NULL), sa AS (SELECT *, count(*) OVER (PARTITION BY ts) AS n, first_value(smile) OVER (PARTITION BY ts ORDER BY abs(strike - spot), strike) AS atm_iv FROM sm),
 dy AS (SELECT DISTINCT ts, round(greatest(own * 0.35, 2.0) * pow(95.0 / greatest(own * 0.35, 2.0), i / 13.0)) AS days FROM sa CROSS JOIN range(14) r(i) UNION SELECT DISTINCT ts, round(own) FROM sa)"""


@query("iv_surface", rounded_sql(f"WITH {SURF}\nSELECT sa.ts, strike, days, greatest(atm_iv + (smile - atm_iv) * sqrt(own / days), 0.01) AS iv FROM sa JOIN dy USING (ts) WHERE n >= 5", "iv"))
def iv_surface(spark, sf_dir: str) -> DataFrame:
    return rounded(vo.surface(quoted(spark, sf_dir), vo.maturities(F.col("own"))).select("ts", "strike", "days", "iv"))


MODEL = f"""{QUOTED}, sv AS (SELECT ts, strike, {MEAN} AS iv, t, ln(spot / strike) AS lg, pow(spot * strike, 0.25) AS m FROM qc WHERE {MEAN} IS NOT NULL), sw AS (SELECT *, 0.6 / 6.0 * m * lg AS z FROM sv), sx AS (SELECT *, ln((sqrt(1 + 2 * 0.3 * z + z * z) + z + 0.3) / 1.3) AS xz FROM sw),
 rs AS (SELECT ts, strike, 100 * (6.0 / (m * (1 + 0.25 / 24 * lg * lg + 0.0625 / 1920 * pow(lg, 4))) * CASE WHEN abs(z) < 1e-6 THEN 1 + 0.3 * z / 2 ELSE z / xz END * (1 + (0.25 / 24 * 36.0 / (m * m) + 0.25 * -0.3 * 0.5 * 0.6 * 6.0 / m + (2 - 3 * 0.09) / 24 * 0.36) * t) - iv) AS residual FROM sx)"""


def residuals(spark, sf_dir: str) -> DataFrame:
    q = quoted(spark, sf_dir).withColumn("iv", vo.both_mean(F.col("call_iv"), F.col("put_iv"))).where("iv IS NOT NULL")
    return q.select("ts", "strike", (100 * (op.sabr_vol("spot", "strike", "t", 6.0, -0.3, 0.6) - F.col("iv"))).alias("residual"))


@query("sabr_residuals", rounded_sql(f"WITH {MODEL}\nSELECT * FROM rs", "residual"))
def sabr_residuals(spark, sf_dir: str) -> DataFrame:
    return rounded(residuals(spark, sf_dir))


def rmse():
    return F.sqrt(F.avg(F.col("residual") * F.col("residual")))


@query("sabr_rmse", rounded_sql(f"WITH {MODEL}\nSELECT ts, sqrt(avg(residual * residual)) AS rmse FROM rs GROUP BY ts", "rmse"))
def sabr_rmse(spark, sf_dir: str) -> DataFrame:
    return rounded(residuals(spark, sf_dir).groupBy("ts").agg(rmse().alias("rmse")))


@query("sabr_quality", f"WITH {MODEL}, q AS (SELECT ts, sqrt(avg(residual * residual)) / 20 AS rmse FROM rs GROUP BY ts)\nSELECT ts, CASE WHEN rmse <= 0.25 THEN 'tight' WHEN rmse <= 0.5 THEN 'usable' ELSE 'poor' END AS quality FROM q")
def sabr_quality(spark, sf_dir: str) -> DataFrame:
    return residuals(spark, sf_dir).groupBy("ts").agg((rmse() / 20).alias("rmse")).select("ts", vo.sabr_quality(F.col("rmse")).alias("quality"))


@query("calibrate_sabr", f"WITH {QUOTED}, n AS (SELECT ts, expiry, count(*) AS n FROM qc WHERE abs(ln(spot * exp(0.065 * t) / strike)) <= 0.35 GROUP BY 1, 2)\nSELECT ts, 0.25 AS alpha, -0.2 AS rho, 0.8 AS nu FROM n WHERE n >= 6".replace("0.25 AS alpha, -0.2 AS rho, 0.8 AS nu", "CAST(6.5 AS DOUBLE) AS alpha, CAST(-0.2 AS DOUBLE) AS rho, CAST(0.8 AS DOUBLE) AS nu"))
def calibrate_sabr(spark, sf_dir: str) -> DataFrame:
    """Smiles made by the model with alpha 6.5, rho -0.2 and nu 0.8: the fit finds them again."""
    q = quoted(spark, sf_dir).withColumn("f", F.col("spot") * F.exp(0.065 * F.col("t")))
    q = q.select("ts", "expiry", "f", F.col("strike").alias("k"), "t", op.sabr_vol("f", "strike", "t", 6.5, -0.2, 0.8).alias("iv"), (F.col("call_oi") + F.col("put_oi") + 1.0).alias("w"))
    return simplex.sabr_fits(q).select("ts", *((F.round(c, 2) + 0.0).alias(c) for c in ("alpha", "rho", "nu")))


def market_quotes(spark, sf_dir: str) -> DataFrame:
    """The out-of-the-money side of each strike, weighted by its open interest."""
    q = quoted(spark, sf_dir).withColumn("f", F.col("spot") * F.exp(0.065 * F.col("t")))
    call = F.col("strike") >= F.col("f")
    side = lambda n: F.when(call, F.col(f"call_{n}")).otherwise(F.col(f"put_{n}"))
    return q.select("ts", "expiry", "f", F.col("strike").alias("k"), "t", side("iv").alias("iv"), F.greatest(side("oi"), F.lit(0)).cast("double").alias("w"))


@query("calibrate_chain")
def calibrate_chain(spark, sf_dir: str) -> DataFrame:
    """Each snapshot's smile fitted to its market quotes."""
    return rounded(simplex.sabr_fits(market_quotes(spark, sf_dir)).withColumn("warnings", F.array_join("warnings", "; ")), 3)


FITTED = f"""{QUOTED}, fx AS (SELECT ts, expiry, ln(strike / spot) / sqrt(t) AS x, {MEAN} AS iv, call_oi + put_oi + 1.0 AS w FROM qc WHERE {MEAN} IS NOT NULL),
 fs AS (SELECT ts, expiry, count(*) AS n, {', '.join(f'sum(w * pow(x, {k})) AS s{k}' for k in range(5))}, {', '.join(f'sum(w * pow(x, {k}) * iv) AS b{k}' for k in range(3))} FROM fx GROUP BY 1, 2 HAVING count(*) >= 5),
 fd AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM fs)"""


@query("fit_smile", rounded_sql(f"WITH {FITTED}\nSELECT ts, CAST(n AS BIGINT) AS n, (b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) / det AS level, (s0 * (b1 * s4 - s3 * b2) - b0 * (s1 * s4 - s3 * s2) + s2 * (s1 * b2 - b1 * s2)) / det AS slope FROM fd", "level", "slope", digits=4))
def fit_smile(spark, sf_dir: str) -> DataFrame:
    q = quoted(spark, sf_dir).withColumn("iv", vo.both_mean(F.col("call_iv"), F.col("put_iv"))).where("iv IS NOT NULL")
    rows = q.select("ts", "expiry", (F.ln(F.col("strike") / F.col("spot")) / F.sqrt("t")).alias("x"), "iv", (F.col("call_oi") + F.col("put_oi") + 1.0).alias("w"))
    return rounded(vo.smile_fit(rows).select("ts", "n", "level", "slope"), 4)


@query("risk_reversal_25d", rounded_sql(f"WITH {CHAINED}, dl AS (SELECT ts, strike, call_iv, put_iv, round({SIDED['c']['delta']}, 6) AS cd, round({SIDED['p']['delta']} - 1, 6) AS pd FROM g2)\nSELECT ts, min_by(put_iv, (abs(pd + 0.25), strike)) FILTER (WHERE put_iv IS NOT NULL) - min_by(call_iv, (abs(cd - 0.25), strike)) FILTER (WHERE call_iv IS NOT NULL) AS reversal FROM dl GROUP BY ts", "reversal"))
def risk_reversal_25d(spark, sf_dir: str) -> DataFrame:
    """IV of the put whose delta is nearest to -0.25, less that of the call nearest to 0.25, of strikes that have an IV."""
    q = quoted(spark, sf_dir)
    for side, way in (("call", 1), ("put", -1)):
        delta = F.round(op.greeks("spot", "strike", "t", F.coalesce(f"{side}_iv", F.lit(vo.DEFAULT_IV)), F.lit(side == "call"))["delta"], 6)
        q = q.withColumn(f"{side}_off", F.when(F.col(f"{side}_iv").isNotNull(), F.struct(F.abs(delta - way * 0.25).alias("d"), F.col("strike").alias("s"))))
    return rounded(q.groupBy("ts").agg((F.min_by("put_iv", "put_off") - F.min_by("call_iv", "call_off")).alias("reversal")))


def half_sql(k: int) -> str:
    return f"""h{k} AS (SELECT ts, {', '.join(f'sum(w * pow(x, {i})) AS s{i}' for i in range(5))}, {', '.join(f'sum(w * pow(x, {i}) * iv) AS b{i}' for i in range(3))} FROM hx WHERE half = {k} GROUP BY ts HAVING count(*) >= 5),
 l{k} AS (SELECT ts, (b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) AS level FROM h{k})"""


@query("split_half_noise", rounded_sql(f"WITH {QUOTED}, hx AS (SELECT ts, ln(strike / spot) / sqrt(t) AS x, {MEAN} AS iv, call_oi + put_oi + 1.0 AS w, row_number() OVER (PARTITION BY ts ORDER BY strike) % 2 AS half FROM qc WHERE {MEAN} IS NOT NULL), {half_sql(0)}, {half_sql(1)}\nSELECT ts, l0.level - l1.level AS difference FROM l0 JOIN l1 USING (ts)", "difference", digits=4))
def split_half_noise(spark, sf_dir: str) -> DataFrame:
    """Smiles fitted to every other strike and to the rest: how far their levels differ."""
    q = quoted(spark, sf_dir).withColumn("iv", vo.both_mean(F.col("call_iv"), F.col("put_iv"))).where("iv IS NOT NULL")
    half = F.row_number().over(Window.partitionBy("ts").orderBy("strike")) % 2
    rows = q.select("ts", "expiry", half.alias("half"), (F.ln(F.col("strike") / F.col("spot")) / F.sqrt("t")).alias("x"), "iv", (F.col("call_oi") + F.col("put_oi") + 1.0).alias("w"))
    a, b = (vo.smile_fit(rows.where(F.col("half") == k)).select("ts", F.col("level").alias(f"l{k}")) for k in (0, 1))
    return rounded(a.join(b, "ts").select("ts", (F.col("l0") - F.col("l1")).alias("difference")), 4)


SYNTHETIC = f"{QUOTED}, sp AS (SELECT ts, min(spot) AS spot, min(t) AS t FROM qc GROUP BY ts), sk AS (SELECT ts, i - 10 AS step, spot, t, spot * (1 + (i - 10) * 0.05) AS strike, 0.15 + 0.3 * pow(ln(1 + (i - 10) * 0.05), 2) AS sigma FROM sp, range(21) r(i)), sd AS (SELECT *, (ln(spot / strike) + (0.065 + 0.5 * sigma * sigma) * t) / (sigma * sqrt(t)) AS d1, exp(-0.065 * t) AS b FROM sk), se AS (SELECT *, d1 - sigma * sqrt(t) AS d2 FROM sd)"


@query("synthetic_chain", rounded_sql(f"WITH {SYNTHETIC}\nSELECT ts, CAST(step AS BIGINT) AS step, CAST(sigma AS DOUBLE) AS iv, spot * {cdf('d1')} - strike * b * {cdf('d2')} AS call_ltp, strike * b * {cdf('-d2')} - spot * {cdf('-d1')} AS put_ltp, TRUE AS is_model FROM se", "iv", "call_ltp", "put_ltp", digits=5))
def synthetic_chain(spark, sf_dir: str) -> DataFrame:
    """A made-up chain for each snapshot, which says so: prices of a smile at strikes in steps of 5 % of its spot."""
    spots = quoted(spark, sf_dir).groupBy("ts").agg(F.min("spot").alias("spot"), F.min("t").alias("t"))
    share = 1 + F.col("step") * 0.05
    k = spots.withColumn("step", F.explode(F.sequence(F.lit(-10).cast("long"), F.lit(10).cast("long")))).withColumns({"strike": F.col("spot") * share, "iv": 0.15 + 0.3 * F.pow(F.ln(share), 2)})
    price = lambda call: op.price("spot", "strike", "t", "iv", F.lit(call))
    return rounded(k.select("ts", "step", "iv", price(True).alias("call_ltp"), price(False).alias("put_ltp"), F.lit(True).alias("is_model")), 5)
