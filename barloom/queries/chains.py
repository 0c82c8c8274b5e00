"""Option-chain and pricing queries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import options as op
from ..operators import chains as ch
from ..sources.views import CHAIN, PARTICIPANTS, chain, participants
from . import query, rounded, rounded_sql

G = "PARTITION BY ts, expiry"
T = "(date_diff('day', ts, expiry) + 1) / 365.0"


def t_years() -> Column:
    return (F.datediff("expiry", "ts") + 1) / 365.0


def cdf(x: str) -> str:
    z = f"(({x}) / {math.sqrt(2)!r})"
    t = f"(1 / (1 + {op.P} * abs({z})))"
    return f"(0.5 * (1 + sign({z}) * (1 - {t} * ({op.A1} + {t} * ({op.A2} + {t} * ({op.A3} + {t} * ({op.A4} + {t} * {op.A5})))) * exp(-{z} * {z}))))"


def priced_sql(sigma: str = "0.2") -> str:
    """Named subquery p: d1, d2, t and discount b of every chain row."""
    return f"""{CHAIN}, q AS (SELECT *, {T} AS t, {sigma} AS sigma FROM chain),
 q1 AS (SELECT *, (ln(greatest(spot, 1e-12) / greatest(strike, 1e-12)) + (0.065 + 0.5 * sigma * sigma) * t) / (sigma * sqrt(t)) AS d1, exp(-0.065 * t) AS b FROM q),
 p AS (SELECT *, d1 - sigma * sqrt(t) AS d2, exp(-0.5 * d1 * d1) / {math.sqrt(2 * math.pi)!r} AS pdf FROM q1)"""


def priced(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).withColumn("t", t_years())


@query("bs_price", rounded_sql(f"WITH {priced_sql()}\nSELECT ts, strike, spot * {cdf('d1')} - strike * b * {cdf('d2')} AS call, strike * b * {cdf('-d2')} - spot * {cdf('-d1')} AS put FROM p", "call", "put", digits=5))
def bs_price(spark, sf_dir: str) -> DataFrame:
    d = priced(spark, sf_dir)
    return rounded(d.select("ts", "strike", op.price("spot", "strike", "t", 0.2, F.lit(True)).alias("call"), op.price("spot", "strike", "t", 0.2, F.lit(False)).alias("put")), 5)


GREEKS = {
    "delta": cdf("d1"), "gamma": "pdf / (spot * sigma * sqrt(t))", "vega": "spot * pdf * sqrt(t) / 100", "rho": f"strike * t * b * {cdf('d2')} / 100",
    "theta": f"(-spot * pdf * sigma / (2 * sqrt(t)) - 0.065 * strike * b * {cdf('d2')}) / 365",
}


@query("bs_greeks", rounded_sql(f"WITH {priced_sql()}\nSELECT ts, strike, {', '.join(f'{s} AS {n}' for n, s in GREEKS.items())} FROM p", *GREEKS, digits=5))
def bs_greeks(spark, sf_dir: str) -> DataFrame:
    g = op.greeks("spot", "strike", "t", 0.2, F.lit(True))
    return rounded(priced(spark, sf_dir).select("ts", "strike", *(g[n].alias(n) for n in GREEKS)), 5)


for _name, _x in (("norm_cdf", lambda: op.norm_cdf((F.col("strike") - F.col("spot")) / 100)), ("erf", lambda: op.erf((F.col("strike") - F.col("spot")) / 100)), ("norm_pdf", lambda: op.norm_pdf((F.col("strike") - F.col("spot")) / 100))):
    _sql = {"norm_cdf": cdf("(strike - spot) / 100"), "erf": f"2 * {cdf(f'{math.sqrt(2)!r} * (strike - spot) / 100')} - 1", "norm_pdf": f"exp(-0.5 * pow((strike - spot) / 100, 2)) / {math.sqrt(2 * math.pi)!r}"}[_name]

    def _value(spark, sf_dir: str, x=_x) -> DataFrame:
        return rounded(chain(spark, sf_dir).select("ts", "strike", x().alias("y")))

    query(_name, rounded_sql(f"WITH {CHAIN}\nSELECT ts, strike, {_sql} AS y FROM chain", "y"))(_value)


@query("implied_vol")
def implied_vol(spark, sf_dir: str) -> DataFrame:
    """Volatilities solved from prices made with 0.1 to 0.5: they come back."""
    d = priced(spark, sf_dir).withColumn("sigma", 0.1 + 0.01 * (F.col("strike").cast("long") % 40))
    d = d.withColumn("premium", op.price("spot", "strike", "t", "sigma", F.lit(True)))
    return rounded(d.select("ts", "strike", "sigma", op.implied_vol("premium", "spot", "strike", "t", F.lit(True)).alias("iv")), 4)


@query("sabr_iv", rounded_sql(f"""WITH {CHAIN}, v AS (SELECT ts, strike, spot AS f, {T} AS t, ln(spot / strike) AS lg, pow(spot * strike, 0.25) AS m FROM chain),
 w AS (SELECT *, 0.6 / 6.0 * m * lg AS z FROM v), x AS (SELECT *, ln((sqrt(1 + 2 * 0.3 * z + z * z) + z + 0.3) / 1.3) AS xz FROM w)
SELECT ts, strike, 6.0 / (m * (1 + 0.25 / 24 * lg * lg + 0.0625 / 1920 * pow(lg, 4))) * CASE WHEN abs(z) < 1e-6 THEN 1 + 0.3 * z / 2 ELSE z / xz END
 * (1 + (0.25 / 24 * 36.0 / (m * m) + 0.25 * -0.3 * 0.5 * 0.6 * 6.0 / m + (2 - 3 * 0.09) / 24 * 0.36) * t) AS iv FROM x""", "iv"))
def sabr_iv(spark, sf_dir: str) -> DataFrame:
    return rounded(priced(spark, sf_dir).select("ts", "strike", op.sabr_vol("spot", "strike", "t", 6.0, -0.3, 0.6).alias("iv")))


PAIN = f"""{CHAIN}, pn AS (SELECT a.ts, a.expiry, a.strike, round(sum(greatest(a.strike - b.strike, 0) * b.call_oi + greatest(b.strike - a.strike, 0) * b.put_oi), 6) AS pain, sum(b.call_oi + b.put_oi) AS oi
   FROM chain a JOIN chain b ON a.ts = b.ts AND a.expiry = b.expiry GROUP BY 1, 2, 3),
 mp AS (SELECT ts, expiry, CASE WHEN max(oi) > 0 THEN min_by(strike, (pain, strike)) END AS max_pain FROM pn GROUP BY 1, 2)"""


@query("max_pain", f"WITH {PAIN}\nSELECT * FROM mp")
def max_pain(spark, sf_dir: str) -> DataFrame:
    return ch.max_pain(chain(spark, sf_dir))


SNAP = f"""{PAIN}, sn AS (SELECT ts, expiry, max(spot) AS spot, CAST(sum(put_oi) AS DOUBLE) / nullif(sum(call_oi), 0) AS pcr, min_by(strike, (-put_oi, strike)) AS support, min_by(strike, (-call_oi, strike)) AS resistance,
   min_by(strike, (abs(strike - spot), strike)) AS atm, min_by((call_ltp + put_ltp, 0), (abs(strike - spot), strike))[1] AS straddle FROM chain GROUP BY 1, 2),
 sm AS (SELECT sn.*, mp.max_pain, straddle / spot AS expected_move, 100 * (mp.max_pain - spot) / spot AS distance_pct FROM sn JOIN mp USING (ts, expiry)),
 sb AS (SELECT *, CASE WHEN pcr > 1.2 THEN 1 WHEN pcr < 0.8 THEN -1 ELSE 0 END + CASE WHEN distance_pct > 0.5 THEN 1 WHEN distance_pct < -0.5 THEN -1 ELSE 0 END AS votes FROM sm)"""
BIAS = "CASE WHEN votes > 0 THEN 'bullish' WHEN votes < 0 THEN 'bearish' ELSE 'neutral' END AS bias"


@query("analyze_chain", rounded_sql(f"WITH {SNAP}\nSELECT ts, expiry, spot, pcr, support, resistance, atm, straddle, max_pain, expected_move, distance_pct, {BIAS} FROM sb", "spot", "pcr", "straddle", "expected_move", "distance_pct", digits=9))
def analyze_chain(spark, sf_dir: str) -> DataFrame:
    return rounded(ch.snapshot(chain(spark, sf_dir)).select("ts", "expiry", "spot", "pcr", "support", "resistance", "atm", "straddle", "max_pain", "expected_move", "distance_pct", "bias"), 9)


@query("positioning_from_snapshot", rounded_sql(f"WITH {SNAP}\nSELECT ts, pcr, max_pain, distance_pct, support, resistance FROM sb", "pcr", "distance_pct"))
def positioning(spark, sf_dir: str) -> DataFrame:
    return rounded(ch.snapshot(chain(spark, sf_dir)).select("ts", "pcr", "max_pain", "distance_pct", "support", "resistance"))


@query("chain_bias", f"WITH {SNAP}\nSELECT ts, {BIAS} FROM sb")
def chain_bias(spark, sf_dir: str) -> DataFrame:
    return ch.snapshot(chain(spark, sf_dir)).select("ts", "bias")


@query("atm_index", f"WITH {CHAIN}\nSELECT ts, expiry, min_by(strike, (abs(strike - spot), strike)) AS atm FROM chain GROUP BY 1, 2")
def atm_index(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).groupBy("ts", "expiry").agg(ch.nearest().alias("atm"))


@query("straddle_series", rounded_sql(f"WITH {CHAIN}\nSELECT ts, min_by(strike, (abs(strike - spot), strike)) AS strike, min_by((call_ltp + put_ltp, 0), (abs(strike - spot), strike))[1] AS straddle FROM chain GROUP BY ts", "straddle", digits=9))
def straddle_series(spark, sf_dir: str) -> DataFrame:
    m = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), F.col("strike").alias("s"), (F.col("call_ltp") + F.col("put_ltp")).alias("x")))
    return rounded(chain(spark, sf_dir).groupBy("ts").agg(m.alias("m")).select("ts", F.col("m.s").alias("strike"), F.col("m.x").alias("straddle")), 9)


@query("chain_delta_oi", f"""WITH {CHAIN}, d AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM (SELECT DISTINCT ts FROM chain) x)
SELECT c.ts, c.strike, c.call_oi - p.call_oi AS call_change, c.put_oi - p.put_oi AS put_change FROM chain c JOIN d ON c.ts = d.ts LEFT JOIN chain p ON p.ts = d.before AND p.strike = c.strike""")
def chain_delta_oi(spark, sf_dir: str) -> DataFrame:
    return ch.delta_oi(chain(spark, sf_dir))


@query("classify_buildup", f"""WITH {CHAIN}, w AS (SELECT ts, strike, call_ltp - lag(call_ltp) OVER (PARTITION BY strike ORDER BY ts) AS px, call_oi - lag(call_oi) OVER (PARTITION BY strike ORDER BY ts) AS oi FROM chain)
SELECT ts, strike, CASE WHEN px > 0 AND oi > 0 THEN 'long buildup' WHEN px < 0 AND oi > 0 THEN 'short buildup' WHEN px < 0 AND oi < 0 THEN 'long unwinding' WHEN px > 0 AND oi < 0 THEN 'short covering' WHEN px IS NULL OR oi IS NULL THEN NULL ELSE 'neutral' END AS label FROM w""")
def classify_buildup(spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("strike").orderBy("ts")
    d = chain(spark, sf_dir).select("ts", "strike", (F.col("call_ltp") - F.lag("call_ltp").over(w)).alias("px"), (F.col("call_oi") - F.lag("call_oi").over(w)).alias("oi"))
    px, oi = F.col("px"), F.col("oi")
    label = F.when(px.isNull() | oi.isNull(), None).when((px > 0) & (oi > 0), "long buildup").when((px < 0) & (oi > 0), "short buildup").when((px < 0) & (oi < 0), "long unwinding").when((px > 0) & (oi < 0), "short covering").otherwise("neutral")
    return d.select("ts", "strike", label.alias("label"))


@query("oi_multistrike", f"""WITH {CHAIN}, top AS (SELECT strike FROM chain WHERE ts = (SELECT max(ts) FROM chain) ORDER BY call_oi + put_oi DESC, strike LIMIT 6), days AS (SELECT DISTINCT ts FROM chain)
SELECT d.ts, t.strike, c.call_oi, c.put_oi FROM days d CROSS JOIN top t LEFT JOIN chain c ON c.ts = d.ts AND c.strike = t.strike""")
def oi_multistrike(spark, sf_dir: str) -> DataFrame:
    """The six strikes with most open interest now, at every snapshot; NULL where one has no such strike."""
    c = chain(spark, sf_dir)
    now = c.join(F.broadcast(c.agg(F.max("ts").alias("ts"))), "ts")
    top = now.orderBy(F.desc(F.col("call_oi") + F.col("put_oi")), "strike").limit(6).select("strike")
    return c.select("ts").distinct().crossJoin(F.broadcast(top)).join(c.select("ts", "strike", "call_oi", "put_oi"), ["ts", "strike"], "left")


@query("straddle_path", rounded_sql(f"""WITH {CHAIN}, n AS (SELECT *, lag(put_ltp) OVER (PARTITION BY ts ORDER BY strike) AS lower_put, lead(call_ltp) OVER (PARTITION BY ts ORDER BY strike) AS upper_call, row_number() OVER (PARTITION BY ts ORDER BY abs(strike - spot), strike) AS rn FROM chain)
SELECT ts, strike, call_ltp + put_ltp AS straddle, upper_call + lower_put AS strangle FROM n WHERE rn = 1""", "straddle", "strangle", digits=9))
def straddle_path(spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ts").orderBy("strike")
    d = chain(spark, sf_dir).withColumns({"lower_put": F.lag("put_ltp").over(w), "upper_call": F.lead("call_ltp").over(w), "rn": F.row_number().over(Window.partitionBy("ts").orderBy(F.abs(F.col("strike") - F.col("spot")), "strike"))})
    return rounded(d.where("rn = 1").select("ts", "strike", (F.col("call_ltp") + F.col("put_ltp")).alias("straddle"), (F.col("upper_call") + F.col("lower_put")).alias("strangle")), 9)


@query("option_path", rounded_sql(f"WITH {CHAIN}\nSELECT ts, call_ltp, put_ltp, call_oi, put_oi FROM chain WHERE strike = 950", "call_ltp", "put_ltp", digits=9))
def option_path(spark, sf_dir: str) -> DataFrame:
    return rounded(chain(spark, sf_dir).where("strike = 950").select("ts", "call_ltp", "put_ltp", "call_oi", "put_oi"), 9)


@query("intraday_migration", f"""WITH {CHAIN}, m AS (SELECT year(ts) AS y, strike, max_by(call_oi, ts) - min_by(call_oi, ts) AS change FROM chain GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY abs(change) DESC, strike) AS rn FROM m)
SELECT CAST(y AS BIGINT) AS y, strike, change FROM r WHERE rn <= 3""")
def intraday_migration(spark, sf_dir: str) -> DataFrame:
    """Open interest of the last less the first snapshot of a year, by strike: the three largest moves."""
    m = chain(spark, sf_dir).groupBy(F.year("ts").cast("long").alias("y"), "strike").agg((F.max_by("call_oi", "ts") - F.min_by("call_oi", "ts")).alias("change"))
    return m.withColumn("rn", F.row_number().over(Window.partitionBy("y").orderBy(F.desc(F.abs("change")), "strike"))).where("rn <= 3").drop("rn")


@query("chain_window", f"""WITH {CHAIN}, n AS (SELECT *, row_number() OVER ({G} ORDER BY strike) AS i FROM chain), a AS (SELECT ts, min_by(i, (abs(strike - spot), strike)) AS atm FROM n GROUP BY ts)
SELECT n.ts, strike, call_oi, put_oi FROM n JOIN a USING (ts) WHERE i BETWEEN atm - 5 AND atm + 5""")
def chain_window(spark, sf_dir: str) -> DataFrame:
    return ch.around(chain(spark, sf_dir), 5).select("ts", "strike", "call_oi", "put_oi")


@query("unusual_strikes", rounded_sql(f"""WITH {CHAIN}, u AS (SELECT ts, strike, call_oi / greatest(put_oi, 1) AS ratio FROM chain WHERE call_oi > 3 * greatest(put_oi, 1)), r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY ratio DESC, strike) AS rn FROM u)
SELECT ts, strike, CAST(ratio AS DOUBLE) AS ratio FROM r WHERE rn <= 10""", "ratio"))
def unusual_strikes(spark, sf_dir: str) -> DataFrame:
    """Strikes whose one side outweighs the other three times: the ten most lopsided of a snapshot."""
    u = chain(spark, sf_dir).withColumn("ratio", (F.col("call_oi") / F.greatest("put_oi", F.lit(1))).cast("double")).where("ratio > 3")
    return rounded(u.withColumn("rn", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("ratio"), "strike"))).where("rn <= 10").select("ts", "strike", "ratio"))


@query("implied_forward", rounded_sql(f"WITH {CHAIN}\nSELECT ts, CAST(count(*) AS BIGINT) AS n, regr_slope(call_ltp - put_ltp, strike) AS slope, regr_intercept(call_ltp - put_ltp, strike) AS intercept FROM chain WHERE call_ltp IS NOT NULL AND put_ltp IS NOT NULL GROUP BY ts HAVING count(*) >= 3", "slope", "intercept"))
def implied_forward(spark, sf_dir: str) -> DataFrame:
    both = chain(spark, sf_dir).where("call_ltp IS NOT NULL AND put_ltp IS NOT NULL").withColumn("y", F.col("call_ltp") - F.col("put_ltp"))
    fit = both.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "strike").alias("slope"), F.regr_intercept("y", "strike").alias("intercept"))
    return rounded(fit.where("n >= 3"))


#: Legs of each snapshot: the first call at or above the spot is bought, the highest call sold, the last put at or below the spot bought.
LEGS = ((1, "call", "near"), (-1, "call", "far"), (1, "put", "near"))
STEPS = 1200
LEGGED = f"""{CHAIN}, lg AS (SELECT ts, min(spot) AS spot, min({T}) AS t, min(strike) FILTER (WHERE strike >= spot AND call_ltp IS NOT NULL) AS k0, min_by(call_ltp, strike) FILTER (WHERE strike >= spot AND call_ltp IS NOT NULL) AS p0,
  max(strike) FILTER (WHERE call_ltp IS NOT NULL) AS k1, max_by(call_ltp, strike) FILTER (WHERE call_ltp IS NOT NULL) AS p1, max(strike) FILTER (WHERE strike <= spot AND put_ltp IS NOT NULL) AS k2, max_by(put_ltp, strike) FILTER (WHERE strike <= spot AND put_ltp IS NOT NULL) AS p2 FROM chain GROUP BY ts)"""
PAYOFF = f"""{LEGGED}, g AS (SELECT *, CAST(i AS BIGINT) AS i, spot * (0.8 + i * 0.4 / {STEPS}) AS px FROM lg, range({STEPS + 1}) r(i) WHERE k0 IS NOT NULL AND k2 IS NOT NULL),
 pay AS (SELECT ts, spot, t, i, px, greatest(px - k0, 0) - p0 - (greatest(px - k1, 0) - p1) + greatest(k2 - px, 0) - p2 AS payoff FROM g)"""


def payoff(spark, sf_dir: str) -> DataFrame:
    """Value at expiry of the legs of each snapshot over a grid of prices around its spot; snapshots that lack a leg are left out."""
    picks = []
    for i, (_, kind, place) in enumerate(LEGS):
        quoted = F.col(f"{kind}_ltp").isNotNull()
        beside = quoted & ((F.col("strike") >= F.col("spot")) if kind == "call" else (F.col("strike") <= F.col("spot"))) if place == "near" else quoted
        at = F.when(beside, F.col("strike"))
        end, end_by = (F.min, F.min_by) if (kind, place) == ("call", "near") else (F.max, F.max_by)
        picks += [end(at).alias(f"k{i}"), end_by(f"{kind}_ltp", at).alias(f"p{i}")]
    legs = priced(spark, sf_dir).groupBy("ts").agg(F.min("spot").alias("spot"), F.min("t").alias("t"), *picks).where("k0 IS NOT NULL AND k2 IS NOT NULL")
    grid = legs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(STEPS).cast("long")))).withColumn("px", F.col("spot") * (0.8 + F.col("i") * 0.4 / STEPS))
    worth = lambda i, kind: F.greatest(F.col("px") - F.col(f"k{i}") if kind == "call" else F.col(f"k{i}") - F.col("px"), F.lit(0.0)) - F.col(f"p{i}")
    return grid.select("ts", "spot", "t", "i", "px", sum((side * worth(i, kind) for i, (side, kind, _) in enumerate(LEGS)), F.lit(0.0)).alias("payoff"))


@query("analyze_payoff", rounded_sql(f"WITH {PAYOFF}\nSELECT ts, i, px, payoff FROM pay", "px", "payoff"))
def analyze_payoff(spark, sf_dir: str) -> DataFrame:
    return rounded(payoff(spark, sf_dir).select("ts", "i", "px", "payoff"))


@query("zero_crossings", rounded_sql(f"WITH {PAYOFF}, n AS (SELECT *, lag(px) OVER w AS px0, lag(payoff) OVER w AS p0 FROM pay WINDOW w AS (PARTITION BY ts ORDER BY i))\nSELECT ts, px0 - p0 * (px - px0) / (payoff - p0) AS breakeven FROM n WHERE sign(p0) <> sign(payoff) AND payoff <> p0", "breakeven"))
def zero_crossings(spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ts").orderBy("i")  # a snapshot's grid
    d = payoff(spark, sf_dir).withColumns({"px0": F.lag("px").over(w), "p0": F.lag("payoff").over(w)}).where((F.signum("p0") != F.signum("payoff")) & (F.col("payoff") != F.col("p0")))
    return rounded(d.select("ts", (F.col("px0") - F.col("p0") * (F.col("px") - F.col("px0")) / (F.col("payoff") - F.col("p0"))).alias("breakeven")))


@query("probability_of_profit", rounded_sql(f"WITH {PAYOFF}, n AS (SELECT ts, spot, 0.2 * sqrt(t) AS sd, payoff, (px + lag(px) OVER w) / 2 AS lo, (px + lead(px) OVER w) / 2 AS hi FROM pay WINDOW w AS (PARTITION BY ts ORDER BY i)), m AS (SELECT ts, payoff, CASE WHEN lo IS NOT NULL THEN {cdf('(ln(lo / spot) + 0.5 * sd * sd) / sd')} ELSE 0 END AS a, CASE WHEN hi IS NULL THEN 1 ELSE {cdf('(ln(hi / spot) + 0.5 * sd * sd) / sd')} END AS b FROM n)\nSELECT ts, least(greatest(sum(CASE WHEN payoff > 0 THEN b - a ELSE 0 END), 0), 1) AS pop FROM m GROUP BY ts", "pop"))
def probability_of_profit(spark, sf_dir: str) -> DataFrame:
    """Lognormal mass of the cells of a snapshot's grid where the legs gain; the end cells take the tails."""
    w = Window.partitionBy("ts").orderBy("i")
    d = payoff(spark, sf_dir).withColumns({"sd": 0.2 * F.sqrt("t"), "lo": (F.col("px") + F.lag("px").over(w)) / 2, "hi": (F.col("px") + F.lead("px").over(w)) / 2})
    mass = lambda x: op.norm_cdf((F.ln(F.col(x) / F.col("spot")) + 0.5 * F.col("sd") * F.col("sd")) / F.col("sd"))
    cell = F.when(F.col("hi").isNull(), 1.0).otherwise(mass("hi")) - F.when(F.col("lo").isNull(), 0.0).otherwise(mass("lo"))
    return rounded(d.groupBy("ts").agg(F.least(F.greatest(F.sum(F.when(F.col("payoff") > 0, cell).otherwise(0.0)), F.lit(0.0)), F.lit(1.0)).alias("pop")))


@query("greeks_surface", rounded_sql(f"""WITH {CHAIN}, sp AS (SELECT ts, min(spot) AS spot FROM chain GROUP BY ts), s AS (SELECT ts, i - 24 AS step, (j + 1) * 2 AS days, spot, spot * (1 + (i - 24) / 150.0) AS strike, (j + 1) * 2 / 365.0 AS t FROM sp, range(48) a(i), range(44) b(j)), d AS (SELECT *, (ln(spot / strike) + (0.065 + 0.02) * t) / (0.2 * sqrt(t)) AS d1 FROM s)
SELECT ts, CAST(step AS BIGINT) AS step, CAST(days AS BIGINT) AS days, exp(-0.5 * d1 * d1) / {math.sqrt(2 * math.pi)!r} / (spot * 0.2 * sqrt(t)) AS gamma FROM d""", "gamma", digits=8))
def greeks_surface(spark, sf_dir: str) -> DataFrame:
    """Gamma at strikes in steps of 1/150 of each snapshot's spot, by days to expiry."""
    spots = chain(spark, sf_dir).groupBy("ts").agg(F.min("spot").alias("spot"))
    steps = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    grid = spots.withColumn("step", steps(-24, 23)).withColumn("j", steps(1, 44)).withColumn("days", 2 * F.col("j")).withColumns({"strike": F.col("spot") * (1 + F.col("step") / 150.0), "t": F.col("days") / 365.0})
    return rounded(grid.select("ts", "step", "days", op.greeks("spot", "strike", "t", 0.2, F.lit(True))["gamma"].alias("gamma")), 8)


@query("participants_latest_with_change", f"""WITH {PARTICIPANTS}, d AS (SELECT dt, dense_rank() OVER (ORDER BY dt DESC) AS r FROM (SELECT DISTINCT dt FROM participants) x), p AS (SELECT participants.*, r FROM participants JOIN d USING (dt) WHERE r <= 2)
SELECT a.client_type, a.idx_fut_net, a.idx_fut_net - b.idx_fut_net AS change FROM p a LEFT JOIN p b ON b.client_type = a.client_type AND b.r = 2 WHERE a.r = 1""")
def participants_latest_with_change(spark, sf_dir: str) -> DataFrame:
    return latest_with_change(participants(spark, sf_dir))


def latest_with_change(p: DataFrame) -> DataFrame:
    """Positions of the newest day and their change from the day before it."""
    days = p.select("dt").distinct().orderBy(F.desc("dt")).limit(2)
    two = p.join(F.broadcast(days), "dt").join(F.broadcast(days.agg(F.max("dt").alias("newest"))))
    now = two.where("dt = newest").select("client_type", "idx_fut_net")
    then = two.where("dt < newest").select("client_type", F.col("idx_fut_net").alias("before"))
    return now.join(then, "client_type", "left").select("client_type", "idx_fut_net", (F.col("idx_fut_net") - F.col("before")).alias("change"))


@query("participants_asof", f"""WITH {PARTICIPANTS}, q AS (SELECT * FROM participants WHERE dt <= DATE '1996-06-30'), d AS (SELECT dt, dense_rank() OVER (ORDER BY dt DESC) AS r FROM (SELECT DISTINCT dt FROM q) x), p AS (SELECT q.*, r FROM q JOIN d USING (dt) WHERE r <= 2)
SELECT a.client_type, a.idx_fut_net, a.idx_fut_net - b.idx_fut_net AS change FROM p a LEFT JOIN p b ON b.client_type = a.client_type AND b.r = 2 WHERE a.r = 1""")
def participants_asof(spark, sf_dir: str) -> DataFrame:
    return latest_with_change(participants(spark, sf_dir).where("dt <= DATE '1996-06-30'"))


@query("participants_history", f"""WITH {PARTICIPANTS}, d AS (SELECT dt FROM (SELECT DISTINCT dt FROM participants) x ORDER BY dt DESC LIMIT 250)
SELECT client_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(idx_fut_net) AS BIGINT) AS total, max_by(idx_fut_net, dt) AS last FROM participants JOIN d USING (dt) GROUP BY 1""")
def participants_history(spark, sf_dir: str) -> DataFrame:
    p = participants(spark, sf_dir)
    days = p.select("dt").distinct().orderBy(F.desc("dt")).limit(250)
    return p.join(F.broadcast(days), "dt").groupBy("client_type").agg(F.count(F.lit(1)).alias("n"), F.sum("idx_fut_net").alias("total"), F.max_by("idx_fut_net", "dt").alias("last"))
