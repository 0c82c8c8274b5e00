"""Queries of models, portfolios under risk, learned directions, and the book's settlement and margin."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators import book
from ..operators import models as mo
from ..sources.views import BARS, FILLS, bars, fills, table
from . import query, rounded, rounded_sql
from .backtests import _GRID_SQL, BT
from .indicators import LAG, RSI, W, full
from .validation import ppf_sql

S = Series()
Q, R = 1e-5, 1e-2
KALMAN = f"""{BARS}, ky AS (SELECT symbol, dt, ln(close) AS y, row_number() OVER {W}) - 1 AS k FROM bars),
 kf AS (SELECT symbol, CAST(-1 AS BIGINT) AS k, y AS level, CAST(0 AS DOUBLE) AS slope, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS z FROM ky WHERE k = 0
  UNION ALL SELECT symbol, k, lv + pa / (pa + {R}) * (y - lv), sl + pb / (pa + {R}) * (y - lv), pa - pa / (pa + {R}) * pa, pb - pa / (pa + {R}) * pb, pc - pb / (pa + {R}) * pb, (y - lv) / sqrt(pa + {R})
  FROM (SELECT ky.symbol, ky.k, ky.y, level + slope AS lv, slope AS sl, a + 2 * b + c + {Q / 4} AS pa, b + c + {Q / 2} AS pb, c + {Q} AS pc FROM kf JOIN ky ON ky.symbol = kf.symbol AND ky.k = kf.k + 1) p)"""


@query("kalman_trend", rounded_sql(f"WITH RECURSIVE {KALMAN}\nSELECT kf.symbol, dt, exp(level) AS level, slope, 2 * sqrt(a) AS band, z FROM kf JOIN ky ON ky.symbol = kf.symbol AND ky.k = kf.k", "level", "slope", "band", "z", digits=5))
def kalman_trend(spark, sf_dir: str) -> DataFrame:
    return rounded(mo.kalman_trend(bars(spark, sf_dir)), 5)


FEATURED = f"""{RSI}, v1 AS (SELECT symbol, dt, close, volume, {LAG} AS pc, close / lag(close, 5) OVER {W}) - 1 AS ret5, close / {LAG} - 1 AS ret1, (volume - {full('avg', 'volume', 20)}) / nullif({full('stddev_samp', 'volume', 20)}, 0) AS volz, lead(close, 5) OVER {W}) / close - 1 AS fwd FROM bars),
 v2 AS (SELECT v1.*, {full('stddev_samp', 'ret1', 10)} AS vol10, (rsi_14 - 50) / 50 AS rsi FROM v1 JOIN (SELECT symbol, dt, rsi_14 FROM rsi) r USING (symbol, dt))"""
ANALOG = f"""{FEATURED}, w1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back FROM v2 WHERE ret1 IS NOT NULL AND ret5 IS NOT NULL AND vol10 IS NOT NULL AND rsi IS NOT NULL AND volz IS NOT NULL) t WHERE back <= 90),
 w2 AS (SELECT symbol, dt, back, fwd, {', '.join(f'({f} - avg({f}) OVER p) / CASE WHEN stddev_pop({f}) OVER p < 1e-12 THEN 1 ELSE stddev_pop({f}) OVER p END AS {f}' for f in mo.SHAPE)} FROM w1 WINDOW p AS (PARTITION BY symbol)),
 w3 AS (SELECT a.symbol, a.dt, a.back, a.fwd, ({' + '.join(f'a.{f} * b.{f}' for f in mo.SHAPE)}) / sqrt(5.0) AS score FROM w2 a JOIN w2 b ON a.symbol = b.symbol AND b.back = 1),
 w4 AS (SELECT *, exp(score - max(score) OVER (PARTITION BY symbol)) AS e FROM w3), w5 AS (SELECT symbol, dt, back, fwd, e / sum(e) OVER (PARTITION BY symbol) AS weight FROM w4)"""


@query("attention_analogs", rounded_sql(f"WITH {ANALOG}\nSELECT symbol, dt, weight, CASE WHEN back > 5 THEN fwd END AS fwd FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, dt) AS rn FROM w5 WHERE back > 1) t WHERE rn <= 5", "weight", "fwd", digits=5))
def attention_analogs(spark, sf_dir: str) -> DataFrame:
    return rounded(mo.analogs(bars(spark, sf_dir)), 5)


def fan_sql(source: str, key: str, horizon: int, paths: int) -> str:
    """Named subqueries up to fg: resampled growth of a source (key, k, ret)."""
    u = f"CAST(CAST('0x' || substr(md5('fan7:' || {key} || ':' || path || ':' || b), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
    return f"""fz AS (SELECT {key}, count(*) AS n FROM {source} GROUP BY 1 HAVING count(*) >= 40), fp AS (SELECT {key}, n, p.i AS path, b.i AS b FROM fz, range({paths}) p(i), range({-(-horizon // 5)}) b(i)),
 fs AS (SELECT {key}, path, b * 5 + o.i + 1 AS t, CAST(floor({u} * (n - 4)) AS BIGINT) + o.i AS k FROM fp, range(5) o(i) WHERE b * 5 + o.i + 1 <= {horizon}),
 fg AS (SELECT {key}, path, t, round(product(1 + ret) OVER (PARTITION BY {key}, path ORDER BY t ROWS UNBOUNDED PRECEDING), 9) AS growth FROM fs JOIN {source} USING ({key}, k))"""


RETS = f"{BARS}, nr AS (SELECT symbol, ret, row_number() OVER {W}) - 1 AS k FROM (SELECT symbol, dt, close / {LAG} - 1 AS ret FROM bars) t WHERE ret IS NOT NULL)"
FAN = f"{RETS}, {fan_sql('nr', 'symbol', 20, 100)}"


@query("price_fan", rounded_sql(f"WITH {FAN}\nSELECT symbol, t, {', '.join(f'quantile_cont(growth, {p / 100}) AS p{p}' for p in (5, 25, 50, 75, 95))} FROM fg GROUP BY 1, 2", "p5", "p25", "p50", "p75", "p95", digits=5))
def price_fan(spark, sf_dir: str) -> DataFrame:
    return rounded(mo.price_fan(bars(spark, sf_dir), 20, 100, 8)[0], 5)


@query("price_fan_paths", rounded_sql(f"WITH {FAN}\nSELECT symbol, path, growth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY growth, path) - 1 AS rank FROM fg WHERE t = 20) t WHERE rank IN ({', '.join(str(int(i * 99 / 7)) for i in range(8))})", "growth"))
def price_fan_paths(spark, sf_dir: str) -> DataFrame:
    """Paths evenly spaced through the sorted ends."""
    return rounded(mo.price_fan(bars(spark, sf_dir), 20, 100, 8)[1])


ALIGNED = f"{BARS}, ar AS (SELECT symbol, dt, close / {LAG} - 1 AS ret FROM bars), al AS (SELECT * FROM ar WHERE ret IS NOT NULL AND dt IN (SELECT dt FROM ar WHERE ret IS NOT NULL GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ar WHERE ret IS NOT NULL)))"
BASKET = f"{ALIGNED}, bk AS (SELECT 'all' AS all_, ret, row_number() OVER (ORDER BY dt) - 1 AS k FROM (SELECT dt, avg(ret) AS ret FROM al GROUP BY dt) t), {fan_sql('bk', 'all_', 34, 200)}, pn AS (SELECT t AS horizon, round(growth - 1, 9) AS pnl FROM fg WHERE t IN (1, 2, 3, 5, 8, 13, 21, 34)), ct AS (SELECT horizon, quantile_cont(pnl, 0.05) AS cut, quantile_cont(pnl, 0.95) AS p95 FROM pn GROUP BY 1)"


@query("var_analysis", rounded_sql(f"WITH {BASKET}\nSELECT horizon, -any_value(cut) AS var, coalesce(-avg(CASE WHEN pnl <= cut THEN pnl END), -any_value(cut)) AS es, any_value(p95) AS p95 FROM pn JOIN ct USING (horizon) GROUP BY 1", "var", "es", "p95", digits=5))
def var_analysis(spark, sf_dir: str) -> DataFrame:
    return rounded(mo.value_at_risk(bars(spark, sf_dir), n_paths=200), 5)


UP = "CAST(CAST('0x' || substr(md5('mix7:' || p.i || ':' || symbol), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
FRONT = f"""{ALIGNED}, mu AS (SELECT symbol, avg(ret) * 252 AS mu FROM al GROUP BY 1), cv AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM al a JOIN al b USING (dt) GROUP BY 1, 2),
 we AS (SELECT p.i AS portfolio, symbol, mu, -ln(1 - {UP}) AS e FROM mu CROSS JOIN range(300) p(i)), ww AS (SELECT portfolio, symbol, mu, e / sum(e) OVER (PARTITION BY portfolio) AS w FROM we),
 pg AS (SELECT portfolio, sum(w * mu) AS ret FROM ww GROUP BY 1), pv AS (SELECT x.portfolio, sqrt(sum(x.w * y.w * cov)) AS vol FROM ww x JOIN ww y ON x.portfolio = y.portfolio JOIN cv ON cv.a = x.symbol AND cv.b = y.symbol GROUP BY 1),
 pf AS (SELECT portfolio, ret, vol, (ret - 0.065) / greatest(vol, 1e-9) AS sharpe FROM pg JOIN pv USING (portfolio))"""


@query("efficient_frontier", rounded_sql(f"WITH {FRONT}\nSELECT * FROM pf", "ret", "vol", "sharpe"))
def efficient_frontier(spark, sf_dir: str) -> DataFrame:
    return rounded(mo.portfolios(bars(spark, sf_dir), 300))


U1, U2 = (f"((CAST(CAST('0x' || substr(md5('heston7:' || symbol || ':' || path || ':' || (day + 1) || ':{x}'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)" for x in "ab")
HORIZON, PATHS = 120, 2000
HESTON = f"""{BARS}, hb AS (SELECT symbol, max_by(close, dt) AS spot, pow(stddev_samp(r) * sqrt(252), 2) AS theta FROM (SELECT symbol, dt, close, ln(close / {LAG}) AS r FROM bars) x GROUP BY 1),
 hs AS (SELECT symbol, theta, i AS path, CAST(0 AS BIGINT) AS day, CAST(spot AS DOUBLE) AS s, theta AS v FROM hb, range({PATHS}) t(i) WHERE theta IS NOT NULL
  UNION ALL SELECT symbol, theta, path, day + 1, s * exp(-0.5 * vp / 252.0 + sqrt(vp / 252.0) * z1), v + 2.0 * (theta - vp) / 252.0 + 0.6 * sqrt(vp / 252.0) * (-0.7 * z1 + {math.sqrt(1 - 0.49)!r} * z2)
  FROM (SELECT symbol, theta, path, day, s, v, greatest(v, 0) AS vp, {ppf_sql('u1')} AS z1, {ppf_sql('u2')} AS z2 FROM (SELECT *, {U1} AS u1, {U2} AS u2 FROM hs WHERE day < {HORIZON}) a) b)"""


@query("heston_fan", rounded_sql(f"WITH RECURSIVE {HESTON}\nSELECT symbol, path, s AS price, sqrt(greatest(v, 0)) AS vol FROM hs WHERE day = {HORIZON}", "price", "vol", digits=5))
def heston_fan(spark, sf_dir: str) -> DataFrame:
    """Paths from each symbol's last close; its variance reverts to that of its days."""
    r = bars(spark, sf_dir).select("symbol", "dt", "close", S.log_returns("close").alias("r"))
    starts = r.groupBy("symbol").agg(F.max_by("close", "dt").alias("spot"), (F.stddev_samp("r") * math.sqrt(252)).alias("iv"))
    return rounded(mo.heston(starts, "symbol", HORIZON, PATHS), 5)


PLANE = ((3, 20), (15, 39))
SEARCHED = _GRID_SQL.replace("(VALUES (5, 10), (5, 20), (5, 50), (10, 20), (10, 50), (20, 50)) t(fast, slow)", f"range({PLANE[0][0]}, {PLANE[0][1] + 1}) x(fast), range({PLANE[1][0]}, {PLANE[1][1] + 1}) y(slow) WHERE fast < slow").replace("\nSELECT fast", ", gs AS (SELECT fast")


@query("swarm_optimize", rounded_sql(f"{SEARCHED}), av AS (SELECT fast, slow, avg(sharpe) AS sharpe FROM gs GROUP BY 1, 2), al AS (SELECT CAST(x.i AS BIGINT) AS fast, CAST(y.i AS BIGINT) AS slow FROM range({PLANE[0][0]}, {PLANE[0][1] + 1}) x(i), range({PLANE[1][0]}, {PLANE[1][1] + 1}) y(i))\nSELECT fast, slow, coalesce(sharpe, {mo.PENALTY}) AS sharpe, fast < slow AS is_run, row_number() OVER (ORDER BY coalesce(sharpe, {mo.PENALTY}) DESC, fast DESC, slow DESC) = 1 AS is_best, count(*) OVER () AS n_trials FROM al LEFT JOIN av USING (fast, slow)", "sharpe"))
def swarm_optimize(spark, sf_dir: str) -> DataFrame:
    """All pairs that the swarm or its landscape tried, over all symbols; the landscape's 25 steps are every pair of this plane."""
    known, _ = mo.swarm(bars(spark, sf_dir), PLANE)
    winner = max(known, key=lambda p: (known[p], p))
    rows = [(*p, v, p[0] < p[1], p == winner, len(known)) for p, v in known.items()]
    return rounded(spark.createDataFrame(rows, "fast long, slow long, sharpe double, is_run boolean, is_best boolean, n_trials long"))


NAMES = ["ret1", "ret5"]
MATRIX = f"""{BARS}, mx AS (SELECT symbol, dt, close / {LAG} - 1 AS ret1, close / lag(close, 5) OVER {W}) - 1 AS ret5, lead(close, 5) OVER {W}) / close - 1 AS y FROM bars), ml AS (SELECT *, row_number() OVER {W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM mx WHERE ret1 IS NOT NULL AND ret5 IS NOT NULL AND y IS NOT NULL),
 mt AS (SELECT symbol, dt, i, ret1, ret5, y, i < floor(n * 0.75) AS train FROM ml),
 ms AS (SELECT symbol, dt, i, y, train, {', '.join(f'({f} - avg(CASE WHEN train THEN {f} END) OVER p) / CASE WHEN stddev_pop(CASE WHEN train THEN {f} END) OVER p < 1e-12 THEN 1 ELSE stddev_pop(CASE WHEN train THEN {f} END) OVER p END AS {f}' for f in NAMES)} FROM mt WINDOW p AS (PARTITION BY symbol)),
 mg AS (SELECT symbol, sum(ret1 * ret1) + 1 AS a, sum(ret1 * ret5) AS b, sum(ret5 * ret5) + 1 AS d, sum(ret1 * y) AS p, sum(ret5 * y) AS q FROM ms WHERE train GROUP BY 1), mw AS (SELECT symbol, (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2 FROM mg)"""


def learning(spark, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).withColumns({"ret1": S.returns("close"), "ret5": S.momentum("close", 5)})
    return mo.learning_rows(rows, NAMES)


@query("feature_matrix", rounded_sql(f"WITH {MATRIX}\nSELECT symbol, dt, ret1, ret5, y, train FROM mt", "ret1", "ret5", "y"))
def feature_matrix(spark, sf_dir: str) -> DataFrame:
    return rounded(learning(spark, sf_dir).drop("i"))


@query("standardize_features", rounded_sql(f"WITH {MATRIX}\nSELECT symbol, dt, ret1, ret5 FROM ms", "ret1", "ret5", digits=5))
def standardize_features(spark, sf_dir: str) -> DataFrame:
    return rounded(mo.standardised(learning(spark, sf_dir), NAMES).select("symbol", "dt", *NAMES), 5)


@query("fit_ridge", rounded_sql(f"WITH {MATRIX}\nSELECT symbol, w1, w2 FROM mw", "w1", "w2"))
def fit_ridge(spark, sf_dir: str) -> DataFrame:
    w = mo.ridge(mo.standardised(learning(spark, sf_dir), NAMES), NAMES)
    return rounded(w.select("symbol", F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2")))


JUDGED = f"""{MATRIX}, mp AS (SELECT ms.*, w1 * ret1 + w2 * ret5 AS pred, min(CASE WHEN NOT train THEN i END) OVER (PARTITION BY symbol) AS first, max(i) OVER (PARTITION BY symbol) AS last FROM ms JOIN mw USING (symbol)), mq AS (SELECT *, NOT train AND (i - first) % 5 = 0 AND i < last AS taken FROM mp)"""
FIGURES = ("acc_train", "acc_test", "baseline_test", "equity_model", "equity_hold")


@query("train_model", rounded_sql(f"""WITH {JUDGED}
SELECT symbol, CAST(count(CASE WHEN train THEN 1 END) AS BIGINT) AS n_train, CAST(count(CASE WHEN NOT train THEN 1 END) AS BIGINT) AS n_test, avg(CASE WHEN train AND y <> 0 THEN CASE WHEN sign(pred) = sign(y) THEN 1.0 ELSE 0.0 END END) AS acc_train, avg(CASE WHEN NOT train AND y <> 0 THEN CASE WHEN sign(pred) = sign(y) THEN 1.0 ELSE 0.0 END END) AS acc_test,
 greatest(avg(CASE WHEN NOT train THEN CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END END), 1 - avg(CASE WHEN NOT train THEN CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END END)) AS baseline_test, product(CASE WHEN taken THEN 1 + sign(pred) * y END) AS equity_model, product(CASE WHEN taken THEN 1 + y END) AS equity_hold FROM mq GROUP BY symbol HAVING count(*) >= 200""", *FIGURES, digits=5))
def train_model(spark, sf_dir: str) -> DataFrame:
    rows = mo.standardised(learning(spark, sf_dir), NAMES)
    pred = rows.join(mo.ridge(rows, NAMES), "symbol").withColumn("pred", F.col("weights")[0] * F.col("ret1") + F.col("weights")[1] * F.col("ret5"))
    return rounded(mo.scored(pred.select("symbol", "dt", "i", "train", "y", "pred")), 5)


@query("fit_stumps")
def fit_stumps(spark, sf_dir: str) -> DataFrame:
    return rounded(mo.scored(mo.stumps(mo.standardised(learning(spark, sf_dir), NAMES), NAMES)), 5)


#: Positions of the book: net quantity of each brand, which is a contract that expires on a day of its number.
HELD = f"{FILLS}, hp AS (SELECT instrument, CAST(regexp_extract(instrument, '([0-9]+)', 1) AS INTEGER) AS no, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS net, sum(CASE side WHEN 'BUY' THEN -qty * price ELSE qty * price END) AS cash FROM fills GROUP BY 1), hx AS (SELECT *, DATE '2026-01-01' + no AS expiry FROM hp)"


def positions(spark, sf_dir: str) -> DataFrame:
    no = F.regexp_extract("instrument", "([0-9]+)", 1).cast("int")
    p = fills(spark, sf_dir).groupBy("instrument").agg(F.sum(book.signed()).alias("net"), F.sum(-book.signed() * F.col("price")).alias("cash")).withColumn("no", no)
    return p.withColumn("expiry", F.date_add(F.lit("2026-01-01").cast("date"), F.col("no")))


@query("book_expired", f"WITH {HELD}\nSELECT instrument, expiry FROM hx WHERE net <> 0 AND expiry < DATE '2026-02-01'")
def book_expired(spark, sf_dir: str) -> DataFrame:
    """Positions whose contract has expired."""
    return positions(spark, sf_dir).where("net != 0 AND expiry < DATE '2026-02-01'").select("instrument", "expiry")


@query("settle_expired", rounded_sql(f"WITH {HELD}\nSELECT instrument, CASE WHEN expiry < DATE '2026-02-01' THEN 0.0 ELSE net END AS net, cash + CASE WHEN expiry < DATE '2026-02-01' THEN net * no * 10.0 ELSE 0 END AS cash, CASE WHEN net = 0 THEN 'refused: no position' WHEN NOT expiry < DATE '2026-02-01' THEN 'refused: still trades' ELSE 'settled' END AS status FROM hx", "net", "cash", digits=2))
def settle_expired(spark, sf_dir: str) -> DataFrame:
    """Contracts that no longer trade are closed at a stated price; others are refused."""
    gone = F.col("expiry") < F.lit("2026-02-01").cast("date")
    p = positions(spark, sf_dir)
    status = F.when(F.col("net") == 0, "refused: no position").when(~gone, "refused: still trades").otherwise("settled")
    return rounded(p.select("instrument", F.when(gone, 0.0).otherwise(F.col("net")).cast("double").alias("net"), (F.col("cash") + F.when(gone, F.col("net") * F.col("no") * 10.0).otherwise(0.0)).alias("cash"), status.alias("status")), 2)


@query("trade_lots", f"WITH {FILLS}\nSELECT instrument, seq, CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(qty * 65 AS DOUBLE) END AS units, CASE WHEN seq % 5 = 0 THEN 'refused: no lot size' ELSE 'ok' END AS status FROM fills")
def trade_lots(spark, sf_dir: str) -> DataFrame:
    """Lots to units; without a lot size nothing is traded."""
    lot = F.when(F.col("seq") % 5 != 0, 65)
    f = fills(spark, sf_dir)
    return f.select("instrument", "seq", (F.col("qty") * lot).cast("double").alias("units"), F.when(lot.isNull(), "refused: no lot size").otherwise("ok").alias("status"))


#: What was asked of the exchange for each customer's book: the fingerprint that was priced, what could not be priced, the margin.
MARGIN = """mb AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'book' || c_custkey END AS book, CASE WHEN c_custkey % 6 IN (1, 2) THEN NULL WHEN c_custkey % 6 = 4 THEN 'book0' ELSE 'book' || c_custkey END AS priced, CASE WHEN c_custkey % 6 = 2 THEN 'book' || c_custkey END AS asked, CASE WHEN c_custkey % 6 = 3 THEN 'GOLD FUT' END AS unpriceable, abs(c_acctbal) AS margin FROM customer),
 st AS (SELECT *, CASE WHEN book IS NULL THEN 'flat' WHEN priced IS NULL THEN CASE WHEN asked = book THEN 'refused' ELSE 'unpriced' END WHEN unpriceable IS NOT NULL THEN 'unpriceable' WHEN priced <> book THEN 'stale' ELSE 'priced' END AS state FROM mb)"""


def margins(spark, sf_dir: str) -> DataFrame:
    k, own = F.col("c_custkey"), F.concat(F.lit("book"), F.col("c_custkey").cast("string"))
    m = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 6 != 0, own).alias("book"), F.when((k % 6).isin(1, 2), None).when(k % 6 == 4, "book0").otherwise(own).alias("priced"), F.when(k % 6 == 2, own).alias("asked"), F.when(k % 6 == 3, "GOLD FUT").alias("unpriceable"), F.abs("c_acctbal").alias("margin"))
    state = F.when(F.col("book").isNull(), "flat").when(F.col("priced").isNull(), F.when(F.col("asked") == F.col("book"), "refused").otherwise("unpriced")).when(F.col("unpriceable").isNotNull(), "unpriceable").when(F.col("priced") != F.col("book"), "stale").otherwise("priced")
    return m.withColumn("state", state)


@query("margin_status", f"WITH {MARGIN}\nSELECT c_custkey, state FROM st")
def margin_status(spark, sf_dir: str) -> DataFrame:
    """Why a book's margin is known, or not."""
    return margins(spark, sf_dir).select("c_custkey", "state")


@query("margin_used", rounded_sql(f"WITH {MARGIN}\nSELECT c_custkey, CASE state WHEN 'flat' THEN 0.0 WHEN 'priced' THEN margin END AS used FROM st", "used", digits=3))
def margin_used(spark, sf_dir: str) -> DataFrame:
    """Only a margin that was priced for this very book counts."""
    m = margins(spark, sf_dir)
    return rounded(m.select("c_custkey", F.when(F.col("state") == "flat", 0.0).when(F.col("state") == "priced", F.col("margin")).alias("used")), 3)


@query("price_margin", f"WITH {MARGIN}\nSELECT c_custkey, book FROM st WHERE state IN ('unpriced', 'stale')")
def price_margin(spark, sf_dir: str) -> DataFrame:
    """Books that the exchange has to be asked about: those whose fingerprint was not asked about before."""
    return margins(spark, sf_dir).where("state IN ('unpriced', 'stale')").select("c_custkey", "book")


@query("brief_votes", f"""WITH {BT}, bb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k DESC) AS back FROM bt), tr AS (SELECT symbol, max(CASE WHEN back = 1 THEN pos END) AS pos, max(CASE WHEN back = 1 THEN close END) / max(CASE WHEN back = 22 THEN close END) - 1 AS mom FROM bb GROUP BY 1),
 vo AS (SELECT symbol, CAST(sign(pos) AS INTEGER) AS vote FROM tr UNION ALL SELECT symbol, CASE WHEN mom > 0.02 THEN 1 WHEN mom < -0.02 THEN -1 ELSE 0 END FROM tr)
SELECT symbol, CAST(sum(vote) AS BIGINT) AS net, CASE WHEN max(vote) = 1 AND min(vote) = -1 THEN 'sections disagree' WHEN sum(vote) > 0 THEN 'bullish' WHEN sum(vote) < 0 THEN 'bearish' ELSE 'neutral' END AS label FROM vo GROUP BY 1""")
def brief_votes(spark, sf_dir: str) -> DataFrame:
    """Votes of sections, their sum, and whether they disagree."""
    from .backtests import done

    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("k")))
    d = done(spark, sf_dir).withColumn("back", back).where("back IN (1, 22)").groupBy("symbol").agg(F.max(F.when(F.col("back") == 1, F.col("pos"))).alias("pos"), (F.max(F.when(F.col("back") == 1, F.col("close"))) / F.max(F.when(F.col("back") == 22, F.col("close"))) - 1).alias("mom"))
    votes = F.array(F.signum("pos").cast("int"), F.when(F.col("mom") > 0.02, 1).when(F.col("mom") < -0.02, -1).otherwise(0))
    v = d.select("symbol", F.explode(votes).alias("vote")).groupBy("symbol").agg(F.sum("vote").alias("net"), F.max("vote").alias("hi"), F.min("vote").alias("lo"))
    label = F.when((F.col("hi") == 1) & (F.col("lo") == -1), "sections disagree").when(F.col("net") > 0, "bullish").when(F.col("net") < 0, "bearish").otherwise("neutral")
    return v.select("symbol", "net", label.alias("label"))


DAYS = 250
U_MADE = "(CAST(CAST('0x' || substr(md5('made:' || symbol || ':' || day), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0"
SYNTH = f"""{BARS}, sy AS (SELECT s.symbol, first, d.i + 1 AS day FROM (SELECT symbol, min_by(close, dt) AS first FROM bars GROUP BY 1) s CROSS JOIN range({DAYS}) d(i)), su AS (SELECT *, {U_MADE} AS u FROM sy), sr AS (SELECT symbol, first, day, 0.0003 + CASE WHEN (day // 50) % 2 = 0 THEN 0.01 ELSE 0.02 END * {ppf_sql('u')} AS r FROM su)"""


@query("synthetic_history", rounded_sql(f"WITH {SYNTH}\nSELECT symbol, day, first * exp(sum(r) OVER (PARTITION BY symbol ORDER BY day)) AS close FROM sr", "close", digits=4))
def synthetic_history(spark, sf_dir: str) -> DataFrame:
    """Made-up closes from each symbol's first one, the same for a name each time: a random walk that is calm and wild by turns."""
    from ..operators.validation import norm_ppf, uniform

    first = bars(spark, sf_dir).groupBy("symbol").agg(F.min_by("close", "dt").alias("first"))
    rows = first.withColumn("day", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(DAYS).cast("long"))))
    u = (uniform(F.lit("made"), "symbol", "day") * 2.0**48 + 0.5) / 2.0**48
    wild = F.when(F.floor(F.col("day") / 50) % 2 == 0, 0.01).otherwise(0.02)
    rows = rows.withColumn("r", 0.0003 + wild * norm_ppf(u))
    return rounded(rows.select("symbol", "day", (F.col("first") * F.exp(F.sum("r").over(Window.partitionBy("symbol").orderBy("day")))).alias("close")), 4)


@query("registered_strategy", f"WITH {BARS}\nSELECT symbol, dt, CAST(CASE WHEN {full('avg', 'close', 50)} IS NULL THEN 0 WHEN {full('avg', 'close', 10)} > {full('avg', 'close', 50)} THEN 1 ELSE -1 END AS DOUBLE) AS signal FROM bars")
def registered_strategy(spark, sf_dir: str) -> DataFrame:
    """A strategy by name: its defaults, but for what is given."""
    from ..plans.registry import STRATEGIES

    return STRATEGIES["sma_cross"].signal(bars(spark, sf_dir), fast=10).select("symbol", "dt", "signal")


@query("registered_features", rounded_sql(f"WITH {BARS}\nSELECT symbol, dt, close / {LAG} - 1 AS ret1, (high - low) / close AS range FROM bars", "ret1", "range"))
def registered_features(spark, sf_dir: str) -> DataFrame:
    from ..plans.registry import with_features

    return rounded(with_features(bars(spark, sf_dir), ["ret1", "range"]).select("symbol", "dt", "ret1", "range"))
