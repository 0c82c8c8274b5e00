"""Validation queries: is the moving-average cross on bars more than luck."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from ..operators import validation as va
from ..sources.views import BARS, bars
from . import query, rounded, rounded_sql
from .backtests import BT, GRID, KEY, done
from .chains import cdf
from .indicators import LAG, W

S = Series()
PERMS, PATHS, TRIALS = 100, 100, 6


def horner_sql(x: str, coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def ppf_sql(p: str) -> str:
    tail = lambda q: f"({horner_sql(q, va.PPF_C)} / {horner_sql(q, va.PPF_D)})"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    d = f"({p} - 0.5)"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {va.PPF_LOW} THEN {tail(low)} WHEN {p} > {1 - va.PPF_LOW} THEN -{tail(high)} ELSE {d} * {horner_sql(f'{d} * {d}', va.PPF_A)} / {horner_sql(f'{d} * {d}', va.PPF_B)} END)"


def held(spark, sf_dir: str) -> DataFrame:
    return done(spark, sf_dir).withColumn("change", F.coalesce(S.returns("close"), F.lit(0.0)))


@query("norm_ppf", rounded_sql(f"WITH e AS (SELECT event_id, CAST((event_id % 1999) + 1 AS DOUBLE) / 2001.0 AS p FROM events)\nSELECT event_id, {ppf_sql('p')} AS x FROM e", "x"))
def norm_ppf(spark, sf_dir: str) -> DataFrame:
    from ..sources.views import table

    p = ((F.col("event_id") % 1999) + 1).cast("double") / 2001.0
    return rounded(table(spark, sf_dir, "events").select("event_id", va.norm_ppf(p).alias("x")))


SHARPE = "CASE WHEN coalesce(stddev_samp({0}) <= 1e-12, TRUE) THEN 0.0 ELSE avg({0}) / stddev_samp({0}) * sqrt(252.0) END"


@query("validator_sharpe", rounded_sql(f"WITH {BT}\nSELECT symbol, {SHARPE.format('ret')} AS sharpe FROM bt GROUP BY symbol", "sharpe"))
def validator_sharpe(spark, sf_dir: str) -> DataFrame:
    return rounded(done(spark, sf_dir).groupBy("symbol").agg(va.plain_sharpe(F.avg("ret"), F.stddev_samp("ret")).alias("sharpe")))


PERM = f"""{BT}, hb AS (SELECT symbol, k, pos, coalesce(close / {LAG} - 1, 0) AS change FROM bt),
 sz AS (SELECT symbol, count(*) AS n FROM hb GROUP BY symbol HAVING count(*) >= 80),
 bl AS (SELECT symbol, n, p.i AS perm, b.i AS block FROM sz, range({PERMS}) p(i), range(1000) b(i) WHERE b.i < ceil(n / 20.0)),
 pl AS (SELECT *, row_number() OVER (PARTITION BY symbol, perm ORDER BY md5('7:' || symbol || ':' || perm || ':' || block)) - 1 AS place FROM bl),
 mv AS (SELECT pl.symbol, perm, place * 20 + k % 20 AS k, pos FROM pl JOIN hb ON hb.symbol = pl.symbol AND hb.k // 20 = pl.block WHERE pos <> 0),
 sm AS (SELECT mv.symbol, perm, sum(mv.pos * change) AS s, sum(mv.pos * change * mv.pos * change) AS q FROM mv JOIN hb ON hb.symbol = mv.symbol AND hb.k = mv.k GROUP BY 1, 2),
 st AS (SELECT sz.symbol, p.i AS perm, n, coalesce(s, 0) / n AS mean, coalesce(q, 0) AS q FROM sz CROSS JOIN range({PERMS}) p(i) LEFT JOIN sm ON sm.symbol = sz.symbol AND sm.perm = p.i),
 sd AS (SELECT *, sqrt(greatest(q - n * mean * mean, 0) / (n - 1)) AS sd FROM st),
 nul AS (SELECT symbol, perm, round(CASE WHEN sd <= 1e-12 THEN 0.0 ELSE mean / sd * sqrt(252.0) END, 9) AS null_sharpe FROM sd),
 obs AS (SELECT symbol, round({SHARPE.format('(pos * change)')}, 9) AS observed_sharpe FROM hb GROUP BY symbol),
 perms AS (SELECT symbol, max(observed_sharpe) AS observed_sharpe, (count(CASE WHEN null_sharpe >= observed_sharpe THEN 1 END) + 1) / {PERMS + 1}.0 AS p_value, 100 * avg(CASE WHEN null_sharpe < observed_sharpe THEN 1.0 ELSE 0.0 END) AS percentile FROM nul JOIN obs USING (symbol) GROUP BY symbol)"""


def tested(spark, sf_dir: str) -> DataFrame:
    return va.permutation_test(held(spark, sf_dir), KEY, PERMS)


@query("permutation_test", rounded_sql(f"WITH {PERM}\nSELECT symbol, observed_sharpe, p_value FROM perms", "observed_sharpe", "p_value"))
def permutation_test(spark, sf_dir: str) -> DataFrame:
    return rounded(tested(spark, sf_dir).drop("percentile"))


@query("permutation_percentile", rounded_sql(f"WITH {PERM}\nSELECT symbol, CAST(percentile AS DOUBLE) AS percentile FROM perms", "percentile"))
def permutation_percentile(spark, sf_dir: str) -> DataFrame:
    return rounded(tested(spark, sf_dir).select("symbol", "percentile"))


@query("permutation_verdict", f"WITH {PERM}\nSELECT symbol, CASE WHEN p_value < 0.01 THEN 'better than chance' WHEN p_value < 0.05 THEN 'better than chance, not decisively' WHEN p_value < 0.2 THEN 'cannot be told from luck' ELSE 'no evidence of timing skill' END AS verdict FROM perms")
def permutation_verdict(spark, sf_dir: str) -> DataFrame:
    return tested(spark, sf_dir).select("symbol", va.permutation_verdict(F.col("p_value")).alias("verdict"))


MOST = f"((1 - {va.EULER}) * {ppf_sql(f'(1 - 1 / {TRIALS}.0)')} + {va.EULER} * {ppf_sql(f'(1 - 1 / ({TRIALS}.0 * {math.e!r}))')})"
OWN, FREE = "(observed_sharpe / sqrt(252.0))", "(expected_max_sharpe / sqrt(252.0))"
BELOW = f"(1 - skew * {OWN} + (kurtosis - 1) / 4 * {OWN} * {OWN})"
DEFL = f"""{{base}}, ms AS (SELECT symbol, avg(ret) AS mean, stddev_samp(ret) AS sd, count(ret) AS n FROM bt GROUP BY symbol),
 m4 AS (SELECT symbol, n, mean, sd, avg(pow(ret - mean, 3)) AS m3, avg(pow(ret - mean, 4)) AS m4 FROM bt JOIN ms USING (symbol) GROUP BY symbol, n, mean, sd),
 df AS (SELECT symbol, n, CASE WHEN sd <= 1e-12 THEN 0.0 ELSE mean / sd * sqrt(252.0) END AS observed_sharpe, {MOST} AS expected_max_sharpe, CASE WHEN sd > 1e-12 THEN m3 / pow(sd, 3) ELSE 0 END AS skew, CASE WHEN sd > 1e-12 THEN m4 / pow(sd, 4) ELSE 3 END AS kurtosis FROM m4),
 dz AS (SELECT *, {BELOW} AS below FROM df),
 defl AS (SELECT *, CASE WHEN below > 0 THEN {cdf(f"(({OWN} - {FREE}) * sqrt(n - 1.0) / sqrt(below))")} END AS deflated FROM dz)"""


def deflated(spark, sf_dir: str) -> DataFrame:
    return va.deflated_sharpe(done(spark, sf_dir), KEY, TRIALS)


@query("deflated_sharpe", rounded_sql(f"WITH {DEFL.format(base=BT)}\nSELECT symbol, observed_sharpe, expected_max_sharpe, skew, kurtosis, deflated FROM defl", "observed_sharpe", "expected_max_sharpe", "skew", "kurtosis", "deflated"))
def deflated_sharpe(spark, sf_dir: str) -> DataFrame:
    return rounded(deflated(spark, sf_dir).drop("n", "n_trials"))


@query("deflated_verdict", f"WITH {DEFL.format(base=BT)}\nSELECT symbol, CASE WHEN observed_sharpe <= expected_max_sharpe THEN 'selection, not a strategy' WHEN deflated > 0.95 THEN 'survives deflation' WHEN deflated > 0.8 THEN 'marginal after deflation' ELSE 'does not survive deflation' END AS verdict FROM defl")
def deflated_verdict(spark, sf_dir: str) -> DataFrame:
    return deflated(spark, sf_dir).select("symbol", va.deflated_verdict(F.col("observed_sharpe"), F.col("expected_max_sharpe"), F.col("deflated")).alias("verdict"))


VALID = f"""{DEFL.format(base=PERM)}, vd AS (SELECT symbol, p_value, deflated, p_value < 0.05 AS timing, coalesce(deflated > 0.95, FALSE) AS size FROM perms JOIN defl USING (symbol))"""


@query("validate", rounded_sql(f"WITH {VALID}\nSELECT symbol, p_value, deflated, timing AND size AS passes FROM vd", "p_value", "deflated"))
def validate(spark, sf_dir: str) -> DataFrame:
    return rounded(va.validate(held(spark, sf_dir), KEY, TRIALS, n=PERMS).select("symbol", "p_value", "deflated", "passes"))


@query("validation_verdict", f"WITH {VALID}\nSELECT symbol, CASE WHEN timing AND size THEN 'passes both' ELSE 'rejected: ' || concat_ws('; and ', CASE WHEN NOT timing THEN 'timing is not distinguishable from random placement' END, CASE WHEN NOT size THEN 'Sharpe does not survive {TRIALS} trials' END) END AS verdict FROM vd")
def validation_verdict(spark, sf_dir: str) -> DataFrame:
    return va.validate(held(spark, sf_dir), KEY, TRIALS, n=PERMS).select("symbol", "verdict")


SEG = "(PARTITION BY symbol, w ORDER BY dt"
MEANS = ", ".join(f"CASE WHEN j >= {n - 1} THEN avg(close) OVER {SEG} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS m{n}" for n in (5, 10, 20, 50))
RUNS = " UNION ALL ".join(f"SELECT symbol, w, dt, close, test, CAST({f} AS BIGINT) AS fast, CAST({s} AS BIGINT) AS slow, round(m{f} - m{s}, 9) AS gap FROM mn" for f, s in GRID if f < s)
RUN = "(PARTITION BY symbol, w, fast, slow, test ORDER BY dt)"
WALK = f"""{BARS}, ix AS (SELECT symbol, dt, close, row_number() OVER {W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), ln AS (SELECT *, n // 5 AS length FROM ix),
 wn AS (SELECT ln.*, w.i AS w, n - (4 - w.i) * length AS begin_ FROM ln, range(4) w(i) WHERE length >= 40), wf AS (SELECT *, greatest(begin_ - CAST(floor(length * 0.7 / (1 - 0.7) + 1e-9) AS BIGINT), 0) AS first_ FROM wn),
 sg AS (SELECT symbol, w, dt, close, i - first_ AS j, i >= begin_ AS test FROM wf WHERE i >= first_ AND i < begin_ + length AND begin_ - first_ >= 40),
 mn AS (SELECT *, {MEANS} FROM sg), rn AS ({RUNS}), si AS (SELECT *, CASE WHEN gap IS NULL THEN 0.0 WHEN gap > 0 THEN 1.0 ELSE -1.0 END AS sig, lag(close) OVER {RUN} AS pc FROM rn),
 po AS (SELECT *, CAST(coalesce(lag(sig) OVER {RUN}, 0) AS DOUBLE) AS pos, coalesce(close / pc - 1, 0) AS chg FROM si),
 re AS (SELECT *, pos * chg - abs(pos - coalesce(lag(pos) OVER {RUN}, 0)) * 0.001 AS ret FROM po),
 sc AS (SELECT symbol, w, fast, slow, test, round(CASE WHEN count(*) < 2 OR stddev_samp(ret) <= greatest(abs(avg(ret)), 1.0) * 1e-12 THEN 0.0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252.0) END, 9) AS sharpe, product(1 + ret) - 1 AS total FROM re GROUP BY ALL),
 pk AS (SELECT symbol, w, fast, slow, sharpe AS is_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol, w ORDER BY sharpe DESC, fast, slow) AS r FROM sc WHERE NOT test) t WHERE r = 1),
 wd AS (SELECT pk.*, sc.sharpe AS oos_sharpe, sc.total AS oos_return FROM pk JOIN sc USING (symbol, w, fast, slow) WHERE test),
 sp AS (SELECT symbol, dt, ret FROM re JOIN pk USING (symbol, w, fast, slow) WHERE test),
 eq AS (SELECT *, product(1 + ret) OVER {W} ROWS UNBOUNDED PRECEDING) AS equity FROM sp), dd AS (SELECT *, equity / max(equity) OVER {W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq),
 ov AS (SELECT symbol, CASE WHEN stddev_samp(ret) <= greatest(abs(avg(ret)), 1.0) * 1e-12 THEN 0.0 ELSE avg(ret) / stddev_samp(ret) * sqrt(252.0) END AS oos_sharpe, max_by(equity, dt) - 1 AS oos_return, min(dd) AS oos_max_dd FROM dd GROUP BY symbol),
 ea AS (SELECT symbol, count(*) AS n_windows, avg(is_sharpe) AS is_sharpe_mean, count(DISTINCT (fast, slow)) AS kinds FROM wd GROUP BY symbol),
 wk AS (SELECT symbol, CAST(n_windows AS BIGINT) AS n_windows, is_sharpe_mean, oos_sharpe, oos_return, oos_max_dd, CASE WHEN abs(is_sharpe_mean) > 1e-9 THEN greatest(oos_sharpe, 0) / greatest(is_sharpe_mean, 1e-9) ELSE 0 END AS efficiency, 1 - (kinds - 1) / CAST(n_windows AS DOUBLE) AS param_stability FROM ea JOIN ov USING (symbol))"""


@query("walk_forward", rounded_sql(f"WITH {WALK}\nSELECT symbol, CAST(w AS INTEGER) AS w, fast, slow, is_sharpe, oos_sharpe, oos_return FROM wd", "is_sharpe", "oos_sharpe", "oos_return"))
def walk_forward(spark, sf_dir: str) -> DataFrame:
    return rounded(va.walk_forward(bars(spark, sf_dir), GRID)[0].select("symbol", "w", "fast", "slow", "is_sharpe", "oos_sharpe", "oos_return"))


FIGURES = ("is_sharpe_mean", "oos_sharpe", "oos_return", "oos_max_dd", "efficiency", "param_stability")


@query("walk_forward_verdict", rounded_sql(f"WITH {WALK}\nSELECT *, CASE WHEN efficiency >= 0.7 AND oos_sharpe > 0.5 THEN 'robust' WHEN efficiency >= 0.4 AND oos_sharpe > 0 THEN 'fragile' ELSE 'overfit' END AS verdict FROM wk", *FIGURES, digits=5))
def walk_forward_verdict(spark, sf_dir: str) -> DataFrame:
    return rounded(va.walk_forward_summary(*va.walk_forward(bars(spark, sf_dir), GRID)), 5)


U = "CAST(CAST('0x' || substr(md5('7:' || symbol || ':' || path || ':' || b), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
MC = f"""{BT}, sz AS (SELECT symbol, count(*) AS n FROM bt GROUP BY symbol HAVING count(*) >= 40),
 pb AS (SELECT symbol, n, p.i AS path, b.i AS b FROM sz, range({PATHS}) p(i), range(2000) b(i) WHERE b.i < ceil(n / 10.0)), pt AS (SELECT *, CAST(floor({U} * (n - 9)) AS BIGINT) AS start FROM pb),
 pw AS (SELECT symbol, path, b * 10 + o.i AS t, start + o.i AS k FROM pt, range(10) o(i) WHERE b * 10 + o.i < n), pe AS (SELECT symbol, path, t, product(1 + ret) OVER (PARTITION BY symbol, path ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT pw.*, bt.ret FROM pw JOIN bt USING (symbol, k)) q),
 pd AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, path ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM pe), en AS (SELECT symbol, path, round(max_by(equity, t), 9) AS terminal, min(dd) AS worst FROM pd GROUP BY 1, 2),
 mc AS (SELECT symbol, quantile_cont(terminal, 0.05) AS terminal_p5, quantile_cont(terminal, 0.5) AS terminal_p50, quantile_cont(terminal, 0.95) AS terminal_p95, avg(CASE WHEN terminal < 1 THEN 1.0 ELSE 0.0 END) AS prob_loss, quantile_cont(worst, 0.5) AS max_dd_median, quantile_cont(worst, 0.05) AS max_dd_p95 FROM en GROUP BY symbol)"""
ENDS = ("terminal_p5", "terminal_p50", "terminal_p95", "prob_loss", "max_dd_median", "max_dd_p95")


@query("monte_carlo", rounded_sql(f"WITH {MC}\nSELECT * FROM mc", *ENDS, digits=5))
def monte_carlo(spark, sf_dir: str) -> DataFrame:
    return rounded(va.monte_carlo(done(spark, sf_dir), KEY, PATHS).drop("verdict"), 5)


@query("monte_carlo_verdict", f"WITH {MC}\nSELECT symbol, CASE WHEN prob_loss < 0.2 AND max_dd_p95 > -0.35 THEN 'paths are mostly favourable' WHEN prob_loss < 0.45 THEN 'close to a coin flip' ELSE 'most paths lose money' END AS verdict FROM mc")
def monte_carlo_verdict(spark, sf_dir: str) -> DataFrame:
    return va.monte_carlo(done(spark, sf_dir), KEY, PATHS).select("symbol", "verdict")


def t_sql(x: str, least: int) -> str:
    return f"CASE WHEN count({x}) >= {least} AND stddev_samp({x}) > 0 THEN avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) END"


R = f"{BARS}, r AS (SELECT symbol, dt, row_number() OVER {W}) AS k, close / {LAG} - 1 AS r FROM bars)"
for _name, _least in (("t_stat_news", 3), ("t_stat_participants", 8)):

    def _t(spark, sf_dir: str, least=_least) -> DataFrame:
        """Mean over its standard error by symbol and month; NULL below the least number."""
        r = bars(spark, sf_dir).withColumn("r", S.returns("close")).groupBy("symbol", F.trunc("dt", "MM").alias("month"))
        t = F.when((F.count("r") >= least) & (F.stddev_samp("r") > 0), F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r"))))
        return rounded(r.agg(t.alias("t")))

    query(_name, rounded_sql(f"WITH {R}\nSELECT symbol, CAST(date_trunc('month', dt) AS DATE) AS month, {t_sql('r', _least)} AS t FROM r GROUP BY 1, 2", "t"))(_t)


LAGS = 5
PRODUCTS = ", ".join(f"sum(e * lag_{i}) AS g{i}" for i in range(1, LAGS + 1))


@query("newey_west_t", rounded_sql(f"""WITH {R}, c AS (SELECT symbol, k, r - avg(r) OVER (PARTITION BY symbol) AS e, r FROM r WHERE r IS NOT NULL),
 l AS (SELECT *, {', '.join(f'lag(e, {i}) OVER (PARTITION BY symbol ORDER BY k) AS lag_{i}' for i in range(1, LAGS + 1))} FROM c),
 g AS (SELECT symbol, count(*) AS n, avg(r) AS mean, sum(e * e) AS g0, {PRODUCTS} FROM l GROUP BY symbol)
SELECT symbol, mean / sqrt((g0 + 2 * ({' + '.join(f'(1 - {i} / {LAGS + 1}.0) * g{i}' for i in range(1, LAGS + 1))})) / n / n) AS t FROM g""", "t"))
def newey_west_t(spark, sf_dir: str) -> DataFrame:
    """t of the mean return with a variance that counts products of the last LAGS days, by Bartlett weights."""
    from pyspark.sql import Window

    r = bars(spark, sf_dir).withColumn("r", S.returns("close")).where("r IS NOT NULL")
    e = r.withColumn("e", F.col("r") - F.avg("r").over(Window.partitionBy("symbol")))
    e = e.withColumns({f"lag_{i}": S.lag("e", i) for i in range(1, LAGS + 1)})
    g = e.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("g0"), *(F.sum(F.col("e") * F.col(f"lag_{i}")).alias(f"g{i}") for i in range(1, LAGS + 1)))
    total = F.col("g0") + 2 * sum((1 - i / (LAGS + 1)) * F.col(f"g{i}") for i in range(1, LAGS + 1))
    return rounded(g.select("symbol", (F.col("mean") / F.sqrt(total / F.col("n") / F.col("n"))).alias("t")))
