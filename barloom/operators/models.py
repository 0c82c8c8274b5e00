"""Models of prices: trend filters, similar days, resampled fans, stochastic volatility, random portfolios, and learned directions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import YEAR, Series
from . import backtest as bt
from .gram import gram
from .recursive import with_recursive
from .scan import PIECE, Pieces, numbered, pieces, scan
from .validation import norm_ppf, uniform


def _gains(first: int, n: int, q: float, r: float) -> np.ndarray:
    """(n, 3): gain of the level, gain of the slope and spread of the bars from `first` on; they depend on a bar's number alone and soon stay the same."""
    a, b, c = 1.0, 0.0, 1.0  # variance of the level, covariance, variance of the slope
    out = np.zeros((n, 3))
    k, settled = 0, False
    while k < first + n:
        if settled and k < first:
            k = first
            continue
        old = a, b, c
        a, b, c = a + 2 * b + c + q / 4, b + c + q / 2, c + q
        spread = a + r
        gain, drift = a / spread, b / spread
        a, b, c = a - gain * a, b - gain * b, c - drift * b
        settled = (a, b, c) == old
        if k >= first:
            out[k - first] = gain, drift, spread
        k += 1
    return out


def kalman_trend(bars: DataFrame, q: float = 1e-5, r: float = 1e-2, least: int = 30, cut: Pieces | None = None) -> DataFrame:
    """symbol, dt, level, slope, band (two deviations), z (how surprising the bar was): a filter of level and slope on log closes.

    The gains do not depend on the closes, so level and slope behind a piece are linear in those before it, and pieces of a long series run at once.
    """

    def follow(piece: pd.DataFrame, level: list[float], slope: list[float]) -> tuple[np.ndarray, np.ndarray, list]:
        """The filter from several states at once: (bars, 3, states) of level, slope and surprise; gains; the last states."""
        seen, gains = np.log(piece["close"].to_numpy(float)), _gains(int(piece["k"].iloc[0]), len(piece), q, r)
        level, slope = np.array(level), np.array(slope)
        out = np.zeros((len(seen), 3, len(level)))
        for i, (y, (gain, drift, _)) in enumerate(zip(seen, gains, strict=True)):
            level = level + slope
            off = y - level
            level, slope = level + gain * off, slope + drift * off
            out[i] = level, slope, off
        return out, gains, [level.tolist(), slope.tolist()]

    first = lambda piece: float(np.log(piece["close"].iloc[0]))

    def summarise(piece: pd.DataFrame) -> list:
        """Where the piece leads from its first close at rest, from nothing, and from a level and a slope of one."""
        return follow(piece, [first(piece), 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0])[2]

    def advance(state: list | None, summary: list) -> list:
        if state is None:
            return [x[0] for x in summary]
        return [x[1] + (x[2] - x[1]) * state[0] + (x[3] - x[1]) * state[1] for x in summary]

    def run(piece: pd.DataFrame, state: list | None) -> pd.DataFrame:
        level, slope = state or (first(piece), 0.0)
        out, gains, _ = follow(piece, [level], [slope])
        # the variance that a bar leaves is the gain's share of the noise
        made = {"level": np.exp(out[:, 0, 0]), "slope": out[:, 1, 0], "band": 2 * np.sqrt(gains[:, 0] * r), "z": out[:, 2, 0] / np.sqrt(gains[:, 2])}
        return piece[["symbol", "dt", "k"]].assign(**made)

    kinds = dict(bars.dtypes)
    bars = bars.select("symbol", "dt", "close")
    cut = cut or pieces(bars)
    rows = numbered(cut.cut(bars), cut).drop(PIECE)
    done = scan(rows, cut, summarise, advance, run, f"symbol {kinds['symbol']}, dt {kinds['dt']}, k long, level double, slope double, band double, z double")
    enough = done.groupBy("symbol").agg(F.max("k").alias("k")).where(F.col("k") >= least - 1)
    return (done.join(enough.select("symbol"), "symbol", "left_semi") if least > 1 else done).drop("k")


def day_features(bars: DataFrame) -> DataFrame:
    s = Series()
    rows = with_recursive(bars, [("rsi", 14)]).withColumn("ret1", s.returns("close"))
    volz = F.try_divide(F.col("volume") - s.sma("volume", 20), s.stdev("volume", 20))
    rows = rows.withColumns({"ret5": s.momentum("close", 5), "vol10": s.stdev("ret1", 10), "rsi": (F.col("rsi_14") - 50) / 50, "volz": volz})
    return rows


SHAPE = ("ret1", "ret5", "vol10", "rsi", "volz")


def analogs(bars: DataFrame, window: int = 90, top: int = 5, ahead: int = 5) -> DataFrame:
    """symbol, dt, weight, fwd: the days of the last `window` that are most like the newest, and what followed them.

    Days are five standardised features; a day's weight is exp of its product with the newest over the root of their number, as a share
    of all days' (the newest itself is no analog). Days so near the end that what follows is not known yet have no fwd.
    """
    s = Series()
    rows = day_features(bars).withColumn("fwd", s.lead("close", ahead) / F.col("close") - 1).dropna(subset=list(SHAPE))
    newest = Window.partitionBy("symbol").orderBy(F.desc("dt"))
    rows = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= window)
    whole = Window.partitionBy("symbol")
    scaled = {f: (F.col(f) - F.avg(f).over(whole)) / F.when(F.stddev_pop(f).over(whole) < 1e-12, 1.0).otherwise(F.stddev_pop(f).over(whole)) for f in SHAPE}
    rows = rows.withColumns({f"x_{f}": c for f, c in scaled.items()})
    last = {f"l_{f}": F.max(F.when(F.col("back") == 1, F.col(f"x_{f}"))).over(whole) for f in SHAPE}
    rows = rows.withColumns(last).withColumn("score", sum(F.col(f"x_{f}") * F.col(f"l_{f}") for f in SHAPE) / math.sqrt(len(SHAPE)))
    rows = rows.withColumn("e", F.exp(F.col("score") - F.max("score").over(whole))).withColumn("weight", F.col("e") / F.sum("e").over(whole))
    best = Window.partitionBy("symbol").orderBy(F.desc("weight"), "dt")
    rows = rows.where("back > 1").withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top)
    return rows.select("symbol", "dt", "weight", F.when(F.col("back") > ahead, F.col("fwd")).alias("fwd"))


def fan(returns: DataFrame, key: list[str], horizon: int, n_paths: int, block: int = 5, seed: int = 7) -> DataFrame:
    """key, path, t, growth: paths of `horizon` days of blocks of a series' own returns (k, ret)."""
    spark = returns.sparkSession
    size = returns.groupBy(*key).agg(F.count("ret").alias("n")).where(F.col("n") >= 8 * block)
    paths = size.crossJoin(F.broadcast(spark.range(n_paths).withColumnRenamed("id", "path"))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(-(-horizon // block) - 1))))
    start = F.floor(uniform(F.lit(f"fan{seed}"), *key, "path", "b") * (F.col("n") - block + 1))
    steps = paths.withColumn("start", start).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("t", (F.col("b") * block + F.col("o") + 1).cast("long")).where(F.col("t") <= horizon)
    rows = steps.select(*key, "path", "t", (F.col("start") + F.col("o")).alias("k")).join(returns.select(*key, "k", "ret"), [*key, "k"])
    return rows.select(*key, "path", "t", F.product(1 + F.col("ret")).over(Series([*key, "path"], "t").so_far).alias("growth"))


def numbered_returns(bars: DataFrame) -> DataFrame:
    s = Series()
    r = bars.withColumn("ret", s.returns("close")).where("ret IS NOT NULL")
    return r.select("symbol", "ret", (F.row_number().over(s.w).cast("long") - 1).alias("k"))


def aligned(bars: DataFrame) -> DataFrame:
    """symbol, dt, ret on the days on which all symbols have one."""
    r = bars.withColumn("ret", Series().returns("close")).where("ret IS NOT NULL").select("symbol", "dt", "ret")
    n = r.agg(F.count_distinct("symbol").alias("symbols"))
    return r.join(r.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).where("n = symbols").select("dt"), "dt")


def value_at_risk(bars: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5, 8, 13, 21, 34), n_paths: int = 4000, block: int = 5, alpha: float = 0.05) -> DataFrame:
    """horizon, var, es (mean loss at or beyond it), p95 of an equal-weight basket, by resampled blocks of its returns."""
    basket = aligned(bars).groupBy("dt").agg(F.avg("ret").alias("ret")).withColumn("all", F.lit("all"))
    rows = basket.select("all", "ret", (F.row_number().over(Window.partitionBy("all").orderBy("dt")).cast("long") - 1).alias("k"))  # a row for each day
    pnl = fan(rows, ["all"], max(horizons), n_paths, block).where(F.col("t").isin(*horizons)).select(F.col("t").alias("horizon"), F.round(F.col("growth") - 1, 9).alias("pnl"))
    cut = pnl.groupBy("horizon").agg(F.percentile("pnl", alpha).alias("cut"), F.percentile("pnl", 0.95).alias("p95"))
    return pnl.join(cut, "horizon").groupBy("horizon").agg((-F.first("cut")).alias("var"), F.coalesce(-F.avg(F.when(F.col("pnl") <= F.col("cut"), F.col("pnl"))), -F.first("cut")).alias("es"), F.first("p95").alias("p95"))


def price_fan(bars: DataFrame, horizon: int = 60, n_paths: int = 2000, shown: int = 48) -> tuple[DataFrame, DataFrame]:
    """Quantiles of resampled growth by day, and evenly spaced paths through the sorted ends: symbol, t, p5, p25, p50, p75, p95; symbol, path, growth."""
    rows = fan(numbered_returns(bars), ["symbol"], horizon, n_paths).withColumn("growth", F.round("growth", 9))
    envelope = rows.groupBy("symbol", "t").agg(*(F.percentile("growth", p / 100).alias(f"p{p}") for p in (5, 25, 50, 75, 95)))
    ends = rows.where(F.col("t") == horizon).withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy("growth", "path")) - 1)
    places = [int(i * (n_paths - 1) / max(shown - 1, 1)) for i in range(shown)]
    return envelope, ends.where(F.col("rank").isin(*places)).select("symbol", "path", "growth")


def heston(starts: DataFrame, key: str, horizon: int = 120, n_paths: int = 2000, kappa: float = 2.0, xi: float = 0.6, rho: float = -0.7, mu: float = 0.0, seed: int = 7) -> DataFrame:
    """key, path, price, vol at the end of paths from each start (key, spot, iv) whose variance reverts to iv squared; a negative variance counts as 0.

    The normal numbers of all days are rows; a path is a fold over its own. Starts without a spot or an iv have no paths.
    """
    dt = 1 / YEAR
    drawn = lambda which: (uniform(F.lit(f"heston{seed}"), key, "path", F.col("day").cast("string"), F.lit(which)) * 2.0**48 + 0.5) / 2.0**48

    def step(x: Column, z: Column) -> Column:
        v = F.greatest(x["v"], F.lit(0.0))
        return F.struct((x["s"] * F.exp((mu - 0.5 * v) * dt + F.sqrt(v * dt) * z["a"])).alias("s"), (x["v"] + kappa * (F.col("theta") - v) * dt + xi * F.sqrt(v * dt) * (rho * z["a"] + math.sqrt(1 - rho * rho) * z["b"])).alias("v"))

    steps = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    wide = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = starts.where("spot IS NOT NULL AND iv IS NOT NULL").select(key, F.col("spot").cast("double").alias("spot"), (F.col("iv") * F.col("iv")).cast("double").alias("theta"))
    paths = known.withColumn("path", steps(0, n_paths - 1)).repartition(wide, key, "path")  # few bytes are much work: a number that is given is not lowered; a path's days stay together
    both = F.inline(F.array(F.struct(drawn("a").alias("ua"), drawn("b").alias("ub"))))  # a generator, so that what follows does not draw again at each use
    days = paths.withColumn("day", steps(1, horizon)).select("*", both).withColumns({"a": norm_ppf(F.col("ua")), "b": norm_ppf(F.col("ub"))})
    whole = days.groupBy(key, "path", "spot", "theta").agg(F.array_sort(F.collect_list(F.struct("day", "a", "b"))).alias("z"))
    end = F.aggregate("z", F.struct(F.col("spot").alias("s"), F.col("theta").alias("v")), step)
    return whole.select(key, "path", end.alias("e")).select(key, "path", F.col("e.s").alias("price"), F.sqrt(F.greatest("e.v", F.lit(0.0))).alias("vol"))


def portfolios(bars: DataFrame, n: int = 4000, free: float = 0.065, seed: int = 7) -> DataFrame:
    """portfolio, ret, vol, sharpe of random long-only weights: shares of exponential numbers, one for each symbol."""
    r = aligned(bars)
    mean = r.groupBy("symbol").agg((F.avg("ret") * YEAR).alias("mu"))
    half = gram(r.select("symbol", "dt", F.col("ret").alias("r"))).select("a", "b", (F.col("cov") * YEAR).alias("cov"))
    cov = half.union(half.where("a < b").select("b", "a", "cov"))
    w = mean.crossJoin(F.broadcast(bars.sparkSession.range(n).withColumnRenamed("id", "portfolio"))).withColumn("e", -F.ln(1 - uniform(F.lit(f"mix{seed}"), "portfolio", "symbol")))
    w = w.withColumn("w", F.col("e") / F.sum("e").over(Window.partitionBy("portfolio"))).select("portfolio", "symbol", "mu", "w")
    gain = w.groupBy("portfolio").agg(F.sum(F.col("w") * F.col("mu")).alias("ret"))
    of = lambda x: w.select("portfolio", F.col("symbol").alias(x), F.col("w").alias(f"w{x}"))
    risk = of("a").join(cov, "a").join(of("b"), ["portfolio", "b"]).groupBy("portfolio").agg(F.sqrt(F.sum(F.col("wa") * F.col("wb") * F.col("cov"))).alias("vol"))
    return gain.join(risk, "portfolio").withColumn("sharpe", (F.col("ret") - free) / F.greatest("vol", F.lit(1e-9)))


PENALTY = -10.0  # of a pair that is none: fast is not below slow


def swarm(bars: DataFrame, bounds: tuple[tuple[float, float], tuple[float, float]], particles: int = 24, rounds: int = 30, resolution: int = 25, seed: int = 7) -> tuple[dict[tuple[int, int], float], list[tuple[int, int, float]]]:
    """Mean Sharpe ratio over symbols of every pair (fast, slow) that was run or refused, and the swarm's best after each round.

    The landscape, `resolution` even steps of either bound, is run first, as one job. Then all particles of a round are one job; pairs
    that are known are not run again, so the pairs that are returned are all trials there were.
    """
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds, float).T
    known: dict[tuple[int, int], float] = {}

    def look_up(pairs: list[tuple[int, int]]) -> None:
        new = sorted({p for p in pairs if p not in known})
        known.update((p, PENALTY) for p in new)
        run = [p for p in new if p[0] < p[1]]
        if run:
            for r in bt.grid(bars, run).groupBy("fast", "slow").agg(F.avg("sharpe").alias("s")).collect():  # one row for each pair
                if r["s"] is not None and math.isfinite(r["s"]):
                    known[r["fast"], r["slow"]] = r["s"]

    steps = [np.unique(np.rint(np.linspace(a, b, resolution)).astype(int)).tolist() for a, b in bounds]
    look_up([(x, y) for x in steps[0] for y in steps[1]])
    at = low + rng.random((particles, 2)) * (high - low)
    speed = (rng.random((particles, 2)) - 0.5) * (high - low) * 0.2
    best, best_fit, path = at.copy(), np.full(particles, -np.inf), []
    for _ in range(rounds):
        pairs = [tuple(p) for p in np.rint(at).astype(int).tolist()]
        look_up(pairs)
        fit = np.array([known[p] for p in pairs])
        better = fit > best_fit
        best[better], best_fit[better] = at[better], fit[better]
        top = best[best_fit.argmax()]
        path.append((*np.rint(top).astype(int).tolist(), float(best_fit.max())))
        pull = rng.random((2, particles, 2))
        speed = np.clip(0.72 * speed + 1.49 * pull[0] * (best - at) + 1.49 * pull[1] * (top - at), -(high - low) / 4, (high - low) / 4)
        at = at + speed
        out = (at < low) | (at > high)
        at, speed = np.clip(np.where(at < low, 2 * low - at, np.where(at > high, 2 * high - at, at)), low, high), np.where(out, -speed, speed)
    return known, path



def learning_rows(features: DataFrame, names: list[str], horizon: int = 5, test: float = 0.25) -> DataFrame:
    """symbol, dt, i, the features, y (return over the horizon) and train: whole rows in order, the first part of each symbol's to learn from."""
    s = Series()
    rows = features.withColumn("y", s.lead("close", horizon) / F.col("close") - 1).dropna(subset=[*names, "y"])
    rows = rows.withColumn("i", F.row_number().over(s.w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return rows.select("symbol", "dt", "i", *names, "y", (F.col("i") < F.floor(F.col("n") * (1 - test))).alias("train"))


def standardised(rows: DataFrame, names: list[str]) -> DataFrame:
    """Features less the mean of the training part, over its population deviation (1 where there is none)."""
    whole = Window.partitionBy("symbol")
    known = lambda f: F.when(F.col("train"), F.col(f))
    sd = lambda f: F.stddev_pop(known(f)).over(whole)
    return rows.withColumns({f: (F.col(f) - F.avg(known(f)).over(whole)) / F.when(sd(f) < 1e-12, 1.0).otherwise(sd(f)) for f in names})


def ridge(rows: DataFrame, names: list[str], penalty: float = 1.0) -> DataFrame:
    """symbol, weights (by feature): least squares with a penalty and no constant, of the training rows.

    Sums of products are grouped aggregates; each symbol's small system of equations is then solved.
    """
    train = rows.where("train")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)] + [F.sum(F.col(a) * F.col("y")).alias(f"b_{i}") for i, a in enumerate(names)]
    n = len(names)

    def solve(batches):
        for g in batches:
            if len(g):
                whole = g[[f"g_{i}_{j}" for i in range(n) for j in range(n)]].to_numpy(float).reshape(-1, n, n) + penalty * np.eye(n)
                found = np.linalg.solve(whole, g[[f"b_{i}" for i in range(n)]].to_numpy(float)[..., None])[..., 0]
                yield pd.DataFrame({"symbol": g["symbol"], "weights": list(found)})

    return train.groupBy("symbol").agg(*sums).mapInPandas(solve, f"symbol {dict(rows.dtypes)['symbol']}, weights array<double>")


def stumps(rows: DataFrame, names: list[str], rounds: int = 60, rate: float = 0.15, cuts: int = 16, least: int = 8) -> DataFrame:
    """symbol, dt, i, train, y, pred: boosted trees of one split on the sign of y, learned from the training rows of each symbol.

    A symbol's rows are one task's work; a round looks at all cuts of all features at once.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        x, train = g[names].to_numpy(float), g["train"].to_numpy(bool)
        sign = np.where(g["y"].to_numpy(float) >= 0, 1.0, -1.0)
        pred = np.zeros(len(g))
        if train.sum() >= 2 * least:
            at = np.quantile(x[train], np.linspace(0.08, 0.92, cuts), axis=0).T.ravel()
            left = (x[:, np.repeat(np.arange(len(names)), cuts)] <= at).astype(float)
            n_left = left[train].sum(axis=0)
            n_right = train.sum() - n_left
            fits = (n_left >= least) & (n_right >= least)
            for _ in range(rounds if fits.any() else 0):
                pull = sign[train] / (1 + np.exp(sign[train] * pred[train]))
                sum_left = pull @ left[train]
                sum_right = pull.sum() - sum_left
                gain = np.where(fits, sum_left**2 / np.maximum(n_left, 1) + sum_right**2 / np.maximum(n_right, 1), -1)
                c = int(gain.argmax())
                pred += rate * np.where(left[:, c] > 0, sum_left[c] / n_left[c], sum_right[c] / n_right[c])
        return g[["symbol", "dt", "i", "train", "y"]].assign(pred=pred)

    kinds = dict(rows.dtypes)
    return rows.groupBy("symbol").applyInPandas(run, f"symbol {kinds['symbol']}, dt {kinds['dt']}, i {kinds['i']}, train boolean, y double, pred double")


def scored(predictions: DataFrame, horizon: int = 5, least: int = 200) -> DataFrame:
    """symbol, n_train, n_test, acc_train, acc_test, baseline_test (of the commoner direction), equity_model, equity_hold: of symbols with `least` rows.

    Equities take every `horizon`-th call of the test part, so holdings do not overlap.
    """
    good = (F.signum("pred") == F.signum("y")).cast("double")
    first = F.min(F.when(~F.col("train"), F.col("i"))).over(Window.partitionBy("symbol"))
    last = F.max("i").over(Window.partitionBy("symbol"))
    rows = predictions.withColumn("taken", ~F.col("train") & ((F.col("i") - first) % horizon == 0) & (F.col("i") < last))
    up = F.avg(F.when(~F.col("train"), (F.col("y") > 0).cast("double")))
    out = rows.groupBy("symbol").agg(
        F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"), F.avg(F.when(F.col("train") & (F.col("y") != 0), good)).alias("acc_train"), F.avg(F.when(~F.col("train") & (F.col("y") != 0), good)).alias("acc_test"),
        F.greatest(up, 1 - up).alias("baseline_test"), F.product(F.when(F.col("taken"), 1 + F.signum("pred") * F.col("y"))).alias("equity_model"), F.product(F.when(F.col("taken"), 1 + F.col("y"))).alias("equity_hold"),
    )
    return out.where(F.col("n_train") + F.col("n_test") >= least)
