"""Is a backtest more than luck: permutations, deflation, walk-forward windows and resampled paths, for many runs at once.

Random orders come from md5 of seed, run and number, so reruns agree and SQL can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.options import norm_cdf
from ..functions.series import YEAR, Series
from . import backtest as bt

EULER = 0.5772156649015329
#: Fixed coefficients of Acklam's rational approximation of the inverse normal distribution.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_LOW = 0.02425


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse of the normal distribution; NULL outside of (0, 1)."""
    tail = lambda q: horner(q, PPF_C) / horner(q, PPF_D)
    d = p - 0.5
    low, high = tail(F.sqrt(-2 * F.ln(p))), -tail(F.sqrt(-2 * F.ln(1 - p)))
    return F.when((p <= 0) | (p >= 1), None).when(p < PPF_LOW, low).when(p > 1 - PPF_LOW, high).otherwise(d * horner(d * d, PPF_A) / horner(d * d, PPF_B))


def plain_sharpe(mean: Column, sd: Column, periods: int = YEAR) -> Column:
    """The validators' own: 0 where there is no spread."""
    return F.when(F.coalesce(sd <= 1e-12, F.lit(True)), 0.0).otherwise(mean / sd * math.sqrt(periods))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from md5 of the parts."""
    named = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") / 2.0**48


def permutations(done: DataFrame, key: list[str], n: int = 1000, block: int = 20, seed: int = 7) -> DataFrame:
    """key, perm, null_sharpe: the positions of each run (k, pos, change) in shuffled blocks, the last one filled up with flat bars.

    Blocks are shuffled, not bars; bars meet returns by their new number, and each permutation needs two sums only.
    """
    spark = done.sparkSession
    rows = done.select(*key, "k", "pos", "change")
    size = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    blocks = size.select(*key, "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("block")).crossJoin(F.broadcast(spark.range(n).withColumnRenamed("id", "perm")))
    order = Window.partitionBy(*key, "perm").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *key, F.col("perm").cast("string"), F.col("block").cast("string"))))
    placed = blocks.withColumn("place", F.row_number().over(order) - 1)
    held = rows.where("pos != 0").select(*key, F.floor(F.col("k") / block).cast("int").alias("block"), (F.col("k") % block).alias("at"), "pos")
    moved = held.join(placed, [*key, "block"]).select(*key, "perm", "n", (F.col("place") * block + F.col("at")).cast("long").alias("k"), F.col("pos").alias("moved"))
    x = F.col("moved") * F.col("change")
    sums = moved.join(rows.select(*key, "k", "change"), [*key, "k"]).groupBy(*key, "perm").agg(F.max("n").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    sums = placed.select(*key, "perm", "n").distinct().join(sums.drop("n"), [*key, "perm"], "left").na.fill(0.0, ["s", "q"])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)) / (F.col("n") - 1))
    return sums.select(*key, "perm", F.round(plain_sharpe(mean, sd), 9).alias("null_sharpe"))


def permutation_test(done: DataFrame, key: list[str], n: int = 1000, block: int = 20, seed: int = 7) -> DataFrame:
    """key, observed_sharpe, p_value, percentile: how many shuffled placements do at least as well. Runs of less than four blocks are left out."""
    x = F.col("pos") * F.col("change")
    observed = done.groupBy(*key).agg(F.round(plain_sharpe(F.avg(x), F.stddev_samp(x)), 9).alias("observed_sharpe"), F.count(F.lit(1)).alias("bars")).where(F.col("bars") >= 4 * block)
    nulls = permutations(done.join(observed.select(*key), key, "left_semi"), key, n, block, seed).join(observed, key)
    return nulls.groupBy(*key).agg(
        F.max("observed_sharpe").alias("observed_sharpe"),
        ((F.count_if(F.col("null_sharpe") >= F.col("observed_sharpe")) + 1) / (n + 1)).alias("p_value"),
        (100 * F.avg((F.col("null_sharpe") < F.col("observed_sharpe")).cast("double"))).alias("percentile"),
    )


def permutation_verdict(p: Column) -> Column:
    """Fixed labels."""
    return F.when(p < 0.01, "better than chance").when(p < 0.05, "better than chance, not decisively").when(p < 0.20, "cannot be told from luck").otherwise("no evidence of timing skill")


def deflated_sharpe(done: DataFrame, key: list[str], n_trials: int | Column = 1, trial_sd: float | Column | None = None, periods: int = YEAR) -> DataFrame:
    """key, observed_sharpe, expected_max_sharpe, skew, kurtosis, deflated of the returns (ret) of each run; at least 20 are needed.

    Moments are means over all returns, over powers of the sample deviation. deflated is NULL where it is not defined.
    """
    stat = done.groupBy(*key).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.count("ret").alias("n")).where("n >= 20")
    off = F.col("ret") - F.col("mean")
    powers = done.join(stat, key).groupBy(*key, "mean", "sd", "n").agg(F.avg(F.pow(off, 3)).alias("m3"), F.avg(F.pow(off, 4)).alias("m4"))
    spread = F.col("sd") > 1e-12
    trials = F.greatest(F.lit(n_trials) if isinstance(n_trials, int) else n_trials, F.lit(1)).cast("double")
    v = F.lit(1.0) if trial_sd is None else F.lit(trial_sd) if isinstance(trial_sd, float) else trial_sd
    v = F.when(v > 0, v).otherwise(1.0)
    most = F.when(trials == 1, 0.0).otherwise(v * ((1 - EULER) * norm_ppf(1 - 1 / trials) + EULER * norm_ppf(1 - 1 / (trials * math.e))))
    out = powers.select(
        *key, "n", trials.cast("long").alias("n_trials"), plain_sharpe(F.col("mean"), F.col("sd"), periods).alias("observed_sharpe"), most.alias("expected_max_sharpe"),
        F.when(spread, F.col("m3") / F.pow("sd", F.lit(3))).otherwise(0.0).alias("skew"), F.when(spread, F.col("m4") / F.pow("sd", F.lit(4))).otherwise(3.0).alias("kurtosis"),
    )
    own, free = F.col("observed_sharpe") / math.sqrt(periods), F.col("expected_max_sharpe") / math.sqrt(periods)
    below = 1 - F.col("skew") * own + (F.col("kurtosis") - 1) / 4 * own * own
    return out.withColumn("deflated", F.when(below > 0, norm_cdf((own - free) * F.sqrt(F.col("n") - 1.0) / F.sqrt(below))))


def deflated_verdict(observed: Column, most: Column, deflated: Column) -> Column:
    """Fixed labels."""
    return F.when(observed <= most, "selection, not a strategy").when(deflated > 0.95, "survives deflation").when(deflated > 0.80, "marginal after deflation").otherwise("does not survive deflation")


def validate(done: DataFrame, key: list[str], n_trials: int = 1, trial_sd: float | None = None, n: int = 1000) -> DataFrame:
    """Both tests of each run, whether it passes both (p below 0.05 and deflated above 0.95), and what fails."""
    both = permutation_test(done, key, n).withColumnRenamed("observed_sharpe", "timing_sharpe").join(deflated_sharpe(done, key, n_trials, trial_sd), key)
    timing, size = F.col("p_value") < 0.05, F.coalesce(F.col("deflated") > 0.95, F.lit(False))
    fails = F.concat_ws("; and ", F.when(~timing, "timing is not distinguishable from random placement"), F.when(~size, F.concat(F.lit("Sharpe does not survive "), F.col("n_trials").cast("string"), F.lit(" trials"))))
    return both.withColumn("passes", timing & size).withColumn("verdict", F.when(timing & size, "passes both").otherwise(F.concat(F.lit("rejected: "), fails)))


def windows_of(bars: DataFrame, n_windows: int, train_frac: float) -> DataFrame:
    """Bars of each window, numbered from the beginning of its training part: symbol, w, dt, close, j, test."""
    s = Series()
    whole = Window.partitionBy("symbol")
    rows = bars.withColumn("i", F.row_number().over(s.w) - 1).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("length", F.floor(F.col("n") / (n_windows + 1)))
    rows = rows.where("length >= 40").withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    begin = F.col("n") - (n_windows - F.col("w")) * F.col("length")
    train = F.greatest(begin - F.floor(F.col("length") * train_frac / (1 - train_frac) + 1e-9), F.lit(0))
    rows = rows.withColumn("begin", begin).withColumn("first", train).where("i >= first AND i < begin + length AND begin - first >= 40")
    return rows.select("symbol", "w", "dt", "close", (F.col("i") - F.col("first")).alias("j"), (F.col("i") >= F.col("begin")).alias("test"))


def walk_forward(bars: DataFrame, pairs: list[tuple[int, int]], n_windows: int = 4, train_frac: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Moving-average crosses chosen on the training part of each window and run on its test part, warmed by the training part.

    First: symbol, w, fast, slow, is_sharpe, oos_sharpe, oos_return. Second: the test parts' returns on end, symbol, w, dt, ret.
    """
    chosen = [(f, s) for f, s in pairs if f < s]
    seg = Series(["symbol", "w"])
    rows = windows_of(bars, n_windows, train_frac)
    lengths = sorted({x for pair in chosen for x in pair})
    means = F.create_map(*(x for n in lengths for x in (F.lit(n), seg.sma("close", n))))
    rows = rows.withColumn("means", means)
    runs = rows.withColumn("p", F.explode(F.array(*(F.struct(F.lit(f).cast("long").alias("fast"), F.lit(s).cast("long").alias("slow")) for f, s in chosen))))
    gap = F.round(F.try_element_at("means", F.col("p.fast").cast("int")) - F.try_element_at("means", F.col("p.slow").cast("int")), 9)
    key = ["symbol", "w", "fast", "slow"]
    runs = runs.select("symbol", "w", "p.fast", "p.slow", "dt", "close", "test", F.when(gap.isNull(), 0.0).when(gap > 0, 1.0).otherwise(-1.0).alias("signal"))
    done = bt.run(runs, [*key, "test"])  # each part is a run of its own, flat on its first bar
    scored = done.groupBy(*key, "test").agg(F.round(bt.sharpe("ret"), 9).alias("sharpe"), (F.max_by("equity", "k") / bt.CASH - 1).alias("total"))
    best = Window.partitionBy("symbol", "w").orderBy(F.desc("sharpe"), "fast", "slow")
    picked = scored.where("NOT test").withColumn("rn", F.row_number().over(best)).where("rn = 1").select(*key, F.col("sharpe").alias("is_sharpe"))
    windows = picked.join(scored.where("test").select(*key, F.col("sharpe").alias("oos_sharpe"), F.col("total").alias("oos_return")), key)
    return windows, done.where("test").join(picked, key).select("symbol", "w", "dt", "ret")


def walk_forward_summary(windows: DataFrame, stitched: DataFrame) -> DataFrame:
    """symbol, n_windows, is_sharpe_mean, oos_sharpe, oos_return, oos_max_dd, efficiency, param_stability, verdict."""
    s = Series()
    curve = stitched.withColumn("equity", bt.CASH * F.product(1 + F.col("ret")).over(s.so_far))
    curve = curve.withColumn("dd", s.drawdown("equity"))
    out = curve.groupBy("symbol").agg(bt.sharpe("ret").alias("oos_sharpe"), (F.max_by("equity", "dt") / bt.CASH - 1).alias("oos_return"), F.min("dd").alias("oos_max_dd"))
    each = windows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("is_sharpe").alias("is_sharpe_mean"), F.count_distinct("fast", "slow").alias("kinds"))
    mean = F.col("is_sharpe_mean")
    both = each.join(out, "symbol").withColumn("efficiency", F.when(F.abs(mean) > 1e-9, F.greatest("oos_sharpe", F.lit(0.0)) / F.greatest(mean, F.lit(1e-9))).otherwise(0.0))
    both = both.withColumn("param_stability", 1 - (F.col("kinds") - 1) / F.greatest("n_windows", F.lit(1)))
    robust, fragile = (F.col("efficiency") >= 0.7) & (F.col("oos_sharpe") > 0.5), (F.col("efficiency") >= 0.4) & (F.col("oos_sharpe") > 0)
    return both.drop("kinds").withColumn("verdict", F.when(robust, "robust").when(fragile, "fragile").otherwise("overfit"))


def resampled(returns: DataFrame, key: list[str], n_paths: int = 2000, block: int = 10, seed: int = 7) -> DataFrame:
    """key, path, t, equity, dd: paths of blocks of a run's own returns (k, ret), each from a random place on."""
    spark = returns.sparkSession
    size = returns.groupBy(*key).agg(F.count("ret").alias("n")).where(F.col("n") >= 4 * block)
    paths = size.crossJoin(F.broadcast(spark.range(n_paths).withColumnRenamed("id", "path")))
    paths = paths.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
    start = F.floor(uniform(F.lit(str(seed)), *key, "path", "b") * (F.col("n") - block + 1))
    steps = paths.withColumn("start", start).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("t", (F.col("b") * block + F.col("o")).cast("long")).where("t < n")
    rows = steps.select(*key, "path", "t", (F.col("start") + F.col("o")).alias("k")).join(returns.select(*key, "k", "ret"), [*key, "k"])
    s = Series([*key, "path"], "t")
    rows = rows.withColumn("equity", F.product(1 + F.col("ret")).over(s.so_far))
    return rows.select(*key, "path", "t", "equity", s.drawdown("equity").alias("dd"))


def monte_carlo(returns: DataFrame, key: list[str], n_paths: int = 2000, block: int = 10, seed: int = 7) -> DataFrame:
    """Quantiles of the end of resampled paths and of their worst drawdowns, the share that loses, and a verdict on the paths."""
    ends = resampled(returns, key, n_paths, block, seed).groupBy(*key, "path").agg(F.round(F.max_by("equity", "t"), 9).alias("terminal"), F.min("dd").alias("worst"))
    out = ends.groupBy(*key).agg(
        *(F.percentile("terminal", q / 100).alias(f"terminal_p{q}") for q in (5, 50, 95)),
        F.avg((F.col("terminal") < 1).cast("double")).alias("prob_loss"), F.percentile("worst", 0.5).alias("max_dd_median"), F.percentile("worst", 0.05).alias("max_dd_p95"),
    )
    good, even = (F.col("prob_loss") < 0.2) & (F.col("max_dd_p95") > -0.35), F.col("prob_loss") < 0.45
    return out.withColumn("verdict", F.when(good, "paths are mostly favourable").when(even, "close to a coin flip").otherwise("most paths lose money"))
