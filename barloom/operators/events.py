"""Event studies: standardised shocks and what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from .candles import following

HORIZONS = (1, 2, 3, 5, 10, 21)


def standardised(bars: DataFrame, lookback: int = 63) -> DataFrame:
    """Adds r (log return), k (bar number) and z: r over the deviation of the `lookback` returns before it."""
    s = Series()
    r = bars.withColumn("r", s.log_returns("close")).withColumn("k", F.row_number().over(s.w).cast("long") - 1)
    before = s.w.rowsBetween(-lookback, -1)
    sd = F.when(F.count("r").over(before) == lookback, F.stddev_samp("r").over(before))
    return r.withColumn("z", F.try_divide(F.col("r"), sd))


def shocks(bars: DataFrame, sigma: float = 2.0, direction: str = "down", lookback: int = 63) -> DataFrame:
    z = standardised(bars, lookback)
    hit = {"down": F.col("z") <= -sigma, "up": F.col("z") >= sigma, "both": F.abs("z") >= sigma}[direction]
    return z.where(hit)


def spaced(events: DataFrame, gap: int) -> DataFrame:
    """Of each symbol's events (column k) those that come more than `gap` bars after the last one kept, from the first on."""
    kept = F.aggregate(F.array_sort(F.collect_list("k")), F.array().cast("array<bigint>"), lambda a, k: F.when((F.size(a) == 0) | (k - F.element_at(a, -1) > gap), F.concat(a, F.array(k))).otherwise(a))
    return events.groupBy("symbol").agg(kept.alias("ks")).select("symbol", F.explode("ks").alias("k")).join(events, ["symbol", "k"])


def ahead(z: DataFrame, hit: Column, horizons: tuple[int, ...], value: Column | None = None) -> DataFrame:
    """Rows symbol, k, horizon, fwd, hit of all bars. Events that come within the longest horizon of the last one kept are no events."""
    gap = max(horizons)
    kept = spaced(z.where(hit).select("symbol", "k"), gap).withColumn("hit", F.lit(True))
    marked = z.join(kept, ["symbol", "k"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if value is None:
        return following(marked, horizons).where("fwd IS NOT NULL")
    s = Series()
    total = marked.withColumn("total", F.sum(value).over(s.so_far))
    total = total.withColumns({f"fwd_{h}": s.lead("total", h) - F.col("total") for h in horizons})
    each = F.explode(F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons)))
    return total.select("symbol", "k", "hit", each.alias("x")).select("symbol", "k", "hit", "x.*").where("fwd IS NOT NULL")


def figures(rows: DataFrame, lookback: int) -> DataFrame:
    """symbol, horizon, n, mean_pct, median_pct, hit_rate, t, and base_n, base_mean_pct of all bars from lookback + 1 on."""
    own = F.when(F.col("hit"), F.col("fwd"))
    sd = F.stddev_samp(own)
    return rows.groupBy("symbol", "horizon").agg(
        F.count(own).alias("n"), (100 * F.avg(own)).alias("mean_pct"), (100 * F.percentile(own, 0.5)).alias("median_pct"), F.avg((own > 0).cast("double")).alias("hit_rate"),
        F.when((F.count(own) > 2) & (sd > 1e-12), F.avg(own) / (sd / F.sqrt(F.count(own)))).alias("t"),
        F.count_if(F.col("k") > lookback).alias("base_n"), (100 * F.avg(F.when(F.col("k") > lookback, F.col("fwd")))).alias("base_mean_pct"),
    )


def beyond(sigma: float, direction: str) -> Column:
    return {"down": F.col("z") <= -sigma, "up": F.col("z") >= sigma, "both": F.abs("z") >= sigma}[direction]


def study(bars: DataFrame, sigma: float = 2.0, direction: str = "down", lookback: int = 63, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """What follows shocks, against what follows any bar: see figures."""
    return figures(ahead(standardised(bars, lookback), beyond(sigma, direction), horizons), lookback)


def excess_study(bars: DataFrame, benchmark: DataFrame, sigma: float = 2.0, direction: str = "down", lookback: int = 63, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """As study, of returns less those of a benchmark (dt, close) on the days that both have."""
    s = Series()
    base = benchmark.withColumn("one", F.lit(1))
    base = base.select("dt", Series("one").log_returns("close").alias("market"))
    z = standardised(bars, lookback).join(base, "dt").where("r IS NOT NULL AND market IS NOT NULL").withColumn("k", F.row_number().over(s.w).cast("long") - 1)
    return figures(ahead(z, beyond(sigma, direction), horizons, F.col("r") - F.col("market")), lookback)
