"""Vectorised backtests: a signal column becomes positions, returns, equity, trades and metrics, for many runs at once.

A run is a symbol, or a symbol and a set of parameters; every window and group is by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import YEAR, Series

COST = 0.0005 + 0.0005  # commission and slippage of one side
CASH = 10_000.0


def run(bars: DataFrame, key: list[str], cost: float = COST, cash: float = CASH, allow_short: bool = True) -> DataFrame:
    """Adds k (bar number), pos, ret and equity to bars with a column signal: the signal of one bar is the position of the next."""
    s = Series(key)
    held = F.greatest(F.least(F.coalesce("signal", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0 if allow_short else 0.0))
    bars = bars.withColumn("target", held).withColumn("k", F.row_number().over(s.w).cast("long") - 1)
    bars = bars.withColumn("pos", F.coalesce(s.lag("target"), F.lit(0.0))).withColumn("change", F.coalesce(s.returns("close"), F.lit(0.0)))
    turnover = F.abs(F.col("pos") - F.coalesce(s.lag("pos"), F.lit(0.0)))
    bars = bars.withColumn("ret", F.col("pos") * F.col("change") - turnover * cost)
    return bars.withColumn("equity", cash * F.product(1 + F.col("ret")).over(s.so_far)).drop("target", "change")


def trades(done: DataFrame, key: list[str], cost: float = COST) -> DataFrame:
    """Round trips: runs of one position. A trade ends on the bar that changes it; the last one on the last bar."""
    s = Series(key)
    turned = (F.col("pos") != F.coalesce(s.lag("pos"), F.lit(0.0))).cast("long")
    islands = done.withColumn("turned", turned).withColumn("island", F.sum("turned").over(s.so_far))
    first = islands.where("turned = 1").select(*key, "island", F.col("dt").alias("entry_dt"), F.col("k").alias("entry_k"), F.col("close").alias("entry_price"), F.signum("pos").cast("long").alias("direction"))
    last = done.groupBy(*key).agg(F.max_by(F.struct("dt", "k", "close"), "k").alias("end"))
    nxt = Series(key, "island")
    closed = first.withColumn("after", F.lead(F.struct(F.col("entry_dt").alias("dt"), F.col("entry_k").alias("k"), F.col("entry_price").alias("close"))).over(nxt.w))
    closed = closed.where("direction != 0").join(last, key).withColumn("exit", F.coalesce("after", "end"))
    gross = F.col("direction") * (F.col("exit.close") / F.col("entry_price") - 1)
    return closed.select(*key, "entry_dt", F.col("exit.dt").alias("exit_dt"), "direction", "entry_price", F.col("exit.close").alias("exit_price"), (gross - 2 * cost).alias("return_pct"), (F.col("exit.k") - F.col("entry_k")).alias("bars_held"))


def sharpe(r: Column | str, free: float = 0.0) -> Column:
    x = (F.col(r) if isinstance(r, str) else r) - free / YEAR
    flat = F.stddev_samp(x) <= F.greatest(F.abs(F.avg(x)), F.lit(1.0)) * 1e-12
    return F.when((F.count(x) < 2) | flat, 0.0).otherwise(F.try_divide(F.avg(x), F.stddev_samp(x)) * YEAR**0.5)


def sortino(r: str) -> Column:
    """Mean over the root mean square of the negative returns alone; NULL stands for no negative return and a gain."""
    down = F.sqrt(F.avg(F.when(F.col(r) < 0, F.col(r) * F.col(r))))
    return F.when(F.count(r) < 2, 0.0).when(down.isNull(), F.when(F.avg(r) > 0, F.lit(None)).otherwise(0.0)).when(down <= F.greatest(F.abs(F.avg(r)), F.lit(1.0)) * 1e-12, 0.0).otherwise(F.avg(r) / down * YEAR**0.5)


def cagr(equity: str, order: str) -> Column:
    total = F.try_divide(F.max_by(equity, order), F.min_by(equity, order))
    rows = F.count(equity)
    return F.when((rows < 2) | (F.min_by(equity, order) <= 0), 0.0).when(total <= 0, -1.0).otherwise(F.pow(total, F.lit(float(YEAR)) / (rows - 1)) - 1)


def metrics(done: DataFrame, key: list[str], cost: float = COST, cash: float = CASH) -> DataFrame:
    """One row for each run: return, CAGR, Sharpe, Sortino, Calmar, volatility, drawdown, exposure, and the trades' figures."""
    s = Series(key)
    marked = done.withColumn("dd", s.drawdown("equity"))
    wide = marked.groupBy(*key).agg(
        (F.max_by("equity", "k") / cash - 1).alias("total_return"),
        cagr("equity", "k").alias("cagr"),
        sharpe("ret").alias("sharpe"),
        sortino("ret").alias("sortino"),
        (F.stddev_samp("ret") * YEAR**0.5).alias("volatility"),
        F.min("dd").alias("max_drawdown"),
        F.avg((F.col("pos") != 0).cast("double")).alias("exposure"),
    )
    wide = wide.withColumn("calmar", F.when(F.col("max_drawdown") == 0, 0.0).otherwise(F.col("cagr") / F.abs("max_drawdown")))
    gains, losses = F.sum(F.when(F.col("return_pct") > 0, F.col("return_pct")).otherwise(0.0)), -F.sum(F.when(F.col("return_pct") < 0, F.col("return_pct")).otherwise(0.0))
    each = trades(done, key, cost).groupBy(*key).agg(F.count(F.lit(1)).alias("num_trades"), F.avg((F.col("return_pct") > 0).cast("double")).alias("win_rate"), F.try_divide(gains, losses).alias("profit_factor"))
    return wide.join(each, key, "left").withColumn("num_trades", F.coalesce("num_trades", F.lit(0).cast("long"))).withColumn("win_rate", F.coalesce("win_rate", F.lit(0.0)))


def sma_cross(bars: DataFrame, key: list[str], fast: int = 20, slow: int = 50) -> DataFrame:
    s = Series(key)
    a, b = s.sma("close", fast), s.sma("close", slow)
    return bars.withColumn("signal", F.when(a.isNull() | b.isNull(), 0.0).when(a > b, 1.0).otherwise(-1.0))


def grid(bars: DataFrame, pairs: list[tuple[int, int]], metric: str = "sharpe") -> DataFrame:
    """Moving-average crosses for every pair fast < slow as one job: parameters are columns, and windows go by (parameters, symbol).

    All averages come from prefix sums, so a window's length may be a column.
    """
    spark = bars.sparkSession
    chosen = [(f, s) for f, s in pairs if f < s]
    if len(chosen) > 2000:
        raise ValueError("more than 2000 combinations")
    params = spark.createDataFrame(chosen, "fast long, slow long")
    s = Series()
    summed = bars.withColumn("k", F.row_number().over(s.w).cast("long")).withColumn("total", F.sum("close").over(s.so_far))
    runs = summed.crossJoin(F.broadcast(params))  # 2000 rows at most
    one = Series(["fast", "slow", "symbol"])
    sums = summed.select(F.col("symbol").alias("s"), F.col("k").alias("at"), F.col("total").alias("before"))
    for name in ("fast", "slow"):
        runs = runs.join(sums.select("s", F.col("at").alias(f"at_{name}"), F.col("before").alias(f"before_{name}")), (F.col("symbol") == F.col("s")) & (F.col("k") - F.col(name) == F.col(f"at_{name}")), "left").drop("s", f"at_{name}")
        runs = runs.withColumn(name + "_ma", F.when(F.col("k") >= F.col(name), (F.col("total") - F.coalesce(f"before_{name}", F.lit(0.0))) / F.col(name)))
    runs = runs.withColumn("signal", F.when(F.col("slow_ma").isNull() | F.col("fast_ma").isNull(), 0.0).when(F.round(F.col("fast_ma") - F.col("slow_ma"), 9) > 0, 1.0).otherwise(-1.0))
    done = run(runs.select("fast", "slow", "symbol", "dt", "close", "signal"), one.key)
    return metrics(done, one.key).orderBy(F.desc(metric), "fast", "slow", "symbol")
