"""Screener: last-bar metrics of every symbol, and rules over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import YEAR, Series
from ..plans.rules import Rule
from .recursive import with_recursive


def metrics(bars: DataFrame) -> DataFrame:
    """One row a symbol: price, returns over 1, 5, 21 and 63 bars, RSI, volatility, distance from the half-year high, volume surge, averages."""
    s = Series()
    d = with_recursive(bars, [("rsi", 14)]).withColumn("r", s.returns("close")).withColumn("n", F.row_number().over(s.w))
    volume = F.when(F.count("volume").over(s.last(63)) >= 10, F.avg("volume").over(s.last(63)))
    back = lambda k: F.when(F.col("n") > k + 1, F.try_divide(F.col("close"), s.lag("close", k)) - 1)
    d = d.withColumns(
        {
            "ret_1d": back(1), "ret_1w": back(5), "ret_1mo": back(21), "ret_3mo": back(63),
            "vol_ann": F.when(F.count("r").over(s.so_far) > 2, F.stddev_samp("r").over(s.so_far) * YEAR**0.5),
            "from_high": F.try_divide(F.col("close"), F.max("close").over(s.last(126))) - 1,
            "vol_surge": F.try_divide(F.col("volume"), F.when(volume > 0, volume)),
            "above_sma50": (F.col("close") > s.sma("close", 50)), "above_sma200": (F.col("close") > s.sma("close", 200)),
        }
    )
    newest = d.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))).where("back = 1")
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("double").alias(c) for c in ("above_sma50", "above_sma200")]
    return newest.select("symbol", F.col("close").alias("price"), "ret_1d", "ret_1w", "ret_1mo", "ret_3mo", F.col("rsi_14").alias("rsi"), "vol_ann", "from_high", "vol_surge", *flags)


def screen(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that pass every rule, by the first rule's metric: rising for < and <=, else falling; without rules by ret_1mo."""
    for rule in rules:
        table = table.where(F.coalesce(rule.column(), F.lit(False)))
    by, rising = (rules[0].metric, rules[0].op in ("<", "<=")) if rules else ("ret_1mo", False)
    return table.orderBy(F.asc_nulls_last(by) if rising else F.desc_nulls_last(by), "symbol")
