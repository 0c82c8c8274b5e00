"""Volume analysis: profile by price, day types, divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import Series


def profile(bars: DataFrame, bins: int = 24, last: int | None = None) -> DataFrame:
    """symbol, bin, low_edge, high_edge, volume: each bar's volume spread over the price bins its range overlaps."""
    if last:
        newest = Window.partitionBy("symbol").orderBy(F.desc("dt"))
        bars = bars.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    span = bars.groupBy("symbol").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-9).otherwise(F.col("hi")))
    step = (F.col("hi") - F.col("lo")) / bins
    rows = bars.join(span, "symbol").withColumn("step", step)
    first = F.greatest(F.floor((F.col("low") - F.col("lo")) / F.col("step")) - 1, F.lit(0))
    final = F.least(F.floor((F.col("high") - F.col("lo")) / F.col("step")) + 1, F.lit(bins - 1))
    rows = rows.withColumn("bin", F.explode(F.sequence(first, final)))  # only the bins a bar can touch
    a, b = F.col("lo") + F.col("bin") * F.col("step"), F.col("lo") + (F.col("bin") + 1) * F.col("step")
    overlap = F.greatest(F.least("high", b) - F.greatest("low", a), F.lit(0.0)) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    return rows.groupBy("symbol", "bin", a.alias("low_edge"), b.alias("high_edge")).agg(F.sum(overlap * F.col("volume")).alias("volume"))


def value_area(profiled: DataFrame, bins: int = 24, share: float = 0.7) -> DataFrame:
    """symbol, poc, value_area_low, value_area_high: from the fullest bin outwards to the larger neighbour, above on ties, until `share` of all volume is inside."""
    whole = profiled.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("bin", "volume"))).alias("found"), F.min(F.col("low_edge") - F.col("bin") * (F.col("high_edge") - F.col("low_edge"))).alias("lo"), F.max(F.col("high_edge") - F.col("low_edge")).alias("step")
    )
    by_bin = F.map_from_entries(F.transform("found", lambda x: F.struct(x["bin"], x["volume"])))
    whole = whole.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(by_bin, i.cast("long")), F.lit(0.0))))
    whole = whole.withColumn("p", F.array_position("v", F.array_max("v")).cast("int") - 1)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)

    def grow(a, _):
        below = F.when(a["l"] > 0, F.get(F.col("v"), a["l"] - 1)).otherwise(-1.0)
        above = F.when(a["h"] < bins - 1, F.get(F.col("v"), a["h"] + 1)).otherwise(-1.0)
        more = (a["acc"] < share * F.col("total")) & ((a["l"] > 0) | (a["h"] < bins - 1))
        up = above >= below
        return F.struct(F.when(more & ~up, a["l"] - 1).otherwise(a["l"]).alias("l"), F.when(more & up, a["h"] + 1).otherwise(a["h"]).alias("h"), (a["acc"] + F.when(more & up, above).when(more, below).otherwise(0.0)).alias("acc"))

    start = F.struct(F.col("p").alias("l"), F.col("p").alias("h"), F.get(F.col("v"), F.col("p")).alias("acc"))
    whole = whole.withColumn("total", total).withColumn("area", F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, grow))
    return whole.select("symbol", (F.col("lo") + (F.col("p") + 0.5) * F.col("step")).alias("poc"), (F.col("lo") + F.col("area.l") * F.col("step")).alias("value_area_low"), (F.col("lo") + (F.col("area.h") + 1) * F.col("step")).alias("value_area_high"))


def day_types(bars: DataFrame) -> DataFrame:
    """Adds clv (where in its range a bar closed), ratio and z (volume against the 20 bars before) and day_type to each bar."""
    s = Series()
    before = s.w.rowsBetween(-20, -1)
    avg, sd = F.avg("volume").over(before), F.when(F.count("volume").over(before) > 2, F.stddev_samp("volume").over(before))
    d = bars.withColumn("clv", (2 * F.col("close") - F.col("low") - F.col("high")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)))
    d = d.withColumn("ratio", F.when(F.coalesce(avg, F.col("volume")) > 0, F.col("volume") / F.coalesce(avg, F.col("volume"))).otherwise(1.0))
    d = d.withColumn("z", F.when(sd > 0, (F.col("volume") - avg) / sd).otherwise(0.0))
    heavy = F.col("ratio") > 1.5
    label = F.when(heavy & (F.col("clv") > 0.3), "accumulation").when(heavy & (F.col("clv") < -0.3), "distribution").when(heavy, "churn").when(F.col("ratio") < 0.6, "quiet").otherwise("normal")
    return d.withColumn("day_type", label)


def divergence(bars: DataFrame, window: int = 40) -> DataFrame:
    """symbol, divergence: price and on-balance volume that went apart between the halves of the last `window` bars."""
    s = Series()
    d = bars.withColumn("v", F.coalesce(F.signum(F.col("close") - s.lag("close")), F.lit(0.0)) * F.col("volume"))
    d = d.withColumn("obv", F.sum("v").over(s.so_far)).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))))
    late, early = F.col("back") <= window // 2, (F.col("back") > window // 2) & (F.col("back") <= window)
    trend = lambda x: F.signum(F.avg(F.when(late, F.col(x))) - F.avg(F.when(early, F.col(x))))
    t = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), trend("close").alias("price"), trend("obv").alias("flow"))
    return t.select("symbol", F.when(F.col("n") < window + 2, "none").when((F.col("price") > 0) & (F.col("flow") < 0), "bearish").when((F.col("price") < 0) & (F.col("flow") > 0), "bullish").otherwise("none").alias("divergence"))
