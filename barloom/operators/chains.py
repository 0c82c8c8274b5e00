"""Option-chain analytics: one grouped pass for a snapshot's figures, joins by strike for changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = ["ts", "expiry"]


def first_max(value: str, strike: str = "strike") -> Column:
    """The strike with the largest value, the lowest of equals."""
    return F.max(F.struct(F.col(value).alias("v"), (-F.col(strike)).alias("s")))["s"] * -1


def nearest(strike: str = "strike", to: str = "spot") -> Column:
    """The strike nearest to a price, the lowest of equals."""
    return F.min(F.struct(F.abs(F.col(strike) - F.col(to)).alias("d"), F.col(strike).alias("s")))["s"]


def max_pain(chain: DataFrame) -> DataFrame:
    """ts, expiry, max_pain: the strike at which option buyers get least, the lowest of equals.

    With running sums over strikes the payout at a strike K is K * N - S of the calls below and S - K * N of the puts
    above, so no strike is paired with any other. A snapshot without open interest has none.
    """
    up = Window.partitionBy(*SNAP).orderBy("strike").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*SNAP).orderBy("strike").rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike")
    calls = k * F.coalesce(F.sum("call_oi").over(up), F.lit(0)) - F.coalesce(F.sum(F.col("call_oi") * k).over(up), F.lit(0))
    puts = F.coalesce(F.sum(F.col("put_oi") * k).over(down), F.lit(0)) - k * F.coalesce(F.sum("put_oi").over(down), F.lit(0))
    pain = chain.withColumn("pain", calls + puts)
    some = F.sum(F.col("call_oi") + F.col("put_oi")) > 0
    return pain.groupBy(*SNAP).agg(F.when(some, F.min(F.struct(F.round("pain", 6).alias("p"), F.col("strike").alias("s")))["s"]).alias("max_pain"))


def snapshot(chain: DataFrame) -> DataFrame:
    """Positioning of each snapshot: put-call ratio, walls, nearest strike, straddle and expected move, max pain and bias."""
    at = chain.groupBy(*SNAP).agg(
        F.max("spot").alias("spot"), F.try_divide(F.sum("put_oi").cast("double"), F.sum("call_oi").cast("double")).alias("pcr"), first_max("put_oi").alias("support"), first_max("call_oi").alias("resistance"), nearest().alias("atm"),
        F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), F.col("strike").alias("s"), (F.col("call_ltp") + F.col("put_ltp")).alias("x")))["x"].alias("straddle"),
    ).join(max_pain(chain), SNAP)
    drift = (F.col("max_pain") - F.col("spot")) / F.col("spot")
    votes = F.when(F.col("pcr") > 1.2, 1).when(F.col("pcr") < 0.8, -1).otherwise(0) + F.when(drift > 0.005, 1).when(drift < -0.005, -1).otherwise(0)
    return at.withColumn("expected_move", F.col("straddle") / F.col("spot")).withColumn("distance_pct", 100 * drift).withColumn("bias", F.when(votes > 0, "bullish").when(votes < 0, "bearish").otherwise("neutral"))


def delta_oi(chain: DataFrame) -> DataFrame:
    """Open interest against the snapshot before, by strike; NULL where that has no such strike."""
    days = chain.select("ts").distinct().withColumn("before", F.lag("ts").over(Window.orderBy("ts")))  # a row for each snapshot
    prev = chain.select(F.col("ts").alias("before"), "strike", F.col("call_oi").alias("pc"), F.col("put_oi").alias("pp"))
    return chain.join(days, "ts").join(prev, ["before", "strike"], "left").select("ts", "strike", (F.col("call_oi") - F.col("pc")).alias("call_change"), (F.col("put_oi") - F.col("pp")).alias("put_change"))


def around(chain: DataFrame, n: int) -> DataFrame:
    """The rows of n strikes on either side of the nearest one."""
    at = Window.partitionBy(*SNAP).orderBy("strike")
    rows = chain.withColumn("i", F.row_number().over(at))
    whole = Window.partitionBy(*SNAP)
    atm = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), F.col("strike").alias("s"), F.col("i").alias("i"))).over(whole)["i"]
    return rows.withColumn("atm", atm).where(F.col("i").between(F.col("atm") - n, F.col("atm") + n)).drop("i", "atm")
