"""Candle patterns over one, two and three bars, with strict inequalities: a row for each day and pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series

#: Fixed thresholds: body or shadow against range or body.
DOJI_BODY_MAX, MARUBOZU_BODY_MIN, SHADOW_RATIO, SMALL_SHADOW_MAX, STAR_BODY_MAX, STRONG_BODY_MIN = 0.10, 0.90, 2.0, 0.25, 0.30, 0.6
#: Fixed names and directions of the patterns.
DIRECTIONS = {
    "doji": "neutral", "bullish marubozu": "bullish", "bearish marubozu": "bearish", "hammer": "bullish", "shooting star": "bearish",
    "bullish engulfing": "bullish", "bearish engulfing": "bearish", "bullish harami": "bullish", "bearish harami": "bearish",
    "piercing line": "bullish", "dark cloud cover": "bearish", "morning star": "bullish", "evening star": "bearish",
    "three white soldiers": "bullish", "three black crows": "bearish",
}


def detect(bars: DataFrame, key: str = "symbol", order: str = "dt") -> DataFrame:
    """symbol, dt, pattern, direction. A bar without range shows no pattern that needs one."""
    s = Series(key, order)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    b = bars.withColumns({"body": F.abs(c - o), "up": c > o, "dn": c < o, "upper": h - F.greatest(o, c), "lower": F.least(o, c) - low, "share": F.try_divide(F.abs(c - o), F.when(h > low, h - low))})
    b = b.withColumns({f"{x}{i}": s.lag(x, i) for i in (1, 2) for x in ("open", "close", "body", "up", "dn", "share")})
    body, share = F.when(F.col("body") > 0, F.col("body")), F.col("share")
    up, dn, up1, dn1, po, pc = (F.col(x) for x in ("up", "dn", "up1", "dn1", "open1", "close1"))
    middle, first_middle = (po + pc) / 2, (F.col("open2") + F.col("close2")) / 2
    pause = F.col("body1") <= STAR_BODY_MAX * (F.col("body2") + F.col("body")) / 2
    strong = (share >= STRONG_BODY_MIN) & (F.col("share1") >= STRONG_BODY_MIN) & (F.col("share2") >= STRONG_BODY_MIN)
    tests: dict[str, Column] = {
        "doji": share <= DOJI_BODY_MAX,
        "bullish marubozu": (share >= MARUBOZU_BODY_MIN) & up,
        "bearish marubozu": (share >= MARUBOZU_BODY_MIN) & dn,
        "hammer": (F.col("lower") >= SHADOW_RATIO * body) & (F.col("upper") <= SMALL_SHADOW_MAX * body),
        "shooting star": (F.col("upper") >= SHADOW_RATIO * body) & (F.col("lower") <= SMALL_SHADOW_MAX * body),
        "bullish engulfing": up & dn1 & (o < pc) & (c > po),
        "bearish engulfing": dn & up1 & (o > pc) & (c < po),
        "bullish harami": up & dn1 & (o > pc) & (c < po),
        "bearish harami": dn & up1 & (o < pc) & (c > po),
        "piercing line": up & dn1 & (o < pc) & (c > middle) & (c < po),
        "dark cloud cover": dn & up1 & (o > pc) & (c < middle) & (c > po),
        "morning star": F.col("dn2") & pause & up & (c > first_middle),
        "evening star": F.col("up2") & pause & dn & (c < first_middle),
        "three white soldiers": F.col("up2") & up1 & up & strong & (pc > F.col("close2")) & (c > pc),
        "three black crows": F.col("dn2") & dn1 & dn & strong & (pc < F.col("close2")) & (c < pc),
    }
    marks = F.array(*(F.when(test, F.struct(F.lit(name).alias("pattern"), F.lit(DIRECTIONS[name]).alias("direction"))) for name, test in tests.items()))
    return b.select(key, order, F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select(key, order, "m.pattern", "m.direction")


def following(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """A row for each bar and horizon, with horizon and fwd: the log return to the bar `horizon` bars on."""
    s = Series()
    ahead = bars.withColumn("ahead", F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), (F.ln(s.lead("close", h)) - F.ln("close")).alias("fwd")) for h in horizons)))
    return ahead.withColumn("ahead", F.explode("ahead")).select(*bars.columns, "ahead.horizon", "ahead.fwd")


def record(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """symbol, pattern, horizon, n, mean_pct, hit_rate, baseline_pct: log returns after a pattern and after any day."""
    ahead = following(bars, horizons).where("fwd IS NOT NULL")
    base = ahead.groupBy("symbol", "horizon").agg((100 * F.avg("fwd")).alias("baseline_pct"))
    own = ahead.join(detect(bars), ["symbol", "dt"]).groupBy("symbol", "pattern", "horizon").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg("fwd")).alias("mean_pct"), F.avg((F.col("fwd") > 0).cast("double")).alias("hit_rate"))
    return own.join(base, ["symbol", "horizon"])
