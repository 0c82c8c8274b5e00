"""Implied volatilities of chains: at the money, ranked, against realised, as a surface; strategies built from chain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import options as op
from ..functions.series import YEAR, Series

SNAP = ["ts", "expiry"]
LEAST_DAYS = 20
DEFAULT_IV = 0.15
#: Fixed strategies: legs as side, kind and strikes away from the nearest one, in widths.
STRATEGIES = {
    "long_straddle": ((1, "CE", 0), (1, "PE", 0)),
    "short_straddle": ((-1, "CE", 0), (-1, "PE", 0)),
    "long_strangle": ((1, "CE", 1), (1, "PE", -1)),
    "short_strangle": ((-1, "CE", 1), (-1, "PE", -1)),
    "bull_call_spread": ((1, "CE", 0), (-1, "CE", 1)),
    "bear_put_spread": ((1, "PE", 0), (-1, "PE", -1)),
    "iron_condor": ((-1, "CE", 1), (1, "CE", 2), (-1, "PE", -1), (1, "PE", -2)),
    "iron_fly": ((-1, "CE", 0), (-1, "PE", 0), (1, "CE", 2), (1, "PE", -2)),
}


def both_mean(a: Column, b: Column) -> Column:
    """Mean of the sides that have a value."""
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    return F.try_divide(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), n)


def atm_iv(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """key, iv: of each snapshot the mean IV at the strike nearest to spot, the lowest of equals. Without a spot or an IV there is none."""
    at = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), F.col("strike").alias("s"), both_mean(F.col("call_iv"), F.col("put_iv")).alias("iv")))
    return snapshots.where("spot IS NOT NULL AND strike IS NOT NULL").groupBy(*key).agg(at["iv"].alias("iv")).where("iv IS NOT NULL")


def atm_iv_intraday(panel: DataFrame) -> DataFrame:
    """ts, iv: of the front expiry alone."""
    front = panel.withColumn("front", F.min("expiry").over(Window.partitionBy("ts"))).where("expiry = front")
    return atm_iv(front, ["ts"])


def atm_iv_history(panel: DataFrame, day: Column) -> DataFrame:
    """day, iv: of the last snapshot of each day, whatever its expiries."""
    rows = panel.withColumn("day", day)
    last = rows.withColumn("last", F.max("ts").over(Window.partitionBy("day"))).where("ts = last")
    return atm_iv(last, ["day"])


def iv_rank(history: DataFrame, current: float | Column) -> DataFrame:
    """One row: days, rank (share of days at or below the current IV; NULL below LEAST_DAYS days), least and largest."""
    enough = F.count("iv") >= LEAST_DAYS
    share = F.avg((F.col("iv") <= current).cast("double"))
    return history.agg(F.count("iv").alias("days"), F.when(enough, share).alias("rank"), F.when(enough, F.min("iv")).alias("min_iv"), F.when(enough, F.max("iv")).alias("max_iv"))


def vwap(price: str = "close", volume: str = "volume") -> Column:
    """Aggregate: volume-weighted price, NULL without volume."""
    return F.when(F.sum(volume) > 0, F.sum(F.col(price) * F.col(volume)) / F.sum(volume))


def quote_price(mid: Column, ltp: Column) -> Column:
    return F.when(mid.isNotNull() & ~F.isnan(mid) & (mid > 0), mid).otherwise(ltp)


def solved(chain: DataFrame) -> DataFrame:
    """Adds call_iv and put_iv where they are missing, from the mid or else a positive last price (columns t, call_mid, put_mid, call_ltp, put_ltp)."""
    for side in ("call", "put"):
        px = F.coalesce(f"{side}_mid", F.when(F.col(f"{side}_ltp") > 0, F.col(f"{side}_ltp")))
        own = op.implied_vol(px, "spot", "strike", "t", F.lit(side == "call"))
        chain = chain.withColumn(f"{side}_iv", F.coalesce(f"{side}_iv", own) if f"{side}_iv" in chain.columns else own)
    return chain


def report(bars: DataFrame, iv: float | Column, spot: float | Column, window: int = 21) -> DataFrame:
    """symbol, rv_cc, rv_park, iv_premium, rv_percentile (of more than 20 values), note: implied against realised volatility."""
    s = Series()
    rows = bars.withColumn("r", s.log_returns("close"))
    rows = rows.withColumns({"rv": s.realized_vol("r", window), "park": s.parkinson(window)})
    last = rows.groupBy("symbol").agg(F.max_by("rv", F.when(F.col("rv").isNotNull(), F.col("dt"))).alias("rv_cc"), F.max_by("park", F.when(F.col("park").isNotNull(), F.col("dt"))).alias("rv_park"))
    share = rows.where("rv IS NOT NULL").join(last, "symbol").groupBy("symbol").agg(F.when(F.count("rv") > 20, F.avg((F.col("rv") <= F.col("rv_cc")).cast("double"))).alias("rv_percentile"))
    premium = (F.lit(iv) if isinstance(iv, float) else iv) - F.col("rv_cc")
    note = F.when(F.col("iv_premium") > 0.04, "options rich").when(F.col("iv_premium") < -0.02, "options cheap").when(F.col("iv_premium").isNotNull(), "fair")
    return last.join(share, "symbol", "left").withColumn("iv_premium", premium).withColumn("note", note)


def cone(snapshots: DataFrame, days: tuple[int, ...] = (1, 3, 5, 10, 21)) -> DataFrame:
    """Rows (spot, iv) with the prices one and two deviations away after each number of days."""
    rows = snapshots.withColumn("days", F.explode(F.array(*map(F.lit, days))))
    s = F.col("iv") * F.sqrt(F.col("days") / YEAR)
    return rows.withColumns({n: F.col("spot") * F.exp(k * s) for n, k in (("down_2", -2), ("down_1", -1), ("up_1", 1), ("up_2", 2))})


def numbered(chain: DataFrame) -> DataFrame:
    """Adds i (number of the strike), atm (that of the nearest one) and n (how many) within each snapshot."""
    rows = chain.withColumn("i", F.row_number().over(Window.partitionBy(*SNAP).orderBy("strike")))
    whole = Window.partitionBy(*SNAP)
    atm = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), F.col("strike").alias("s"), F.col("i").alias("i"))).over(whole)["i"]
    return rows.withColumns({"atm": atm, "n": F.count(F.lit(1)).over(whole)})


def strategy_legs(chain: DataFrame, width: int = 2, strategies: dict = STRATEGIES) -> DataFrame:
    """ts, expiry, spot, name, leg, side, kind, strike, premium, iv of the legs of each strategy at each snapshot.

    The templates are a small table of constants; legs beyond the ends of a chain take its last strike.
    """
    spark = chain.sparkSession
    rows = [(name, i + 1, side, kind, off * max(width, 1)) for name, legs in strategies.items() for i, (side, kind, off) in enumerate(legs)]
    templates = spark.createDataFrame(rows, "name string, leg int, side int, kind string, offset int")
    at = numbered(chain)
    snaps = at.select(*SNAP, "spot", "atm", "n").distinct().crossJoin(F.broadcast(templates))  # some twenty rows
    snaps = snaps.withColumn("i", F.least(F.greatest(F.col("atm") + F.col("offset"), F.lit(1)), F.col("n").cast("int")))
    call = F.col("kind") == "CE"
    legs = snaps.drop("spot", "n", "atm").join(at.drop("atm", "n"), [*SNAP, "i"])
    return legs.select(*SNAP, "spot", "name", "leg", "side", "kind", "strike", F.when(call, F.col("call_ltp")).otherwise(F.col("put_ltp")).alias("premium"), F.coalesce(F.when(call, F.col("call_iv")).otherwise(F.col("put_iv")), F.lit(DEFAULT_IV)).alias("iv"))


def leg_payoff(px: Column) -> Column:
    """Of a leg (side, kind, strike, premium) at a price at expiry."""
    gain = F.when(F.col("kind") == "CE", px - F.col("strike")).otherwise(F.col("strike") - px)
    return F.col("side") * (F.greatest(gain, F.lit(0.0)) - F.col("premium"))


def payoffs(legs: DataFrame, span: Column, points: int = 1201) -> DataFrame:
    """ts, expiry, name, i, px, payoff on an even grid of prices from spot * (1 - span) to spot * (1 + span).

    A position's few legs ride along as an array, so the grid is not shuffled.
    """
    book = legs.groupBy(*SNAP, "spot", "name").agg(F.sort_array(F.collect_list(F.struct("leg", "side", "kind", "strike", "premium"))).alias("legs")).where(F.forall("legs", lambda x: x["premium"].isNotNull()))
    grid = book.withColumn("span", span).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("px", F.col("spot") * (1 - F.col("span") + 2 * F.col("span") * F.col("i") / (points - 1)))

    def one(x: Column) -> Column:
        gain = F.when(x["kind"] == "CE", F.col("px") - x["strike"]).otherwise(x["strike"] - F.col("px"))
        return x["side"] * (F.greatest(gain, F.lit(0.0)) - x["premium"])

    return grid.select(*SNAP, "name", "i", "px", F.aggregate("legs", F.lit(0.0), lambda a, x: a + one(x)).alias("payoff"))


def payoff_summary(rows: DataFrame) -> DataFrame:
    """ts, expiry, name, max_profit, max_loss (NULL: unlimited), breakevens (how many), risk_reward."""
    w = Window.partitionBy(*SNAP, "name").orderBy("i")
    rows = rows.withColumns({"p0": F.lag("payoff").over(w), "x0": F.lag("px").over(w)}).withColumn("payoff", F.round("payoff", 9)).withColumn("p0", F.round("p0", 9))
    step = F.max(F.when(F.col("i") == 1, F.col("px") - F.col("x0"))) * 1e-3
    last = F.max_by(F.col("payoff") - F.col("p0"), "i")
    first = F.max(F.when(F.col("i") == 1, F.col("payoff") - F.col("p0")))
    crosses = F.count_if((F.signum("p0") != F.signum("payoff")) & (F.signum("p0") != 0))
    out = rows.groupBy(*SNAP, "name").agg(
        F.when((last > step) | (first < -step), None).otherwise(F.max("payoff")).alias("max_profit"),
        F.when((last < -step) | (first > step), None).otherwise(F.min("payoff")).alias("max_loss"), crosses.alias("breakevens"),
    )
    return out.withColumn("risk_reward", F.when(F.col("max_loss") != 0, F.abs(F.col("max_profit") / F.col("max_loss"))))


def custom_legs(chain: DataFrame, tokens: list[str]) -> DataFrame:
    """Legs written like +23200CE or -23400PE, at each snapshot that has their strike. Malformed ones are an error."""
    import re

    found = [re.fullmatch(r"([+-])(\d+(?:\.\d+)?)(CE|PE)", t.strip().upper()) for t in tokens]
    if not all(found):
        raise ValueError(f"legs are like +23200CE or -23400PE: {tokens}")
    rows = [(i + 1, 1 if m[1] == "+" else -1, m[3], float(m[2])) for i, m in enumerate(found)]
    asked = chain.sparkSession.createDataFrame(rows, "leg int, side int, kind string, strike double")
    call = F.col("kind") == "CE"
    return chain.join(F.broadcast(asked), "strike").select(*SNAP, "leg", "side", "kind", "strike", F.when(call, F.col("call_ltp")).otherwise(F.col("put_ltp")).alias("premium"))


def surface(chain: DataFrame, days: Column) -> DataFrame:
    """ts, expiry, strike, days, iv: the smile of a snapshot damped towards its at-the-money IV with the root of time; 0.01 at least.

    chain: with call_iv, put_iv and t (years); days: an array of maturities for each snapshot's own number of days.
    """
    smile = chain.withColumn("smile", both_mean(F.col("call_iv"), F.col("put_iv"))).where("smile IS NOT NULL")
    whole = Window.partitionBy(*SNAP)
    at = F.min(F.struct(F.abs(F.col("strike") - F.col("spot")).alias("d"), F.col("strike").alias("s"), F.col("smile").alias("iv"))).over(whole)["iv"]
    rows = smile.withColumns({"atm_iv": at, "n": F.count(F.lit(1)).over(whole), "own": F.greatest(F.col("t") * 365, F.lit(1.0))}).where("n >= 5").withColumn("days", F.explode(days))
    damp = F.sqrt(F.col("own") / F.col("days"))
    return rows.select(*SNAP, "strike", "days", F.greatest(F.col("atm_iv") + (F.col("smile") - F.col("atm_iv")) * damp, F.lit(0.01)).alias("iv"))


def maturities(own: Column, most: float = 95.0, n: int = 14) -> Column:
    """Days from 0.35 of an expiry's own (2 at least) to `most`, in even ratios, rounded, with its own among them."""
    low = F.greatest(own * 0.35, F.lit(2.0))
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(low * F.pow(most / low, i / (n - 1))))
    return F.array_sort(F.array_distinct(F.concat(even, F.array(F.round(own)))))


def smile_fit(rows: DataFrame, least: int = 5) -> DataFrame:
    """ts, expiry, n, level, slope, curve: weighted quadratic in x = ln(strike / forward) / sqrt(t) of the IVs of each snapshot.

    The sums of a snapshot make the normal equations, which are solved as columns, so fits are a grouped aggregation. rows: x, iv, w.
    """
    m = rows.groupBy(*SNAP).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("w") * F.pow("x", F.lit(k))).alias(f"s{k}") for k in range(5)), *(F.sum(F.col("w") * F.pow("x", F.lit(k)) * F.col("iv")).alias(f"b{k}") for k in range(3)))
    s, b = [F.col(f"s{k}") for k in range(5)], [F.col(f"b{k}") for k in range(3)]

    def det(a, c, e):
        return a[0] * (c[1] * e[2] - c[2] * e[1]) - a[1] * (c[0] * e[2] - c[2] * e[0]) + a[2] * (c[0] * e[1] - c[1] * e[0])

    columns = [s[0:3], s[1:4], s[2:5]]
    whole = det(*columns)
    solved_ = [F.try_divide(det(*(b if j == k else columns[j] for j in range(3))), whole).alias(n) for k, n in enumerate(("level", "slope", "curve"))]
    return m.where(F.col("n") >= least).select(*SNAP, "n", *solved_)


def leg_greeks(positions: DataFrame, chain: DataFrame, t: Column) -> DataFrame:
    """Positions (symbol, instrument, kind EQ, FUT, CE or PE, strike, qty) with delta, gamma, theta, vega, and marked.

    Options are marked by the row of their strike; without one, or without an IV, they are not marked. Cash and futures have a delta of 1.
    """
    rows = chain.select(F.col("strike").alias("k"), "spot", "call_iv", "put_iv", t.alias("t"))
    both = positions.join(rows, (F.abs(F.col("strike") - F.col("k")) <= 1e-6) & (F.round(F.col("strike"), 3) == F.round(F.col("k"), 3)), "left")
    linear, call = F.col("kind").isin("EQ", "FUT"), F.col("kind") == "CE"
    iv = F.when(call, F.col("call_iv")).otherwise(F.col("put_iv"))
    marked = linear | F.coalesce(iv > 0, F.lit(False))
    g = op.greeks("spot", "k", "t", iv, call)
    greek = lambda n: F.when(linear, F.col("qty") if n == "delta" else F.lit(0.0)).when(marked, g[n] * F.col("qty")).cast("double").alias(n)
    return both.select("symbol", "instrument", "kind", "qty", *(greek(n) for n in ("delta", "gamma", "theta", "vega")), marked.alias("marked"))


def book_greeks(legs: DataFrame) -> DataFrame:
    """symbol (NULL: the net of all), delta, gamma, theta, vega of what is marked, and the names of what is not."""
    sums = [F.coalesce(F.sum(F.when(F.col("marked"), F.col(n))), F.lit(0.0)).alias(n) for n in ("delta", "gamma", "theta", "vega")]
    missing = F.concat_ws(", ", F.array_sort(F.collect_set(F.when(~F.col("marked"), F.col("instrument"))))).alias("unmarked")
    return legs.where("qty != 0").rollup("symbol").agg(*sums, missing)


def describe(d: Column, g: Column, t: Column, v: Column) -> Column:
    """Net greeks in a line."""
    whole = lambda x: F.format_number(F.abs(x), 0)
    way = lambda x: F.when(x > 0, "long").otherwise("short")
    return F.concat_ws(
        " · ", F.when(F.abs(d) < 1, "delta-flat").otherwise(F.concat(way(d), F.lit(" "), whole(d), F.lit(" delta"))), F.when(F.abs(g) > 1e-9, F.concat(way(g), F.lit(" gamma"))),
        F.when(F.abs(t) > 1e-9, F.concat(F.when(t > 0, "earning ").otherwise("paying "), whole(t), F.lit("/day"))), F.when(F.abs(v) > 1e-9, F.concat(way(v), F.lit(" vega "), whole(v))),
    )


def sabr_quality(rmse: Column) -> Column:
    return F.when(rmse <= 0.25, "tight").when(rmse <= 0.5, "usable").otherwise("poor")
