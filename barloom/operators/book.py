"""Ledger: positions, FIFO matching, costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import PIECE_ROWS, Pieces, kept, longest, pieces, relay

#: Fixed charges of index options in India: an order, and shares of turnover.
BROKERAGE, STT_SELL, STT_EXERCISE, EXCHANGE, SEBI, STAMP_BUY, GST = 20.0, 0.001, 0.00125, 0.0003503, 0.000001, 0.00003, 0.18


def costs(fills: DataFrame, key: list[str]) -> DataFrame:
    """Charges of the fills of a key: side, price, qty and, if there is one, intrinsic (charged whichever the side)."""
    turnover, sell = F.col("price") * F.col("qty"), F.upper("side") == "SELL"
    intrinsic = F.col("intrinsic") if "intrinsic" in fills.columns else F.lit(0.0)
    c = fills.groupBy(*key).agg(
        (BROKERAGE * F.count(F.lit(1))).alias("brokerage"),
        (STT_SELL * F.sum(F.when(sell, turnover).otherwise(0.0)) + STT_EXERCISE * F.sum(F.greatest(intrinsic, F.lit(0.0)) * F.col("qty"))).alias("stt"),
        (EXCHANGE * F.sum(turnover)).alias("exchange"),
        (SEBI * F.sum(turnover)).alias("sebi"),
        (STAMP_BUY * F.sum(F.when(sell, 0.0).otherwise(turnover))).alias("stamp"),
    )
    c = c.withColumn("gst", GST * (F.col("brokerage") + F.col("exchange") + F.col("sebi")))
    return c.withColumn("total", F.col("brokerage") + F.col("stt") + F.col("exchange") + F.col("sebi") + F.col("stamp") + F.col("gst"))


def closing(fills: DataFrame) -> DataFrame:
    """The fills that undo fills: sides turned, nothing exercised."""
    return fills.withColumn("side", F.when(F.upper("side") == "SELL", "BUY").otherwise("SELL")).drop("intrinsic")


def signed() -> Column:
    return F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty"))


def running(fills: DataFrame) -> DataFrame:
    """Adds net (quantity) and cash after each fill."""
    w = Window.partitionBy("instrument").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return fills.withColumn("net", F.sum(signed()).over(w)).withColumn("cash", F.sum(-signed() * F.col("price")).over(w))


def fifo(fills: DataFrame) -> DataFrame:
    """instrument, net_qty, avg_cost, realised: lots are closed in the order in which they were opened, and a fill may turn the side.

    First in first out pairs the n-th unit ever bought with the n-th unit ever sold. So with running quantities of each side, what
    both sides have in common is closed, and the units beyond it are the open lots; no fill is compared with any other, and a book
    of any size is one running sum. avg_cost is that of the open lots, NULL when flat.
    """
    side = Window.partitionBy("instrument", "side").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = fills.withColumn("side", F.when(F.upper("side") == "BUY", "BUY").otherwise("SELL")).withColumn("upto", F.sum("qty").over(side).cast("double"))
    total = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("upto"))), F.lit(0.0))
    closed = rows.groupBy("instrument").agg(F.least(total("BUY"), total("SELL")).alias("closed"), (total("BUY") - total("SELL")).alias("net_qty"))
    rows = rows.join(closed, "instrument").withColumn("open", F.least(F.greatest(F.col("upto") - F.col("closed"), F.lit(0.0)), F.col("qty").cast("double")))
    way = F.when(F.col("side") == "BUY", -1.0).otherwise(1.0)
    out = rows.groupBy("instrument", "net_qty").agg(F.sum(F.col("open") * F.col("price")).alias("held"), F.sum(way * (F.col("qty") - F.col("open")) * F.col("price")).alias("realised"))
    return out.select("instrument", "net_qty", F.when(F.col("net_qty") != 0, F.col("held") / F.abs("net_qty")).alias("avg_cost"), "realised")


TRADED = "status string, cash double, held double"


def traded(fills: DataFrame, cash: float, key: list[str] | None = None, cut: Pieces | None = None) -> DataFrame:
    """key, seq, side, qty, price, status, cash, held: fills in order against an account of each key that begins with `cash` and nothing held.

    A buy that costs more than the cash left is refused, and so is a sale of more than is held, a fill without a quantity above 0
    or without a price; what is refused changes nothing. Whether a fill goes through depends on all before it, and cash is not
    forgotten; so a long account is cut into pieces that run one after another, each once, and pass on cash and units.
    """
    key = key or ["instrument"]
    rows = fills.select(*key, "seq", "side", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    if cut is None:
        rows = kept(rows) if longest(rows, key) > PIECE_ROWS else rows  # places and pieces are of one pass
        cut = pieces(rows, key, "seq")

    def run(piece: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list]:
        left, held = state or (cash, 0.0)
        value, trade = piece["qty"] * piece["price"], (piece["qty"] > 0) & (piece["price"] >= 0)
        buys, sells = trade & (piece["side"] == "BUY"), trade & (piece["side"] == "SELL")
        said, cashes, units = [], [], []
        for buy, sell, qty, worth in zip(buys.tolist(), sells.tolist(), piece["qty"].tolist(), value.tolist(), strict=True):
            if buy:
                if worth > left:
                    status = "refused: cash"
                else:
                    status, left, held = "ok", left - worth, held + qty
            elif sell:
                if qty > held:
                    status = "refused: not held"
                else:
                    status, left, held = "ok", left + worth, held - qty
            else:
                status = "refused: not a trade"
            said.append(status)
            cashes.append(left)
            units.append(held)
        return piece.assign(status=said, cash=cashes, held=units), [left, held]

    kinds = dict(rows.dtypes)
    return relay(cut.cut(rows), cut, run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*key, "seq", "side", "qty", "price")), TRADED]))
