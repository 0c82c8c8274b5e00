"""Event-driven execution of entry and exit signals: fills at the next open, stops, targets, trailing stops and filters.

Each bar's state needs the one before. Runs (a symbol, or a symbol and parameters) are spread over tasks, and a long run is cut into pieces
that all start at once and hand over their position; a piece runs again if it began with another one than its
predecessor left (`hand_over`). A trade is reported on the bar that closes it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import CASH, COST
from .recursive import with_recursive
from .scan import PIECE, Pieces, before, hand_over, numbered, pieces, running


@dataclass(frozen=True)
class Execution:
    cost: float = COST  # of a side: commission and slippage
    stop: tuple[str, float] = ("none", 0.0)  # none, percent, pips or atr, and how many of them
    target: tuple[str, float] = ("none", 0.0)
    trailing: bool = False
    atr_period: int = 14
    pip: float = 1.0
    session: tuple[str, str] | None = None  # HH:MM to HH:MM, both included
    cooldown: int = 0
    atr_min: float | None = None
    atr_max: float | None = None
    allow_short: bool = True

    @property
    def needs_atr(self) -> bool:
        return "atr" in (self.stop[0], self.target[0]) or self.atr_min is not None or self.atr_max is not None


def in_session(ts: Column, start: str | None, end: str | None) -> Column:
    """True at minutes of the day from start to end, both included; an end before the start is on the next day."""
    if not start or not end:
        return F.lit(True)
    minute = F.hour(ts) * 60 + F.minute(ts)
    a, b = (int(x[:-3]) * 60 + int(x[-2:]) for x in (start, end))
    return minute.between(a, b) if a <= b else (minute >= a) | (minute <= b)


def distance(mode: str, value: float, entry: Column, atr: Column, pip: float = 1.0) -> Column:
    """How far a stop or target is from the entry; NULL where there is none."""
    if value <= 0 or mode == "none":
        return F.lit(None).cast("double")
    return {"percent": entry * (value / 100), "pips": F.lit(value * pip), "atr": value * atr}[mode]


def levels(entry: Column, direction: Column, x: Execution, atr: Column) -> tuple[Column, Column]:
    """Stop and target prices of a position."""
    return entry - direction * distance(*x.stop, entry, atr, x.pip), entry + direction * distance(*x.target, entry, atr, x.pip)


def intrabar_exit(direction: Column, stop: Column, target: Column) -> Column:
    """struct(price, reason) at which a bar closes a position: gaps fill at the open, and a stop comes before a target."""
    long = direction > 0
    beyond = lambda price, level, down: F.when(long, price <= level if down else price >= level).otherwise(price >= level if down else price <= level)
    at = lambda price, reason: F.struct(price.alias("price"), F.lit(reason).alias("reason"))
    worst, best = F.when(long, F.col("low")).otherwise(F.col("high")), F.when(long, F.col("high")).otherwise(F.col("low"))
    opened = F.col("open")
    return F.when(beyond(opened, stop, True), at(opened, "stop")).when(beyond(opened, target, False), at(opened, "target")).when(beyond(worst, stop, True), at(stop, "stop")).when(beyond(best, target, False), at(target, "target"))


class Position:
    """An open position and the levels that close it."""

    def __init__(self, k: int, price: float, way: int, x: Execution, atr: float):
        def far(mode: str, value: float) -> float:
            size = {"percent": price * value / 100, "pips": value * x.pip, "atr": value * atr}.get(mode, math.nan)
            return size if value > 0 else math.nan

        self.k, self.price, self.way, self.mark, self.extreme = k, price, way, price, price
        self.room = far(*x.stop)
        self.stop, self.target = price - way * self.room, price + way * far(*x.target)

    @classmethod
    def taken_over(cls, held: list) -> Position:
        self = cls.__new__(cls)
        self.k, self.price, self.way, self.mark, self.extreme, self.room, self.stop, self.target = held
        return self

    def handed_over(self) -> list:
        return [self.k, self.price, self.way, self.mark, self.extreme, self.room, self.stop, self.target]

    def trail(self, high: float, low: float) -> None:
        self.extreme = max(self.extreme, high) if self.way > 0 else min(self.extreme, low)
        level = self.extreme - self.way * self.room
        if self.way * level > self.way * self.stop:
            self.stop = level

    def closed_by(self, opened: float, high: float, low: float) -> tuple[float, str] | None:
        worst, best = (low, high) if self.way > 0 else (high, low)
        for price, level, sign, fill, reason in ((opened, self.stop, -1, opened, "stop"), (opened, self.target, 1, opened, "target"), (worst, self.stop, -1, self.stop, "stop"), (best, self.target, 1, self.target, "target")):
            if sign * self.way * (price - level) >= 0:  # False without a level
                return fill, reason
        return None


MADE = "pos double, ret double, entry_k long, entry_price double, exit_price double, direction long, exit_reason string"


def simulate(signals: DataFrame, x: Execution = Execution(), key: list[str] | None = None, cash: float = CASH, cut: Pieces | None = None) -> DataFrame:
    """key, dt, k, close, pos, ret, equity of each bar, and of the trade that it closes entry_k, entry_price, exit_price, direction, exit_reason, return_pct, bars_held.

    signals: bars with long_entry, long_exit, short_entry and short_exit; a bar's signals act at the next one's open.
    A trailing stop follows a bar's own extreme before that bar is tested.
    """
    key = key or ["symbol"]
    cut = cut or pieces(signals, key)
    name = f"atr_{x.atr_period}"
    if x.needs_atr and name not in signals.columns:
        signals = with_recursive(signals, [("atr", x.atr_period)], key, cut)
    may = in_session(F.col("dt"), *(x.session or (None, None)))
    rows = numbered(cut.cut(signals), cut)
    rows = before(rows, cut, [name]) if x.needs_atr else rows
    atr = F.col(f"_before_{name}") if x.needs_atr else F.lit(None).cast("double")
    rows = rows.select(
        *key, PIECE, "dt", "open", "high", "low", "close", "long_exit", "short_exit", atr.alias("atr"), may.alias("may"),
        F.when(F.col("long_entry"), 1).when(F.col("short_entry") & F.lit(x.allow_short), -1).otherwise(0).alias("wish"), "k",
    )
    if x.atr_min is not None or x.atr_max is not None:
        fits = F.col("atr").between(x.atr_min if x.atr_min is not None else -math.inf, x.atr_max if x.atr_max is not None else math.inf)
        rows = rows.withColumn("may", F.col("may") & F.coalesce(fits, F.lit(False)))

    def run(bars: pd.DataFrame, state: dict | None, final: bool) -> tuple[pd.DataFrame, dict]:
        state = state or {"held": None, "rested": None, "wish": 0, "leave": [False, False]}
        made: list[tuple] = []
        held = Position.taken_over(state["held"]) if state["held"] else None
        rested = -math.inf if state["rested"] is None else state["rested"]  # bar of the last exit
        wish, leave = state["wish"], dict(zip((1, -1), state["leave"], strict=True))  # of the bar before
        last = bars["k"].iloc[-1]
        for i, o, h, lo, c, lx, sx, atr_, may_, w in bars[["k", "open", "high", "low", "close", "long_exit", "short_exit", "atr", "may", "wish"]].itertuples(index=False):
            ret, fresh, out = 0.0, False, None
            if held is None and wish and may_ and i - rested > x.cooldown:
                held, fresh, ret = Position(i, o, wish, x, atr_), True, -x.cost
            wish, leaving, leave = w, leave, {1: lx, -1: sx}
            if held is None:
                made.append((0.0, ret, None, None, None, None, None))
                continue
            if x.trailing:
                held.trail(h, lo)
            out = (o, "signal") if not fresh and leaving[held.way] else held.closed_by(o, h, lo)
            ret += held.way * ((out[0] if out else c) / held.mark - 1) - (x.cost if out else 0)
            if not out and final and i == last:
                out = (c, "end-of-data")
            made.append((float(held.way), ret, *((held.k, held.price, out[0], held.way, out[1]) if out else (None,) * 5)))
            held.mark = c
            if out:
                held, rested = None, i
        frame = pd.DataFrame(made, columns=[m.split()[0] for m in MADE.split(", ")], index=bars.index).astype({"entry_k": "Int64", "direction": "Int64"})
        waits = last + 1 - rested <= x.cooldown  # an exit that no longer matters is forgotten
        left = {"held": held.handed_over() if held else None, "rested": int(rested) if waits else None, "wish": int(wish), "leave": [bool(leave[1]), bool(leave[-1])]}
        return pd.concat([bars[[*key, "dt", "k", "close"]], frame], axis=1), left

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*key, "dt", "k", "close").dtypes)
    done = cut.cut(hand_over(rows, cut, run, f"{kinds}, {MADE}"))
    growth = F.product(1 + F.col("ret"))
    done = running(done, cut, growth, growth, F.product, lambda a, b: a * b, "equity").withColumn("equity", cash * F.col("equity")).drop(PIECE)
    return done.withColumn("return_pct", F.col("direction") * (F.col("exit_price") / F.col("entry_price") - 1) - 2 * x.cost).withColumn("bars_held", F.col("k") - F.col("entry_k"))
