"""Indicators in which each value needs the one before: exponential means, and what columns make of them.

Only the means themselves leave the JVM: one pass over the pieces of each series makes all that are asked for, and a second one
those that smooth what the first one gave. A mean is a linear recurrence, so pieces of a long series run at once: each is summed up
as a factor and an addend of the mean that it begins with (`scan`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import Series
from .scan import PIECE, Pieces, before, pieces, scan

#: A mean: its name, the column it is of, the weight of a new value, and how many values it takes before there is one.
Mean = tuple[str, str, float, int]


def _ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _joined(mean: float, gap: int, x: float, alpha: float) -> float:
    """The mean once x comes `gap` rows behind the last value: missing rows let the old weight fade."""
    old = (1 - alpha) ** gap
    return (old * mean + alpha * x) / (old + alpha)


def _summary(x: np.ndarray, alpha: float) -> list[float]:
    """Of a piece: its rows, values, rows before the first and after the last one, the first one, and factor and addend from the mean there to the last one."""
    seen = np.flatnonzero(~np.isnan(x))
    if not len(seen):
        return [len(x), 0, len(x), len(x), 0.0, 1.0, 0.0]
    old = (1 - alpha) ** np.diff(seen).astype(float)
    factor, first = float(np.prod(old / (old + alpha))), float(x[seen[0]])
    return [len(x), len(seen), int(seen[0]), int(len(x) - 1 - seen[-1]), first, factor, float(_ewm(x[seen[0] :], alpha)[-1]) - factor * first]


def _advance(state: list, summary: list, alpha: float) -> list:
    """state: the mean, the rows since its last value, the values so far."""
    (mean, gap, n), (rows, values, lead, tail, first, factor, addend) = state, summary
    if not values:
        return [mean, gap + rows, n]
    begun = _joined(mean, gap + lead + 1, first, alpha) if n else first
    return [factor * begun + addend, tail, n + values]


def _values(x: np.ndarray, state: list, alpha: float, warm_up: int) -> np.ndarray:
    mean, gap, n = state
    seen = np.flatnonzero(~np.isnan(x))
    out = np.full(len(x), mean if n else np.nan)
    if len(seen):
        at = seen[0]
        rest = x[at:].copy()
        if n:
            rest[0] = _joined(mean, gap + at + 1, rest[0], alpha)
        out[at:] = _ewm(rest, alpha)
    out[n + np.cumsum(~np.isnan(x)) < max(warm_up, 1)] = np.nan
    return out


def smooth(rows: DataFrame, means: list[Mean], key: str | list[str] = "symbol", order: str = "dt", cut: Pieces | None = None) -> DataFrame:
    """Adds exponential means that begin with the first value; missing values are passed over, and make no mean before the first one.

    cut: how the series are cut, where that is known already.
    """
    means = list(dict.fromkeys(means))
    if not means:
        return rows
    none = [[0.0, 0, 0] for _ in means]
    of = lambda piece: [piece[source].to_numpy(float, na_value=np.nan) for _, source, *_ in means]

    def run(piece: pd.DataFrame, state: list | None) -> pd.DataFrame:
        made = {name: _values(x, s, alpha, warm_up) for x, s, (name, _, alpha, warm_up) in zip(of(piece), state or none, means, strict=True)}
        return piece.assign(**made)

    kinds = [f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{name}` double" for name, *_ in means]
    return scan(
        rows,
        cut or pieces(rows, key, order),
        lambda piece: [_summary(x, alpha) for x, (_, _, alpha, _) in zip(of(piece), means, strict=True)],
        lambda state, summary: [_advance(s, x, alpha) for s, x, (_, _, alpha, _) in zip(state or none, summary, means, strict=True)],
        run,
        ", ".join(kinds),
    )


def ema(n: int) -> Mean:
    return f"_ema_{n}", "close", 2 / (n + 1), n


def wilder(source: str, n: int) -> Mean:
    return f"{source}_{n}", source, 1 / n, n


#: First means of each kind, those of a second pass (with the column that they smooth), and the value.
FIRST = {
    "ema": lambda n: [ema(n)],
    "rsi": lambda n: [wilder("_up", n), wilder("_down", n)],
    "macd": lambda n: [ema(12), ema(n)],
    "macd_signal": lambda n: [ema(12), ema(26)],
    "atr": lambda n: [wilder("_range", n)],
    "adx": lambda n: [wilder("_plus", n), wilder("_minus", n), wilder("_range", n)],
}
LINE = {
    "macd_signal": lambda n: F.col("_ema_12") - F.col("_ema_26"),
    "adx": lambda n: 100 * F.try_divide(F.abs(F.col(f"_plus_{n}") - F.col(f"_minus_{n}")), F.col(f"_plus_{n}") + F.col(f"_minus_{n}")),
}
SECOND = {"macd_signal": lambda n: ("_signal_line", 2 / (n + 1), 0), "adx": lambda n: (f"_adx_line_{n}", 1 / n, n)}
VALUE = {
    "ema": lambda n: F.col(f"_ema_{n}"),
    "rsi": lambda n: F.when(F.col(f"_up_{n}").isNull(), None).when(F.col(f"_down_{n}") == 0, 100.0).otherwise(100 - 100 / (1 + F.col(f"_up_{n}") / F.col(f"_down_{n}"))),
    "macd": lambda n: F.col("_ema_12") - F.col(f"_ema_{n}"),
    "macd_signal": lambda n: F.col(f"_mean_macd_signal_{n}"),
    "atr": lambda n: F.col(f"_range_{n}"),
    "adx": lambda n: F.col(f"_mean_adx_{n}"),
}


def moves(bars: DataFrame, cut: Pieces, wanted: set[str]) -> DataFrame:
    """Adds changes that are smoothed: up and down closes, the true range, and the larger of up and down moves of highs and lows."""
    if not wanted & {"_up", "_down", "_range", "_plus", "_minus"}:
        return bars
    lag = lambda c: F.col(f"_before_{c}")
    change, high, low = F.col("close") - lag("close"), F.col("high") - lag("high"), lag("low") - F.col("low")
    made = {
        "_up": F.greatest(change, F.lit(0.0)) + 0 * change,
        "_down": F.greatest(-change, F.lit(0.0)) + 0 * change,
        "_range": Series.range_from(lag("close")),
        "_plus": F.when((high > low) & (high > 0), high).otherwise(0.0),
        "_minus": F.when((low > high) & (low > 0), low).otherwise(0.0),
    }
    names = ["close"] if wanted <= {"_up", "_down"} else ["close", "high", "low"]
    rows = before(cut.cut(bars), cut, names)
    return rows.withColumns({c: x for c, x in made.items() if c in wanted}).drop(PIECE, *(f"_before_{c}" for c in names))


def with_recursive(bars: DataFrame, asked: list[tuple[str, int]], key: str | list[str] = "symbol", cut: Pieces | None = None) -> DataFrame:
    """Adds a column kind_n for each indicator asked for."""
    asked = list(dict.fromkeys(asked))
    first = [m for kind, n in asked for m in FIRST[kind](n)]
    cut = cut or pieces(bars, key)
    rows = smooth(moves(bars, cut, {m[1] for m in first}), first, cut=cut)
    later = [(kind, n) for kind, n in asked if kind in SECOND]
    if later:
        rows = rows.withColumns({SECOND[kind](n)[0]: LINE[kind](n) for kind, n in later})
        rows = smooth(rows, [(f"_mean_{kind}_{n}", *SECOND[kind](n)) for kind, n in later], cut=cut)
    return rows.select(*bars.columns, *(VALUE[kind](n).alias(f"{kind}_{n}") for kind, n in asked))
