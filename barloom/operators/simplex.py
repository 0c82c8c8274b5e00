"""Simplex search for the least points of many functions at once, and smiles of many snapshots fitted by it.

Every task takes its snapshots in blocks: their smiles are rows of padded arrays and each step moves all simplexes that have not settled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAP = ["ts", "expiry"]
BLOCK = 1024  # smiles that a task fits at once
#: Fixed start of rho and nu, and what is worth a warning.
RHO, NU, PINNED, WILD, SPARSE = -0.3, 0.6, 0.95, 3.0, 0.5
WARNINGS = ("rho is at its bound", "vol of vol is very high", "fitted on less than half of the strikes")


def least_points(loss: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, iters: int = 400, tol: float = 1e-12, size: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Points (functions, n) and values. loss(which, points): values of the functions numbered `which`, each at its point.

    A simplex settles when its values differ by less than `tol`, or after `iters` steps. Values that are not finite count as 1e9.
    """
    n_functions, n = start.shape
    every = np.arange(n_functions)

    def value(which: np.ndarray, points: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            v = loss(which, points)
        return np.where(np.isfinite(v), v, 1e9)

    corners = start[:, None, :] + size * np.concatenate([np.zeros((1, n)), np.eye(n)])
    values = np.stack([value(every, corners[:, c]) for c in range(n + 1)], axis=1)
    open_ = every
    for _ in range(iters):
        rank = np.argsort(values[open_], axis=1, kind="stable")
        corners[open_] = np.take_along_axis(corners[open_], rank[:, :, None], axis=1)
        values[open_] = np.take_along_axis(values[open_], rank, axis=1)
        open_ = open_[values[open_, -1] - values[open_, 0] >= tol]
        if not len(open_):
            break
        p, v = corners[open_], values[open_]
        middle = p[:, :-1].mean(axis=1)
        way = middle - p[:, -1]
        moved, at = middle + way, value(open_, middle + way)
        for asked, reach, limit in ((at < v[:, 0], 2.0, at), (at >= v[:, -2], -0.5, v[:, -1])):
            rows = np.flatnonzero(asked)
            if len(rows):
                other = middle[rows] + reach * way[rows]
                got = value(open_[rows], other)
                better = got < limit[rows]
                moved[rows[better]], at[rows[better]] = other[better], got[better]
                asked[rows[better]] = False
        stuck = asked  # neither the reflection nor the contraction is any good: the simplex shrinks to its best corner
        corners[open_[~stuck], -1], values[open_[~stuck], -1] = moved[~stuck], at[~stuck]
        some = open_[stuck]
        if len(some):
            corners[some, 1:] = corners[some, :1] + 0.5 * (corners[some, 1:] - corners[some, :1])
            for c in range(1, n + 1):
                values[some, c] = value(some, corners[some, c])
    best = values.argmin(axis=1)
    return corners[every, best], values[every, best]


def sabr(p: np.ndarray, f: np.ndarray, k: np.ndarray, t: np.ndarray, beta: float) -> np.ndarray:
    """IVs (smiles, strikes) of points (ln alpha, atanh rho, ln nu) of each smile; f and t of each smile."""
    alpha, rho, nu = np.exp(p[:, :1]), np.tanh(p[:, 1:2]), np.exp(p[:, 2:])
    f, t, one = f[:, None], t[:, None], 1 - beta
    log, mean = np.log(f / k), (f * k) ** (one / 2)
    z = nu / alpha * mean * log
    small = np.abs(z) < 1e-6
    x = np.log((np.sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho))
    ratio = np.where(small, 1 - rho * z / 2, z / np.where(small, 1, x))
    later = one**2 / 24 * alpha**2 / mean**2 + 0.25 * rho * beta * nu * alpha / mean + (2 - 3 * rho**2) / 24 * nu**2
    return alpha / (mean * (1 + one**2 / 24 * log**2 + one**4 / 1920 * log**4)) * ratio * (1 + later * t)


def sabr_fits(rows: DataFrame, beta: float = 0.5, least: int = 6, most: float = 0.35, iters: int = 400, tol: float = 1e-12) -> DataFrame:
    """ts, expiry, alpha, rho, nu, loss, rmse (vol points), n, n_available, warnings of each snapshot's smile: rows f, k, t, iv, w.

    Least weighted squares. Quotes without an IV above 1e-4, without a strike above 0 or farther than `most` in log moneyness from the
    forward are left out, and snapshots with fewer than `least` others have no fit. f and t are a snapshot's; weights that are null or below
    0 are 0, and if all are, quotes weigh alike. Rows with a column is_model that is true are no quotes and are left out. A snapshot
    is one small row: its strikes.
    """
    import pandas as pd

    quotes = rows.where(~F.coalesce("is_model", F.lit(False))) if "is_model" in rows.columns else rows
    iv, k = F.col("iv").cast("double"), F.col("k").cast("double")
    usable = (iv > 1e-4) & (iv < float("inf")) & (k > 0) & (F.abs(F.ln(F.col("f") / k)) <= most)
    quote = F.struct(k.alias("k"), iv.alias("iv"), F.greatest(F.coalesce(F.col("w").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    smiles = quotes.groupBy(*SNAP).agg(F.min("f").cast("double").alias("f"), F.min("t").cast("double").alias("t"), F.array_sort(F.collect_list(F.when(usable, quote))).alias("q"), F.count(F.lit(1)).alias("n_available"))
    smiles = smiles.withColumn("n", F.size("q").cast("long")).where(F.col("n") >= least)
    smiles = smiles.select(*SNAP, "f", "t", "n", "n_available", "q.k", "q.iv", "q.w")

    def fit(block: pd.DataFrame) -> pd.DataFrame:
        f, t, n = block["f"].to_numpy(float), block["t"].to_numpy(float), block["n"].to_numpy(int)
        there = np.arange(n.max()) < n[:, None]
        k, iv, w = (np.zeros(there.shape) for _ in range(3))
        for to, c in ((k, "k"), (iv, "iv"), (w, "w")):
            to[there] = np.concatenate(block[c].to_list())
        k[~there] = np.repeat(f, there.shape[1] - n)
        sums = w.sum(axis=1, keepdims=True)
        w = np.where(sums > 0, w / np.where(sums > 0, sums, 1), there / n[:, None])
        near = np.where(there, np.abs(k - f[:, None]), np.inf).argmin(axis=1)
        start = np.stack([np.log(iv[np.arange(len(n)), near] * f ** (1 - beta)), np.full(len(n), np.arctanh(RHO)), np.full(len(n), np.log(NU))], axis=1)

        def loss(which: np.ndarray, p: np.ndarray) -> np.ndarray:
            return (w[which] * (sabr(p, f[which], k[which], t[which], beta) - iv[which]) ** 2).sum(axis=1)

        p, off = least_points(loss, start, iters, tol)
        rho, nu = np.tanh(p[:, 1]), np.exp(p[:, 2])
        error = np.where(there, 100 * (sabr(p, f, k, t, beta) - iv), 0)
        signs = np.stack([np.abs(rho) > PINNED, nu > WILD, n < SPARSE * block["n_available"].to_numpy()], axis=1)
        return block[SNAP].assign(alpha=np.exp(p[:, 0]), rho=rho, nu=nu, loss=off, rmse=np.sqrt((error**2).sum(axis=1) / n), n=n, n_available=block["n_available"], warnings=[[x for x, s in zip(WARNINGS, row, strict=True) if s] for row in signs])

    def blocks(frames):
        for frame in frames:
            for i in range(0, len(frame), BLOCK):
                yield fit(frame.iloc[i : i + BLOCK])

    kinds = dict(rows.dtypes)
    return smiles.mapInPandas(blocks, f"ts {kinds['ts']}, expiry {kinds['expiry']}, alpha double, rho double, nu double, loss double, rmse double, n long, n_available long, warnings array<string>")
