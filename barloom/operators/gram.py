"""Correlations of many series from blocked products: days x symbols in tiles, no row for a pair of symbols on a day.

Symbols are numbered and cut into tiles of TILE, days into slices of SLICE. A block is a dense matrix of a slice and a tile; each pair of tiles of a
slice meets once, and products of matrices and of their masks give the sums of all its symbol pairs. Blocks of a pair of tiles are added
up as they come, so a task holds one pair of tiles, however many days there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE, SLICE = 128, 256
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over the days that both have, for each pair of columns; NaN is a day that a series lacks."""
    m, k = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(m, a, 0.0), np.where(k, b, 0.0)
    m, k = m.astype(float), k.astype(float)
    return np.stack([m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y])


def gram(returns: DataFrame, tile: int = TILE, days: int = SLICE) -> DataFrame:
    """a, b (a before b, or the same), n, corr and cov (of samples) over the days both have, of returns (symbol, dt, r).

    NULL returns are days that a series lacks, of rows of one symbol and day one counts. corr is NULL with fewer than two days or where a series does not move, cov with fewer than two days.
    """
    named = returns.select("symbol").where("symbol IS NOT NULL").distinct().withColumn("i", F.row_number().over(Window.orderBy("symbol")) - 1)  # a row for each symbol
    day = F.unix_date(F.to_date("dt"))
    placed = returns.where("r IS NOT NULL").join(named, "symbol").select(F.floor(day / days).cast("long").alias("slice"), F.pmod(day, F.lit(days)).cast("int").alias("d"), F.floor(F.col("i") / tile).cast("int").alias("tile"), (F.col("i") % tile).cast("int").alias("s"), F.col("r").cast("double").alias("r"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        block = np.full((days, tile), np.nan)
        block[rows["d"].to_numpy(), rows["s"].to_numpy()] = rows["r"].to_numpy()
        return rows[["slice", "tile"]].head(1).assign(block=[block.tobytes()])

    blocks = placed.groupBy("slice", "tile").applyInPandas(pack, "slice long, tile int, block binary")
    a, b = (blocks.select("slice", F.col("tile").alias(f"t{x}"), F.col("block").alias(x)) for x in "ab")
    met = a.join(b, "slice").where("ta <= tb").select("ta", "tb", "a", "b").repartition("ta", "tb").sortWithinPartitions("ta", "tb")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            for ta, tb, x, y in zip(*(batch.column(c) for c in ("ta", "tb", "a", "b")), strict=True):
                here = ta.as_py(), tb.as_py()
                if here != at and at is not None:
                    yield rows_of(at, sums)
                if here != at:
                    at, sums = here, np.zeros((6, tile, tile))
                sums += products(*(np.frombuffer(m.as_buffer(), float).reshape(days, tile) for m in (x, y)))
        if at is not None:
            yield rows_of(at, sums)

    def rows_of(at: tuple[int, int], sums: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(sums[0])
        if at[0] == at[1]:
            i, j = i[i <= j], j[i <= j]
        ids = {"i": pa.array(at[0] * tile + i, pa.int32()), "j": pa.array(at[1] * tile + j, pa.int32())}
        return pa.record_batch({**ids, **{c: pa.array(sums[k, i, j]) for k, c in enumerate(SUMS)}})

    found = met.mapInArrow(add, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    n, spread = F.col("n"), lambda x, y, xy: F.col(xy) - F.col(x) * F.col(y) / F.col("n")
    both = spread("sa", "sb", "sab")
    scale = F.sqrt(F.greatest(spread("sa", "sa", "saa"), F.lit(0.0)) * F.greatest(spread("sb", "sb", "sbb"), F.lit(0.0)))
    found = found.select("i", "j", n.cast("long").alias("n"), F.when(n > 1, F.try_divide(both, scale)).alias("corr"), F.when(n > 1, both / (n - 1)).alias("cov"))
    name = lambda x, c: named.select(F.col("i").alias(x), F.col("symbol").alias(c))
    return found.join(name("i", "a"), "i").join(name("j", "b"), "j").select("a", "b", "n", "corr", "cov")
