"""Recursive series of any length, in pieces: each piece is a task's work, and only states go from one piece to the next.

A series is cut at quantiles of its order column, so a piece has a bounded number of rows however long the series is.
Three ways to go on from piece to piece:

`scan` is for recurrences whose pieces can be summed up (linear ones): every piece makes a summary, the summaries of a series are
put together in order, a row for each piece, and every piece runs once more from the state that it begins with.

`hand_over` is for state machines. All pieces run from an assumed state; pieces whose predecessor ended otherwise run again,
until no assumption changes. A machine that forgets (a position is closed, both runs are flat) needs two or three rounds, the
worst case as many as a series has pieces.

`relay` is for state machines that do not forget, so that an assumed state is of no use. Pieces run one after another, those of all
series together; each piece is read once and run once.

Series of PIECE_ROWS rows or less are one piece, and nothing is saved or joined for them.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE_ROWS = 250_000
#: Bounds are one expression; beyond this many pieces of a series, pieces grow.
MOST_PIECES = 1000
PIECE = "_piece"


def shared(df: DataFrame) -> str:
    """The folder that the cluster names for checkpoints; a local one is made only where none is set on a local master."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """Rows kept in the folder for checkpoints."""
    shared(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Rows kept as files in a shared folder, with a folder for each value of `by`, of which a filter on it reads only its own."""
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Pieces:
    """How series are cut: the number of a row's piece, and whether there are more than one."""

    key: list[str]
    order: str
    number: Column
    many: bool
    count: int = 1

    @property
    def by(self) -> list[str]:
        return [*self.key, PIECE]

    def cut(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PIECE, self.number)


def _number(order: str, kind: str) -> Column:
    return {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, F.col)(F.col(order) if kind in ("date", "timestamp") else order)


def longest(rows: DataFrame, key: list[str]) -> int:
    """Rows of the longest series."""
    return rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0


def pieces(rows: DataFrame, key: str | list[str] = "symbol", order: str = "dt", most: int | None = None) -> Pieces:
    """Cuts at quantiles of all rows' places, so many that the longest series has about `most` rows a piece. Equal places share a piece."""
    key, most = [key] if isinstance(key, str) else key, most or PIECE_ROWS
    place = _number(order, dict(rows.dtypes)[order])
    n = min(MOST_PIECES, -(-longest(rows, key) // most))
    if n < 2:
        return Pieces(key, order, F.lit(0), False)
    found = rows.select(place.alias("at")).agg(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n)).first()[0]
    bounds = sorted(set(found))

    def tree(low: int, high: int) -> Column:
        """How many bounds lie below, by halves."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(place < bounds[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return Pieces(key, order, tree(0, len(bounds)), True, len(bounds) + 1)


def _kinds(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def scan(rows: DataFrame, cut: Pieces, summarise: Callable[[pd.DataFrame], object], advance: Callable[[object, object], object], run: Callable[[pd.DataFrame, object], pd.DataFrame], schema: str) -> DataFrame:
    """run(piece, state) of every piece in order, as rows of schema.

    summarise(piece) gives a summary, advance(state, summary) the state behind the piece; both are plain lists of numbers. A series begins with None.
    """
    order, by = cut.order, cut.by
    if not cut.many:
        return rows.groupBy(*cut.key).applyInPandas(lambda piece: run(piece.sort_values(order), None), schema)
    named, head = cut.cut(rows), _kinds(rows, cut.key)
    named = kept(named)

    def summary(piece: pd.DataFrame) -> pd.DataFrame:
        return piece[by].head(1).assign(said=json.dumps(summarise(piece.sort_values(order))))

    def states(series: pd.DataFrame) -> pd.DataFrame:
        state, made = None, []
        series = series.sort_values(PIECE)
        for said in series["said"]:
            made.append(None if state is None else json.dumps(state))
            state = advance(state, json.loads(said))
        return series[by].assign(state=made)

    summaries = named.groupBy(*by).applyInPandas(summary, f"{head}, {PIECE} int, said string")
    begun = summaries.groupBy(*cut.key).applyInPandas(states, f"{head}, {PIECE} int, state string")

    def go(piece: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return run(piece.sort_values(order).drop(columns=PIECE), _loaded(state["state"]))

    return named.groupBy(*by).cogroup(begun.groupBy(*by)).applyInPandas(go, schema)


def _loaded(states: pd.Series) -> object:
    said = states.iloc[0] if len(states) else None
    return json.loads(said) if isinstance(said, str) else None


def hand_over(rows: DataFrame, cut: Pieces, run: Callable[[pd.DataFrame, object, bool], tuple[pd.DataFrame, object]], schema: str) -> DataFrame:
    """run(piece, state, last) -> (rows of schema, the state behind the piece), of every piece in order; last: no piece follows.

    rows has the column PIECE already. States are plain lists and dictionaries; a series begins with None.
    """
    order, by = cut.order, cut.by
    if not cut.many:
        return rows.groupBy(*cut.key).applyInPandas(lambda piece: run(piece.sort_values(order).drop(columns=PIECE), None, True)[0], schema)
    rows, head = kept(rows), _kinds(rows, cut.key)
    w = Window.partitionBy(*cut.key).orderBy(PIECE)  # a row for each piece
    same = " AND ".join(f"a.`{c}` <=> b.`{c}`" for c in by)

    def end(piece: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        if not len(begun):  # not to be run in this round
            return begun[by].assign(ended=None)
        state = run(piece.sort_values(order).drop(columns=PIECE), _loaded(begun["state"]), bool(begun["last"].iloc[0]))[1]
        return piece[by].head(1).assign(ended=json.dumps(state))

    names = rows.select(*by).distinct()
    begun = kept(names.select(*by, F.lit(None).cast("string").alias("state"), F.lead(PIECE).over(w).isNull().alias("last")))
    changed, ended = begun, None
    while True:
        todo = rows.alias("a").join(changed.select(*by).alias("b"), F.expr(same), "left_semi") if ended is not None else rows
        new = todo.groupBy(*by).cogroup(changed.groupBy(*by)).applyInPandas(end, f"{head}, {PIECE} int, ended string")
        ended = kept(new if ended is None else ended.alias("a").join(changed.alias("b"), F.expr(same), "left_anti").unionByName(new))
        now = kept(ended.select(*by, F.lag("ended").over(w).alias("state"), F.lead(PIECE).over(w).isNull().alias("last")))
        changed = now.alias("a").join(begun.alias("b"), F.expr(f"{same} AND a.state <=> b.state"), "left_anti")
        begun, changed = now, kept(changed)
        if changed.isEmpty():
            break

    def go(piece: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        return run(piece.sort_values(order).drop(columns=PIECE), _loaded(begun["state"]), bool(begun["last"].iloc[0]))[0]

    return rows.groupBy(*by).cogroup(begun.groupBy(*by)).applyInPandas(go, schema)


def relay(rows: DataFrame, cut: Pieces, run: Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]], schema: str) -> DataFrame:
    """run(piece, state) -> (rows of schema, the state behind the piece), of every piece in order. schema has the key.

    rows has the column PIECE already. A round runs the pieces of one number, of all series, and takes the states from the rows of
    the round before: each series' state stands in one of them, or in a row of its own if the series has no such piece.
    """
    key, order = cut.key, cut.order
    if not cut.many:
        return rows.groupBy(*key).applyInPandas(lambda piece: run(piece.sort_values(order).drop(columns=PIECE), None)[0], schema)
    folder, schema = f"{shared(rows)}/relay-{uuid.uuid4().hex}", f"{schema}, _row boolean, _state string"
    rows, names = stored(rows, f"{folder}/pieces", [PIECE]), StructType.fromDDL(schema).names

    def go(piece: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        if not len(piece):
            alone = begun.assign(_row=False).reindex(columns=names).astype(object)
            return alone.where(alone.notna(), None)
        made, state = run(piece.sort_values(order).drop(columns=PIECE), _loaded(begun["_state"]))
        return made.assign(_row=True, _state=[None] * (len(made) - 1) + [json.dumps(state)])

    states, paths = rows.where("false").select(*key, F.lit(None).cast("string").alias("_state")), []
    for number in range(cut.count):
        paths.append(f"{folder}/round={number}")
        new = rows.where(F.col(PIECE) == number).groupBy(*key).cogroup(states.groupBy(*key)).applyInPandas(go, schema)
        states = stored(new, paths[-1]).where("_state IS NOT NULL").select(*key, "_state")
    return rows.sparkSession.read.schema(schema).parquet(*paths).where("_row").drop("_row", "_state")


def before(rows: DataFrame, cut: Pieces, names: list[str]) -> DataFrame:
    """Adds _before_x of every named column: its value in the row before, over the borders of pieces too. rows has the column PIECE."""
    within = Window.partitionBy(*cut.by).orderBy(cut.order)
    rows = rows.withColumns({f"_before_{c}": F.lag(c).over(within) for c in names})
    if not cut.many:
        return rows
    w = Window.partitionBy(*cut.key).orderBy(PIECE)
    last = rows.groupBy(*cut.by).agg(F.max_by(F.struct(*names), cut.order).alias("x"))
    last = last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(cut.by)), F.lag("x").over(w).alias("_over"))
    same = F.expr(" AND ".join(f"`{c}` <=> _k{i}" for i, c in enumerate(cut.by)))
    rows = rows.withColumn("_first", F.row_number().over(within) == 1).join(last, same, "left")
    rows = rows.withColumns({f"_before_{c}": F.when(F.col("_first"), F.col("_over")[c]).otherwise(F.col(f"_before_{c}")) for c in names})
    return rows.drop("_first", "_over", *(f"_k{i}" for i in range(len(cut.by))))


def running(rows: DataFrame, cut: Pieces, make: Column, total: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """Adds a running fold of a series: `make` is the fold so far within a piece (over the window of the piece), `total` that of all its rows,
    fold(column) puts the totals of the pieces before together, join(before, within) both."""
    within = Window.partitionBy(*cut.by).orderBy(cut.order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, make.over(within))
    if not cut.many:
        return rows
    ahead = Window.partitionBy(*cut.key).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*cut.by).agg(total.alias("_total"))
    sums = sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(cut.by)), fold(F.col("_total")).over(ahead).alias("_ahead"))
    same = F.expr(" AND ".join(f"`{c}` <=> _k{i}" for i, c in enumerate(cut.by)))
    rows = rows.join(sums, same, "left").withColumn(name, F.when(F.col("_ahead").isNull(), F.col(name)).otherwise(join(F.col("_ahead"), F.col(name))))
    return rows.drop("_ahead", *(f"_k{i}" for i in range(len(cut.by))))


def numbered(rows: DataFrame, cut: Pieces, name: str = "k") -> DataFrame:
    """Adds the number of a row in its series, from 0."""
    count = F.count(F.lit(1))
    return running(rows, cut, count, count, F.sum, lambda a, b: a + b, name).withColumn(name, (F.col(name) - 1).cast("long"))
