"""Partitioned Parquet and JSON stores: merges are DataFrame work, writers replace the partitions they touch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last by `order`."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*key, "row.*").select(*rows.columns)


def merged(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new rows, the new one where both have a key; columns that one side lacks are NULL."""
    tagged = new.withColumn("_age", F.lit(1))
    if old is not None:
        tagged = old.withColumn("_age", F.lit(0)).unionByName(tagged, allowMissingColumns=True)
    return newest(tagged, key, ["_age"]).drop("_age")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What is stored, None where there is nothing yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def upsert(rows: DataFrame, path: str, key: list[str], partitions: list[str]) -> None:
    """Merges rows into a partitioned table; only the partitions that they fall in are read and replaced.

    The merged rows are checkpointed first, since a job must not read what it replaces. The partitions' names are few: days and symbols of a batch.
    """
    spark = rows.sparkSession
    old = stored(spark, path)
    touched = rows.select(*partitions).distinct()
    if old is not None:
        kinds = dict(rows.dtypes)
        old = old.withColumns({p: F.col(p).cast(kinds[p]) for p in partitions}).join(F.broadcast(touched), partitions, "left_semi")
    merged(old, rows, key).checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


class TickStore:
    """Minute bars and raw ticks, by symbol and day."""

    def __init__(self, path: str):
        self.bars, self.segments = f"{path}/bars", f"{path}/ticks"

    def write_bars(self, bars: DataFrame) -> None:
        """bars: symbol, minute, ...; of bars of one minute the last one written stays."""
        upsert(bars.withColumn("day", F.to_date("minute")), self.bars, ["symbol", "minute"], ["symbol", "day"])

    def write_tick_segment(self, ticks: DataFrame) -> None:
        ticks.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(self.segments)

    def read_bars(self, spark: SparkSession, symbol: str, day: str | None = None) -> DataFrame:
        found = spark.read.parquet(self.bars).where(F.col("symbol") == symbol)
        return (found if day is None else found.where(F.col("day") == F.lit(day).cast("date"))).orderBy("minute")

    def sink(self, batch: DataFrame, _: int) -> None:
        """For foreachBatch of a stream of bars."""
        self.write_bars(batch)


class ChainStore:
    """Chain snapshots by symbol and day: a snapshot is stored once, and what a model made is refused."""

    def __init__(self, path: str):
        self.path = f"{path}/chains"

    def snapshot(self, chain: DataFrame) -> DataFrame:
        """Appends what is not stored yet; gives it back."""
        fresh = chain.where("NOT is_model") if "is_model" in chain.columns else chain
        fresh = fresh.withColumn("day", F.to_date("ts"))
        old = stored(chain.sparkSession, self.path)
        if old is not None:
            fresh = fresh.join(old.select("symbol", "ts", "expiry").distinct(), ["symbol", "ts", "expiry"], "left_anti").checkpoint()
        fresh.write.mode("append").partitionBy("symbol", "day").parquet(self.path)
        return fresh

    def write_day_snapshot(self, chain: DataFrame, symbol: str, day: str) -> bool:
        """Stores a day's chain once; False where the day is stored already."""
        old = stored(chain.sparkSession, self.path)
        if old is not None and not old.where((F.col("symbol") == symbol) & (F.col("day") == F.lit(day).cast("date"))).isEmpty():
            return False
        chain.withColumns({"symbol": F.lit(symbol), "day": F.lit(day).cast("date")}).write.mode("append").partitionBy("symbol", "day").parquet(self.path)
        return True

    def snapshots_of(self, spark: SparkSession, symbol: str, day: str) -> DataFrame:
        return spark.read.parquet(self.path).where((F.col("symbol") == symbol) & (F.col("day") == F.lit(day).cast("date")))


class HistoryArchive:
    """Daily bars by symbol with where they are from and when they were captured; made-up sources are refused."""

    def __init__(self, path: str):
        self.path = f"{path}/history"

    def upsert(self, bars: DataFrame, source: str) -> None:
        if source == "synthetic":
            raise ValueError("synthetic bars are not archived")
        rows = bars.withColumns({"dt": F.to_date("dt"), "source": F.lit(source), "captured_at": F.current_timestamp()})
        upsert(rows, self.path, ["symbol", "dt"], ["symbol"])

    def read(self, spark: SparkSession, symbol: str) -> DataFrame:
        return spark.read.parquet(self.path).where(F.col("symbol") == symbol).orderBy("dt")


class Journal:
    """A JSON document for each symbol and day, written once; what cannot be read is NULL."""

    def __init__(self, path: str):
        self.path = f"{path}/journal"

    def write(self, entries: DataFrame) -> None:
        """entries: symbol, day and the columns of the document; days that are stored stay as they are."""
        old = stored(entries.sparkSession, self.path)
        rows = entries.select("symbol", "day", F.to_json(F.struct(*(c for c in entries.columns if c not in ("symbol", "day")))).alias("document"))
        if old is not None:
            rows = rows.join(old.select("symbol", "day"), ["symbol", "day"], "left_anti").checkpoint()
        rows.write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.parquet(self.path).select("symbol", "day", F.from_json("document", schema).alias("entry"))


LEDGER = "cash double, positions map<string,double>, journal array<struct<seq:long,side:string,qty:double,price:double>>"


def save_ledger(spark: SparkSession, path: str, name: str, cash: float, positions: DataFrame, journal: DataFrame, last: int = 500) -> None:
    """A portfolio as one JSON row: its cash, net quantities, and the last entries of its journal."""
    rows = journal.orderBy(F.desc("seq")).limit(last)  # the feature: a short history
    entries = rows.agg(F.sort_array(F.collect_list(F.struct("seq", "side", "qty", "price"))).alias("journal"))
    held = positions.agg(F.map_from_entries(F.collect_list(F.struct("instrument", "net"))).alias("positions"))
    doc = entries.crossJoin(held).select(F.lit(name).alias("name"), F.to_json(F.struct(F.lit(cash).alias("cash"), "positions", "journal")).alias("document"))
    doc.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/{name}")


def load_ledger(spark: SparkSession, path: str, name: str) -> DataFrame:
    """cash, positions, journal; an empty book where none is stored or it cannot be read."""
    empty = spark.range(1).select(F.lit(0.0).alias("cash"), F.create_map().cast("map<string,double>").alias("positions"), F.array().cast("array<struct<seq:long,side:string,qty:double,price:double>>").alias("journal"))
    found = stored(spark, f"{path}/ledger/{name}")
    if found is None:
        return empty
    read = found.select(F.from_json("document", LEDGER).alias("d")).where("d.cash IS NOT NULL").select("d.*")
    return empty if read.isEmpty() else read


def save_alerts(alerts: DataFrame, path: str) -> None:
    """Alert rules (symbol, metric, op, level, armed, fired_at) as JSON rows."""
    alerts.select(F.to_json(F.struct("*")).alias("value")).checkpoint().write.mode("overwrite").text(f"{path}/alerts")


def load_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Rules that can be read."""
    schema = "symbol string, metric string, op string, level double, armed boolean, fired_at timestamp"
    return spark.read.text(f"{path}/alerts").select(F.from_json("value", schema).alias("a")).where("a.symbol IS NOT NULL").select("a.*")


def quarantined(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (column value) that can be read, and the lines that cannot."""
    read = lines.withColumn("r", F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})).checkpoint()
    return read.where("r._broken IS NULL").select("r.*").drop("_broken"), read.where("r._broken IS NOT NULL").select("value")


def last_row_snapshot(rows: DataFrame) -> DataFrame:
    """Rows of the newest ts of each symbol and day."""
    w = Window.partitionBy("symbol", "day")
    return rows.withColumn("last", F.max("ts").over(w)).where("ts = last").drop("last")
