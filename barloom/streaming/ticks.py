"""Tick streams: a file source, minute bars that close by watermark, the newest value of each key, routing to clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tick_stream(spark: SparkSession, folder: str, schema: StructType | str, files: int = 16) -> DataFrame:
    """Ticks of Parquet files as they arrive in a folder, `files` for each batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def minute_bars(ticks: DataFrame, late: str = "1 minute") -> DataFrame:
    """Bars of ticks (symbol, ts, ltp, cum_volume, event_id). In append mode a bar is handed over once, when the watermark has passed its
    minute; ticks later than that are dropped by Spark. On a batch, the bars of all ticks."""
    of = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 minute"))
    bars = of.agg(F.min_by("ltp", "event_id").alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", "event_id").alias("close"), F.greatest(F.max("cum_volume") - F.min("cum_volume"), F.lit(0)).alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("minute"), "open", "high", "low", "close", "volume")


def latest(ticks: DataFrame) -> DataFrame:
    """The newest tick of each symbol, for update or complete mode."""
    return ticks.groupBy("symbol").agg(F.max("event_id").alias("event_id"), F.max_by("ltp", "event_id").alias("ltp"))


def routed(ticks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Every tick once for each client (client, symbol) that asked for its symbol."""
    return ticks.join(subscriptions.dropDuplicates(["client", "symbol"]), "symbol").select("client", "event_id", "symbol", "ltp")


def snapshots_once(chains: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows of chain snapshots (ts, expiry, strike), each once: what is sent again within the watermark is dropped."""
    return chains.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ts", "expiry", "strike"])


def alerts_met(ticks: DataFrame, alerts: DataFrame, late: str = "1 day") -> DataFrame:
    """Ticks that meet an alert (symbol, level, above); an alert fires once within the watermark."""
    met = F.when(F.col("above"), F.col("ltp") >= F.col("level")).otherwise(F.col("ltp") <= F.col("level"))
    hits = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).join(F.broadcast(alerts), "symbol").where(met)  # alerts are a user's own
    return hits.dropDuplicatesWithinWatermark(["symbol", "level"]).select("symbol", "level", "event_id", "ltp")
