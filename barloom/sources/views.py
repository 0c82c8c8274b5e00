"""Market tables derived from the input tables: bars, ticks, option chain, participants, headlines, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the attributes of their part."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("px", F.col("p_retailprice") * (1 - F.col("l_discount")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, dt, open, high, low, close, volume: a row for each symbol and day. Open and close follow the trade order."""
    order = F.struct(*TIES)
    return (
        trades(spark, sf_dir)
        .groupBy(F.col("p_type").alias("symbol"), F.to_date("l_shipdate").alias("dt"))
        .agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("symbol"), (100 + F.col("value")).alias("ltp"), (F.row_number().over(day) * 10).cast("long").alias("cum_volume"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, expiry, strike, spot, call_oi, put_oi, call_ltp, put_ltp: a row for each snapshot and strike."""
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    side = lambda flag: F.col("l_returnflag") == flag
    rows = trades(spark, sf_dir).groupBy(month.alias("ts"), F.last_day(month).alias("expiry"), (900 + 2 * F.col("p_size")).alias("strike")).agg(
        F.avg("px").alias("spot"),
        F.sum(F.when(side("A"), F.col("l_quantity")).otherwise(0)).alias("call_oi"),
        F.sum(F.when(side("R"), F.col("l_quantity")).otherwise(0)).alias("put_oi"),
        F.avg(F.when(side("A"), F.col("l_extendedprice") / 1000)).alias("call_ltp"),
        F.avg(F.when(side("R"), F.col("l_extendedprice") / 1000)).alias("put_ltp"),
    )
    return rows.withColumn("strike", F.col("strike").cast("double")).withColumn("spot", F.avg("spot").over(Window.partitionBy("ts")))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("dt"), F.col("o_orderpriority").alias("client_type")).agg((status("O") - status("F")).alias("idx_fut_net"), status("P").alias("idx_opt_net"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of a document is the first 200 characters of its text, the body the whole of it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("title"), F.col("text").alias("body"), "source", "lang")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy("l_shipdate", *TIES)
    return trades(spark, sf_dir).select(F.col("p_brand").alias("instrument"), F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").alias("qty"), F.col("px").alias("price"), F.row_number().over(order).cast("long").alias("seq"))


#: The same tables in DuckDB SQL, as named subqueries.
BARS = """bars AS (SELECT symbol, dt, min_by(px, ord) AS open, max(px) AS high, min(px) AS low, max_by(px, ord) AS close, sum(qty) AS volume
  FROM (SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS dt, p_retailprice * (1 - l_discount) AS px, l_quantity AS qty,
    row_number() OVER (PARTITION BY p_type, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord
    FROM lineitem JOIN part ON l_partkey = p_partkey) t GROUP BY symbol, dt)"""
TICKS = """ticks AS (SELECT event_id, ts, event_type AS symbol, 100 + value AS ltp,
  row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) * 10 AS cum_volume FROM events)"""
CHAIN = """chain AS (SELECT ts, expiry, CAST(strike AS DOUBLE) AS strike, avg(spot) OVER (PARTITION BY ts) AS spot, call_oi, put_oi, call_ltp, put_ltp
  FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, last_day(CAST(date_trunc('month', l_shipdate) AS DATE)) AS expiry,
    900 + 2 * p_size AS strike, avg(p_retailprice * (1 - l_discount)) AS spot,
    sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS call_oi, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS put_oi,
    avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice / 1000 END) AS call_ltp, avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice / 1000 END) AS put_ltp
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) t)"""
PARTICIPANTS = """participants AS (SELECT CAST(o_orderdate AS DATE) AS dt, o_orderpriority AS client_type,
  CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) - sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS idx_fut_net,
  CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS idx_opt_net FROM orders GROUP BY 1, 2)"""
HEADLINES = "headlines AS (SELECT doc_id, substring(text, 1, 200) AS title, text AS body, source, lang FROM documents)"
FILLS = """fills AS (SELECT p_brand AS instrument, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS qty,
  p_retailprice * (1 - l_discount) AS price,
  row_number() OVER (PARTITION BY p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
