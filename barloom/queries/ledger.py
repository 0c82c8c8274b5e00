"""Ledger, store, date and instrument queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import book
from ..sources.views import BARS, CHAIN, FILLS, PARTICIPANTS, TICKS, bars, chain, fills, participants, table, ticks
from . import query, rounded, rounded_sql

COST = """sum(price * qty) AS turn, sum(CASE WHEN side = 'SELL' THEN price * qty ELSE 0 END) AS sold, sum(CASE WHEN side = 'SELL' THEN 0 ELSE price * qty END) AS bought, count(*) AS n"""
PARTS = "20.0 * n AS brokerage, 0.001 * sold AS stt, 0.0003503 * turn AS exchange, 0.000001 * turn AS sebi, 0.00003 * bought AS stamp, 0.18 * (20.0 * n + 0.0003503 * turn + 0.000001 * turn) AS gst"
COSTED = f"{FILLS}, s AS (SELECT instrument, {COST} FROM fills GROUP BY 1), c AS (SELECT instrument, sold, {PARTS} FROM s), costs AS (SELECT *, brokerage + stt + exchange + sebi + stamp + gst AS total FROM c)"
MONEY = ("brokerage", "stt", "exchange", "sebi", "stamp", "gst", "total")
TURNED = "t AS (SELECT instrument, CASE side WHEN 'SELL' THEN 'BUY' ELSE 'SELL' END AS side, qty, price FROM fills UNION ALL SELECT instrument, side, qty, price FROM fills)"
TRIP = f"{FILLS}, {TURNED}, s AS (SELECT instrument, {COST} FROM t GROUP BY 1), c AS (SELECT instrument, {PARTS} FROM s), trip AS (SELECT *, brokerage + stt + exchange + sebi + stamp + gst AS total FROM c)"


@query("cost_of", rounded_sql(f"WITH {COSTED}\nSELECT instrument, {', '.join(MONEY)} FROM costs", *MONEY, digits=4))
def cost_of(spark, sf_dir: str) -> DataFrame:
    return rounded(book.costs(fills(spark, sf_dir), ["instrument"]), 4)


def trip(spark, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir)
    return book.costs(f.unionByName(book.closing(f)), ["instrument"])


@query("round_trip", rounded_sql(f"WITH {TRIP}\nSELECT instrument, {', '.join(MONEY)} FROM trip", *MONEY, digits=4))
def round_trip(spark, sf_dir: str) -> DataFrame:
    return rounded(trip(spark, sf_dir), 4)


@query("breakeven_edge", rounded_sql(f"WITH {TRIP}, cr AS (SELECT instrument, sum(CASE WHEN side = 'SELL' THEN price * qty END) AS credit FROM fills GROUP BY 1)\nSELECT instrument, total / nullif(credit, 0) AS edge FROM trip JOIN cr USING (instrument)", "edge", digits=9))
def breakeven_edge(spark, sf_dir: str) -> DataFrame:
    credit = fills(spark, sf_dir).where("side = 'SELL'").groupBy("instrument").agg(F.sum(F.col("price") * F.col("qty")).alias("credit"))
    return rounded(trip(spark, sf_dir).join(credit, "instrument", "left").select("instrument", F.try_divide("total", "credit").alias("edge")), 9)


@query("cost_pct_of_turnover", rounded_sql(f"WITH {COSTED}\nSELECT instrument, total / nullif(turn, 0) AS pct FROM costs JOIN s USING (instrument)", "pct", digits=9))
def cost_pct(spark, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir)
    turn = f.groupBy("instrument").agg(F.sum(F.col("price") * F.col("qty")).alias("turn"))
    return rounded(book.costs(f, ["instrument"]).join(turn, "instrument").select("instrument", F.try_divide("total", "turn").alias("pct")), 9)


@query("net_quantity", f"WITH {FILLS}\nSELECT instrument, CAST(sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS DOUBLE) AS net FROM fills GROUP BY 1")
def net_quantity(spark, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).groupBy("instrument").agg(F.sum(book.signed()).cast("double").alias("net"))


@query("portfolio_trade_cash", rounded_sql(f"WITH {FILLS}\nSELECT instrument, seq, sum(CASE side WHEN 'BUY' THEN -qty * price ELSE qty * price END) OVER (PARTITION BY instrument ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cash FROM fills", "cash", digits=4))
def portfolio_cash(spark, sf_dir: str) -> DataFrame:
    return rounded(book.running(fills(spark, sf_dir)).select("instrument", "seq", "cash"), 4)


@query("portfolio_buy_sufficient", f"WITH {FILLS}, r AS (SELECT instrument, seq, side, qty * price AS need, 1e7 + sum(CASE side WHEN 'BUY' THEN -qty * price ELSE qty * price END) OVER (PARTITION BY instrument ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cash FROM fills)\nSELECT instrument, seq, coalesce(cash, 1e7) >= need AS enough FROM r WHERE side = 'BUY'")
def buy_sufficient(spark, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instrument").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    f = fills(spark, sf_dir).withColumn("had", 1e7 + F.coalesce(F.sum(-book.signed() * F.col("price")).over(w), F.lit(0.0)))
    return f.where("side = 'BUY'").select("instrument", "seq", (F.col("had") >= F.col("qty") * F.col("price")).alias("enough"))


#: A step for each fill: what the account has left decides whether the next one goes through.
TRADED = f"""{FILLS}, fo AS (SELECT instrument, seq, side, CAST(qty AS DOUBLE) AS qty, CAST(price AS DOUBLE) AS price FROM fills),
 tr AS (SELECT instrument, CAST(0 AS BIGINT) AS seq, CAST('' AS VARCHAR) AS status, CAST(20000 AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS held FROM (SELECT DISTINCT instrument FROM fills) i
  UNION ALL SELECT instrument, seq, status, cash + CASE WHEN status <> 'ok' THEN 0 WHEN side = 'BUY' THEN -(qty * price) ELSE qty * price END, held + CASE WHEN status <> 'ok' THEN 0 WHEN side = 'BUY' THEN qty ELSE -qty END
  FROM (SELECT fo.instrument, fo.seq, fo.side, fo.qty, fo.price, tr.cash, tr.held, CASE WHEN fo.qty <= 0 THEN 'refused: not a trade' WHEN fo.side = 'BUY' AND fo.qty * fo.price > tr.cash THEN 'refused: cash' WHEN fo.side = 'SELL' AND fo.qty > tr.held THEN 'refused: not held' ELSE 'ok' END AS status
   FROM tr JOIN fo ON fo.instrument = tr.instrument AND fo.seq = tr.seq + 1) s)"""


@query("trade_with_refusals", rounded_sql(f"WITH RECURSIVE {TRADED}\nSELECT instrument, seq, status, cash, held FROM tr WHERE seq > 0", "cash", "held", digits=4))
def trade_with_refusals(spark, sf_dir: str) -> DataFrame:
    """Every fill against an account of 20,000 of its instrument; what it cannot pay or does not hold is refused."""
    return rounded(book.traded(fills(spark, sf_dir), 20_000.0).select("instrument", "seq", "status", "cash", "held"), 4)


LASTPX = f"{FILLS}, v AS (SELECT instrument, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS net, max_by(price, seq) AS px FROM fills GROUP BY 1)"
#: FIFO with lots kept one by one: a step for each fill, which closes the oldest lots first. Lots are (quantity, price), oldest first.
FIFO = f"""{FILLS}, lo AS (SELECT instrument, CASE side WHEN 'BUY' THEN 1 ELSE -1 END AS way, qty, price, seq, sum(qty) OVER (PARTITION BY instrument, side ORDER BY seq) AS upto FROM fills),
 pr AS (SELECT b.instrument, b.seq AS bs, s.seq AS ss, least(b.upto, s.upto) - greatest(b.upto - b.qty, s.upto - s.qty) AS q, b.price AS bp, s.price AS sp FROM lo b JOIN lo s ON b.instrument = s.instrument AND b.way = 1 AND s.way = -1 AND b.upto - b.qty < s.upto AND s.upto - s.qty < b.upto),
 cl AS (SELECT instrument, seq, sum(q) AS q FROM (SELECT instrument, bs AS seq, q FROM pr UNION ALL SELECT instrument, ss, q FROM pr) u GROUP BY 1, 2),
 op AS (SELECT lo.instrument, sum(way * (qty - coalesce(q, 0))) AS net_qty, sum((qty - coalesce(q, 0)) * price) AS held FROM lo LEFT JOIN cl ON cl.instrument = lo.instrument AND cl.seq = lo.seq GROUP BY 1),
 re AS (SELECT instrument, sum(q * (sp - bp)) AS realised FROM pr GROUP BY 1),
 ff AS (SELECT op.instrument, CAST(net_qty AS DOUBLE) AS net_qty, CASE WHEN net_qty <> 0 THEN held / abs(net_qty) END AS avg_cost, coalesce(realised, 0) AS realised FROM op LEFT JOIN re USING (instrument))"""


def valued(spark, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).groupBy("instrument").agg(F.sum(book.signed()).alias("net"), F.max_by("price", "seq").alias("px"))


@query("avg_cost", rounded_sql(f"WITH {FIFO}\nSELECT instrument, avg_cost FROM ff", "avg_cost"))
def avg_cost(spark, sf_dir: str) -> DataFrame:
    """Of the open lots of the open side."""
    return rounded(book.fifo(fills(spark, sf_dir)).select("instrument", "avg_cost"))


@query("market_value", rounded_sql(f"WITH {LASTPX}\nSELECT sum(net * px) AS value FROM v", "value", digits=3))
def market_value(spark, sf_dir: str) -> DataFrame:
    return rounded(valued(spark, sf_dir).agg(F.sum(F.col("net") * F.col("px")).alias("value")), 3)


@query("unrealized_pnl", rounded_sql(f"WITH {FIFO}, px AS (SELECT instrument, max_by(price, seq) AS px FROM fills GROUP BY 1)\nSELECT instrument, (px - avg_cost) * net_qty AS pnl FROM ff JOIN px USING (instrument)", "pnl", digits=3))
def unrealized_pnl(spark, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir)
    last = f.groupBy("instrument").agg(F.max_by("price", "seq").alias("px"))
    return rounded(book.fifo(f).join(last, "instrument").select("instrument", ((F.col("px") - F.col("avg_cost")) * F.col("net_qty")).alias("pnl")), 3)


@query("total_equity", rounded_sql(f"WITH {LASTPX}, k AS (SELECT sum(CASE side WHEN 'BUY' THEN -qty * price ELSE qty * price END) AS cash FROM fills)\nSELECT 1e6 + (SELECT cash FROM k) + sum(net * px) AS equity FROM v", "equity", digits=3))
def total_equity(spark, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir)
    cash = f.agg(F.sum(-book.signed() * F.col("price")).alias("cash"))
    return rounded(valued(spark, sf_dir).agg(F.sum(F.col("net") * F.col("px")).alias("v")).crossJoin(cash).select((1e6 + F.col("cash") + F.col("v")).alias("equity")), 3)


@query("book_trade_fifo", rounded_sql(f"WITH {FIFO}\nSELECT instrument, net_qty, avg_cost FROM ff", "net_qty", "avg_cost"))
def book_trade_fifo(spark, sf_dir: str) -> DataFrame:
    return rounded(book.fifo(fills(spark, sf_dir)).select("instrument", "net_qty", "avg_cost"))


@query("book_fifo_realised", rounded_sql(f"WITH {FIFO}\nSELECT instrument, realised FROM ff", "realised", digits=0))
def book_fifo_realised(spark, sf_dir: str) -> DataFrame:
    return rounded(book.fifo(fills(spark, sf_dir)).select("instrument", "realised"), 0)


@query("book_greeks_rollup", rounded_sql(f"WITH {FILLS}\nSELECT coalesce(instrument, 'TOTAL') AS underlying, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END * price) AS exposure FROM fills GROUP BY ROLLUP (instrument)", "exposure", digits=3))
def book_greeks_rollup(spark, sf_dir: str) -> DataFrame:
    """Exposure of each underlying and of all, in one pass."""
    r = fills(spark, sf_dir).rollup("instrument").agg(F.sum(book.signed() * F.col("price")).alias("exposure"))
    return rounded(r.select(F.coalesce("instrument", F.lit("TOTAL")).alias("underlying"), "exposure"), 3)


@query("book_fingerprint", f"WITH {FILLS}, n AS (SELECT instrument, CAST(sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS BIGINT) AS net FROM fills GROUP BY 1)\nSELECT md5(string_agg(instrument || ':' || CAST(net AS VARCHAR), ',' ORDER BY instrument)) AS fingerprint FROM n")
def book_fingerprint(spark, sf_dir: str) -> DataFrame:
    n = fills(spark, sf_dir).groupBy("instrument").agg(F.sum(book.signed()).cast("long").alias("net"))
    return n.agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("instrument", "net"))), lambda x: F.concat_ws(":", x["instrument"], x["net"].cast("string"))))).alias("fingerprint"))


MINUTE = "GROUP BY symbol, date_trunc('minute', ts)"


@query("bar_builder_on_tick", rounded_sql(f"WITH {TICKS}\nSELECT symbol, date_trunc('minute', ts) AS minute, min_by(ltp, event_id) AS open, max(ltp) AS high, min(ltp) AS low, max_by(ltp, event_id) AS close, CAST(greatest(max(cum_volume) - min(cum_volume), 0) AS BIGINT) AS volume FROM ticks {MINUTE}", "open", "high", "low", "close"))
def bar_builder(spark, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir).groupBy("symbol", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"))
    return rounded(t.agg(F.min_by("ltp", "event_id").alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", "event_id").alias("close"), F.greatest(F.max("cum_volume") - F.min("cum_volume"), F.lit(0)).alias("volume")))


@query("latest_value_per_key", f"WITH {TICKS}\nSELECT symbol, max(event_id) AS event_id, max_by(ltp, event_id) AS ltp FROM ticks GROUP BY symbol")
def latest_per_key(spark, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.max("event_id").alias("event_id"), F.max_by("ltp", "event_id").alias("ltp"))


@query("bus_dispatch", f"WITH {TICKS}, s AS (SELECT * FROM (VALUES (1, 'click'), (1, 'view'), (2, 'view')) t(client, symbol))\nSELECT CAST(client AS BIGINT) AS client, event_id FROM ticks JOIN s USING (symbol)")
def bus_dispatch(spark, sf_dir: str) -> DataFrame:
    subs = spark.createDataFrame([(1, "click"), (1, "view"), (2, "view")], "client long, symbol string")
    return ticks(spark, sf_dir).join(F.broadcast(subs), "symbol").select("client", "event_id")


@query("bus_refcount", "SELECT event_type AS symbol, CAST(count(DISTINCT user_id) AS BIGINT) AS clients FROM events GROUP BY 1")
def bus_refcount(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.count_distinct("user_id").alias("clients"))


@query("write_bars_keep_last", rounded_sql(f"WITH {BARS}, u AS (SELECT *, 1 AS batch FROM bars WHERE dt < DATE '1996-01-01' UNION ALL SELECT symbol, dt, open, high, low, close + 1, volume, 2 FROM bars WHERE dt BETWEEN DATE '1995-12-01' AND DATE '1996-01-31')\nSELECT symbol, dt, max_by(close, batch) AS close FROM u GROUP BY 1, 2", "close"))
def write_bars(spark, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    old, new = b.where("dt < DATE '1996-01-01'").withColumn("batch", F.lit(1)), b.where("dt BETWEEN DATE '1995-12-01' AND DATE '1996-01-31'").withColumn("close", F.col("close") + 1).withColumn("batch", F.lit(2))
    return rounded(keep_last(old.unionByName(new), ["symbol", "dt"], "batch").select("symbol", "dt", "close"))


def keep_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the rows of a key the one that came last."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


@query("history_archive_stats", f"WITH {BARS}\nSELECT symbol, CAST(count(*) AS BIGINT) AS n, min(dt) AS first, max(dt) AS last, max_by(close > open, dt) AS last_up FROM bars GROUP BY symbol")
def archive_stats(spark, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.max_by(F.col("close") > F.col("open"), "dt").alias("last_up"))


@query("store_stats", f"WITH {CHAIN}\nSELECT CAST(year(ts) AS BIGINT) AS y, CAST(count(DISTINCT ts) AS BIGINT) AS snapshots, min(ts) AS first, max(ts) AS last, CAST(count(*) AS BIGINT) AS n FROM chain GROUP BY 1")
def store_stats(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).groupBy(F.year("ts").cast("long").alias("y")).agg(F.count_distinct("ts").alias("snapshots"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


@query("last_snapshot_of_day", f"WITH {CHAIN}, y AS (SELECT *, max(ts) OVER (PARTITION BY year(ts)) AS m FROM chain)\nSELECT ts, strike, call_oi FROM y WHERE ts = m")
def last_snapshot(spark, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    return c.join(F.broadcast(c.groupBy(F.year("ts").alias("y")).agg(F.max("ts").alias("ts")).select("ts")), "ts").select("ts", "strike", "call_oi")


@query("days_available", f"WITH {CHAIN}\nSELECT DISTINCT ts FROM chain")
def days_available(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).select("ts").distinct().orderBy("ts")


@query("chain_snapshot_dedup", f"WITH {CHAIN}\nSELECT ts, expiry, CAST(count(*) AS BIGINT) AS n FROM chain WHERE ts NOT IN (SELECT ts FROM chain WHERE year(ts) = 1995) GROUP BY 1, 2")
def chain_snapshot(spark, sf_dir: str) -> DataFrame:
    """Snapshots that are not stored yet."""
    c = chain(spark, sf_dir)
    return c.join(c.where("year(ts) = 1995").select("ts", "expiry").distinct(), ["ts", "expiry"], "left_anti").groupBy("ts", "expiry").agg(F.count(F.lit(1)).alias("n"))


@query("harvest_coverage", f"WITH {CHAIN}\nSELECT expiry, CAST(count(DISTINCT strike) AS BIGINT) AS contracts, CAST(count(*) AS BIGINT) AS candles, min(ts) AS first, max(ts) AS last, CAST(count(CASE WHEN call_oi > 0 THEN 1 END) AS BIGINT) AS with_oi FROM chain GROUP BY expiry")
def harvest_coverage(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).groupBy("expiry").agg(F.count_distinct("strike").alias("contracts"), F.count(F.lit(1)).alias("candles"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("call_oi") > 0).alias("with_oi"))


@query("participant_backfill_missing", f"WITH {PARTICIPANTS}, w AS (SELECT CAST(d AS DATE) AS dt FROM (SELECT unnest(generate_series(date_trunc('month', min(dt)), date_trunc('month', max(dt)) + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM participants) t WHERE isodow(d) <= 5)\nSELECT dt FROM w WHERE dt NOT IN (SELECT dt FROM participants)")
def participant_missing(spark, sf_dir: str) -> DataFrame:
    """Weekdays for which nothing is stored, of all months from the first stored day's to the last one's."""
    p = participants(spark, sf_dir).select("dt")
    wanted = p.agg(F.trunc(F.min("dt"), "month").alias("a"), F.last_day(F.max("dt")).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("dt"))
    return wanted.where(F.weekday("dt") < 5).join(p, "dt", "left_anti")


@query("set_union_names", f"WITH {FILLS}, {BARS}\nSELECT instrument AS name FROM fills UNION SELECT symbol FROM bars")
def set_union(spark, sf_dir: str) -> DataFrame:
    return fills(spark, sf_dir).select(F.col("instrument").alias("name")).union(bars(spark, sf_dir).select("symbol")).distinct()


@query("set_intersect_days", f"WITH {BARS}, {PARTICIPANTS}\nSELECT dt FROM bars INTERSECT SELECT dt FROM participants")
def set_intersect(spark, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("dt").intersect(participants(spark, sf_dir).select("dt"))


@query("set_except_days", f"WITH {BARS}, {PARTICIPANTS}\nSELECT dt FROM participants EXCEPT SELECT dt FROM bars")
def set_except(spark, sf_dir: str) -> DataFrame:
    return participants(spark, sf_dir).select("dt").subtract(bars(spark, sf_dir).select("dt"))


@query("universe_memberships", "SELECT p_brand AS symbol, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS lists FROM part GROUP BY 1")
def universe(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.concat_ws(",", F.sort_array(F.collect_set("p_type"))).alias("lists"))


@query("one_lot_size", "SELECT p_type, CASE WHEN min(p_size) = max(p_size) THEN CAST(min(p_size) AS BIGINT) END AS lot, CAST(count(DISTINCT p_size) AS BIGINT) AS n FROM part GROUP BY 1")
def one_lot_size(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.when(F.min("p_size") == F.max("p_size"), F.min("p_size")).cast("long").alias("lot"), F.count_distinct("p_size").alias("n"))


@query("quote_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def quote_json(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("business_days", "SELECT o_orderkey, CAST(len(list_filter(range(CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP), CAST(CAST(o_orderdate AS DATE) + 31 AS TIMESTAMP), INTERVAL 1 DAY), lambda d: isodow(d) <= 5)) AS BIGINT) AS n FROM orders")
def business_days(spark, sf_dir: str) -> DataFrame:
    """Weekdays in the 30 days after an order, without making the days: whole weeks, and the rest by weekday."""
    day = F.to_date("o_orderdate")
    rest = F.aggregate(F.sequence(F.lit(29), F.lit(30)), F.lit(0), lambda a, i: a + (F.weekday(F.date_add(day, i)) < 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (20 + rest).cast("long").alias("n"))


@query("time_to_expiry_years", rounded_sql("\nSELECT event_id, greatest(epoch(last_day(CAST(ts AS DATE)) + INTERVAL '15:40:00' HOUR TO SECOND - INTERVAL 330 MINUTE - ts), 300.0) / 31536000.0 AS t FROM events", "t", digits=9).replace("INTERVAL '15:40:00' HOUR TO SECOND", "INTERVAL 940 MINUTE"))
def time_to_expiry(spark, sf_dir: str) -> DataFrame:
    close = F.unix_timestamp(F.to_timestamp(F.last_day("ts"))) + 940 * 60 - 330 * 60
    now = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rounded(table(spark, sf_dir, "events").select("event_id", (F.greatest(close - now, F.lit(300.0)) / 31536000.0).alias("t")), 9)


@query("is_expired", "SELECT event_id, ts >= CAST('2024-01-15' AS TIMESTAMP) + INTERVAL 610 MINUTE AS expired FROM events")
def is_expired(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("ts").cast("timestamp") >= F.lit("2024-01-15 10:10:00").cast("timestamp")).alias("expired"))


@query("instrument_key", "SELECT DISTINCT 'NFO:' || upper(p_type) || '|' || '2026-12-29' || '|' || CAST(p_size * 50 AS VARCHAR) || '|CE' AS key FROM part")
def instrument_key(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("|", F.concat(F.lit("NFO:"), F.upper("p_type")), F.lit("2026-12-29"), (F.col("p_size") * 50).cast("string"), F.lit("CE")).alias("key")).distinct()


@query("instrument_parse", "SELECT DISTINCT upper(p_type) AS symbol, CAST(p_size * 50 AS DOUBLE) AS strike, 'CE' AS kind FROM part")
def instrument_parse(spark, sf_dir: str) -> DataFrame:
    parts = F.split(F.col("key"), r"\|")
    return instrument_key(spark, sf_dir).select(F.regexp_replace(F.get(parts, 0), "^[A-Z]+:", "").alias("symbol"), F.get(parts, 2).cast("double").alias("strike"), F.get(parts, 3).alias("kind")).distinct()


@query("clean_company_name", "SELECT c_custkey, regexp_replace(trim(c_name || CASE WHEN c_custkey % 2 = 0 THEN ' Ltd.' ELSE ' Limited' END), '(?i)\\s+(ltd\\.?|limited)\\s*$', '') AS name FROM customer")
def clean_name(spark, sf_dir: str) -> DataFrame:
    named = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " Ltd.").otherwise(" Limited"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_replace(F.trim(named), r"(?i)\s+(ltd\.?|limited)\s*$", "").alias("name"))


@query("normalize_symbol", "SELECT DISTINCT CASE WHEN regexp_matches(upper(trim(p_brand)), '[.^=-]') THEN upper(trim(p_brand)) ELSE upper(trim(p_brand)) || '.NS' END AS ticker FROM part")
def normalize_symbol(spark, sf_dir: str) -> DataFrame:
    s = F.upper(F.trim("p_brand"))
    return table(spark, sf_dir, "part").select(F.when(s.rlike("[.^=-]"), s).otherwise(F.concat(s, F.lit(".NS"))).alias("ticker")).distinct()


@query("export_history", rounded_sql(f"WITH {BARS}\nSELECT symbol, dt, close, 'bars' AS source FROM bars", "close"))
def export_history(spark, sf_dir: str) -> DataFrame:
    return rounded(bars(spark, sf_dir).select("symbol", "dt", "close", F.lit("bars").alias("source")))


@query("calendar_expiries", f"WITH {CHAIN}, c AS (SELECT expiry, count(*) AS contracts FROM chain WHERE expiry >= DATE '1996-01-01' GROUP BY 1 ORDER BY 1 LIMIT 8)\nSELECT expiry, CAST(contracts AS BIGINT) AS contracts FROM c")
def calendar(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).where("expiry >= DATE '1996-01-01'").groupBy("expiry").agg(F.count(F.lit(1)).alias("contracts")).orderBy("expiry").limit(8)


@query("expiring_soon", f"WITH {CHAIN}\nSELECT DISTINCT expiry FROM chain WHERE expiry BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def expiring_soon(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).where("expiry BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'").select("expiry").distinct()


@query("front_future_rows", "SELECT p_type AS name, min(DATE '2026-01-01' + CAST(p_size AS INTEGER)) AS expiry FROM part WHERE DATE '2026-01-01' + CAST(p_size AS INTEGER) >= DATE '2026-01-10' GROUP BY 1")
def front_future_rows(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size").cast("int")).alias("expiry"))
    return e.where("expiry >= DATE '2026-01-10'").groupBy("name").agg(F.min("expiry").alias("expiry"))
