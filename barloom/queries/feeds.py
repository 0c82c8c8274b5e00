"""Queries of parsers, contract tables, market clocks and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import archive
from ..sources import parsers as pa
from ..sources.views import BARS, CHAIN, TICKS, bars, chain, table, ticks
from . import query, rounded, rounded_sql
from .indicators import LAG, W

HEADER = list(pa.INSTRUMENT_COLUMNS)
#: Contracts written as CSV lines, some with an expiry, a strike or a lot size that cannot be read.
NAMES = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NIFTY' WHEN 1 THEN 'BANKNIFTY' ELSE 'GOLD' END AS name, DATE '2026-01-01' + CAST(p_size AS INTEGER) AS expiry, CAST(p_size * 50 AS DOUBLE) AS strike, CASE WHEN p_size = 7 THEN 30 WHEN p_partkey % 3 = 0 THEN 65 ELSE 15 END AS lot, CASE p_partkey % 4 WHEN 0 THEN 'FUT' WHEN 1 THEN 'PE' ELSE 'CE' END AS kind FROM part"
INST = f"ins AS (SELECT CAST(p_partkey AS VARCHAR) AS instrument_token, name || p_partkey AS tradingsymbol, name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE expiry END AS expiry, CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE strike END AS strike, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE CAST(lot AS INTEGER) END AS lot_size, kind AS instrument_type FROM ({NAMES}) n)"


def contract_lines(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "NIFTY").when(k % 3 == 1, "BANKNIFTY").otherwise("GOLD")
    lot = F.when(F.col("p_size") == 7, 30).when(k % 3 == 0, 65).otherwise(15)
    kind = F.when(k % 4 == 0, "FUT").when(k % 4 == 1, "PE").otherwise("CE")
    expiry = F.when(k % 11 == 0, "soon").otherwise(F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size").cast("int")).cast("string"))
    parts = [k, F.concat(name, k.cast("string")), name, expiry, F.when(k % 13 == 0, "n/a").otherwise((F.col("p_size") * 50).cast("string")), F.when(k % 17 == 0, "").otherwise(lot.cast("string")), kind]
    lines = table(spark, sf_dir, "part").select(F.concat_ws(",", *(p.cast("string") for p in parts)).alias("value"))
    return lines.union(spark.createDataFrame([(",".join(HEADER),), ("",)], "value string"))


def contracts(spark, sf_dir: str) -> DataFrame:
    return pa.instruments(contract_lines(spark, sf_dir), HEADER)


@query("parse_instruments_csv", f"WITH {INST}\nSELECT * FROM ins")
def parse_instruments(spark, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir)


@query("tradingsymbol_for", f"WITH {INST}, q AS (SELECT DISTINCT name, expiry, instrument_type, CASE WHEN strike = 500 THEN 501.0 ELSE strike END AS strike FROM ins WHERE expiry IS NOT NULL)\nSELECT q.name, q.expiry, q.instrument_type, q.strike, min(tradingsymbol) AS tradingsymbol FROM q LEFT JOIN ins ON ins.name = q.name AND ins.expiry = q.expiry AND ins.instrument_type = q.instrument_type AND ins.strike = q.strike GROUP BY 1, 2, 3, 4")
def tradingsymbol_for(spark, sf_dir: str) -> DataFrame:
    c = contracts(spark, sf_dir)
    asked = c.where("expiry IS NOT NULL").withColumn("strike", F.when(F.col("strike") == 500, 501.0).otherwise(F.col("strike"))).select("name", "expiry", "instrument_type", "strike").distinct()
    return pa.trading_symbols(asked, c).groupBy("name", "expiry", "instrument_type", "strike").agg(F.min("tradingsymbol").alias("tradingsymbol"))


@query("cached_lot_size", f"WITH {INST}\nSELECT name, expiry, CASE WHEN min(lot_size) = max(lot_size) THEN min(lot_size) END AS lot_size, CASE WHEN min(lot_size) <> max(lot_size) THEN 'contracts disagree' END AS reason FROM ins GROUP BY 1, 2")
def cached_lot_size(spark, sf_dir: str) -> DataFrame:
    return pa.lot_sizes(contracts(spark, sf_dir))


@query("settling_today", f"WITH {INST}\nSELECT DISTINCT name, expiry FROM ins WHERE expiry = DATE '2026-01-21'")
def settling_today(spark, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).where("expiry = DATE '2026-01-21'").select("name", "expiry").distinct()


@query("ensure_front_futures", f"WITH {INST}, fr AS (SELECT name, min(expiry) AS expiry FROM ins WHERE instrument_type = 'FUT' AND expiry >= DATE '2026-01-10' GROUP BY 1)\nSELECT name, expiry FROM fr WHERE name <> 'GOLD'")
def ensure_front_futures(spark, sf_dir: str) -> DataFrame:
    """Front futures that are wanted and not yet watched."""
    front = contracts(spark, sf_dir).where("instrument_type = 'FUT' AND expiry >= DATE '2026-01-10'").groupBy("name").agg(F.min("expiry").alias("expiry"))
    return front.join(spark.createDataFrame([("GOLD",)], "name string"), "name", "left_anti")


@query("load_instruments", f"WITH {INST}\nSELECT name, instrument_type, CAST(count(*) AS BIGINT) AS n, CAST(count(expiry) AS BIGINT) AS dated FROM ins GROUP BY 1, 2")
def load_instruments(spark, sf_dir: str) -> DataFrame:
    return contracts(spark, sf_dir).groupBy("name", "instrument_type").agg(F.count(F.lit(1)).alias("n"), F.count("expiry").alias("dated"))


POSITIONS = list(pa.PARTICIPANT_COLUMNS)
PART_SQL = """po AS (SELECT n_nationkey AS day, c.i, CASE c.i WHEN 0 THEN 'Client' WHEN 1 THEN 'DII' WHEN 2 THEN 'FII' ELSE 'Pro' END AS client_type, n_nationkey * 10 + c.i AS a, CASE WHEN c.i = 2 THEN 0 ELSE n_nationkey * 3 END AS b FROM nation CROSS JOIN range(4) c(i))"""


@query("parse_participant_csv", f"WITH {PART_SQL}\nSELECT day, client_type, CAST(a AS BIGINT) AS fut_idx_long, CAST(b AS BIGINT) AS fut_idx_short, CAST(a - b AS BIGINT) AS idx_fut_net, CAST((a + 1 + 4) - (3 + 2) AS BIGINT) AS idx_opt_net FROM po")
def parse_participant_csv(spark, sf_dir: str) -> DataFrame:
    """A file for each nation: a title, a header with blanks, four classes, of which one has a count that is no number, and the total."""
    k = F.col("n_nationkey")
    header = F.lit(",".join(f"{n}  " for n in POSITIONS))
    line = lambda i, who: F.concat_ws(",", F.lit(f"{who} "), (k * 10 + i).cast("string"), F.lit("-") if i == 2 else (k * 3).cast("string"), (k * 10 + i + 1).cast("string"), F.lit("2"), F.lit("3"), F.lit("4"))
    files = table(spark, sf_dir, "nation").select(k.alias("day"), F.explode(F.array(F.lit('"Participant wise open interest"'), header, *(line(i, w) for i, w in enumerate(("Client", "DII", "FII", "Pro", "TOTAL"))))).alias("value"))
    rows = pa.participant_rows(files.where(~F.col("value").startswith("Client Type")), POSITIONS, ["day"])
    return rows.select("day", "client_type", "fut_idx_long", "fut_idx_short", "idx_fut_net", "idx_opt_net")


@query("parse_constituents_csv", "SELECT 'S' || c_custkey AS symbol, c_name AS name, 'NIFTY 50' AS index_name, c_mktsegment AS industry FROM customer")
def parse_constituents_csv(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat_ws(",", F.concat(F.lit(" "), "c_name"), "c_mktsegment", F.concat(F.lit("S"), F.col("c_custkey").cast("string"), F.lit(" "))).alias("value"))
    return pa.constituents(c, ["Company Name", "Industry", "Symbol"], "NIFTY 50")


@query("industry_map", "SELECT s_suppkey, c_mktsegment AS industry FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 3")
def industry_map(spark, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").select((F.col("c_custkey")).alias("k"), F.col("c_mktsegment").alias("industry"))
    return table(spark, sf_dir, "supplier").join(dim, F.col("s_suppkey") * 3 == F.col("k"), "left").select("s_suppkey", "industry")


@query("parse_chain", rounded_sql(f"WITH {CHAIN}\nSELECT ts, expiry, strike, coalesce(call_ltp, 0) AS call_ltp, CAST(put_oi AS DOUBLE) AS put_oi, CASE WHEN CAST(strike AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(0.15 AS DOUBLE) END AS call_iv FROM chain", "call_ltp", "put_oi", "call_iv", digits=9))
def parse_chain(spark, sf_dir: str) -> DataFrame:
    """Chains written as JSON with a second expiry among their rows, read again: the first expiry alone."""
    side = lambda px, oi, iv: F.struct(F.col(px).alias("lastPrice"), F.col(oi).cast("double").alias("openInterest"), iv.alias("impliedVolatility"))
    iv = F.when(F.col("strike").cast("long") % 3 == 0, 0.0).otherwise(15.0)
    row = lambda expiry: F.struct(F.col("strike").alias("strikePrice"), expiry.cast("string").alias("expiryDate"), side("call_ltp", "call_oi", iv).alias("CE"), side("put_ltp", "put_oi", iv).alias("PE"))
    both = F.flatten(F.collect_list(F.array(row(F.col("expiry")), row(F.date_add("expiry", 30)))))
    doc = chain(spark, sf_dir).groupBy("ts").agg(F.to_json(F.struct(F.struct(F.max("spot").alias("underlyingValue"), F.array(F.max("expiry").cast("string"), F.date_add(F.max("expiry"), 30).cast("string")).alias("expiryDates"), both.alias("data")).alias("records"))).alias("json"))
    return rounded(pa.chain_rows(doc, ["ts"]).select("ts", "expiry", "strike", "call_ltp", "put_oi", "call_iv"), 9)


@query("parse_news", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new ' ELSE 'old ' END || doc_id AS title, 'http://x/' || doc_id AS link, source AS publisher FROM documents WHERE doc_id % 7 <> 0")
def parse_news(spark, sf_dir: str) -> DataFrame:
    """News in two shapes, some of it without a title."""
    i, link = F.col("doc_id").cast("string"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))
    none = F.col("doc_id") % 7 == 0
    old = F.to_json(F.struct(F.when(~none, F.concat(F.lit("old "), i)).alias("title"), link.alias("link"), F.col("source").alias("publisher")))
    new = F.to_json(F.struct(F.struct(F.when(~none, F.concat(F.lit("new "), i)).alias("title"), F.struct(link.alias("url")).alias("canonicalUrl"), F.struct(F.col("source").alias("displayName")).alias("provider")).alias("content")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, new).otherwise(old).alias("json"))
    return pa.news_rows(docs, ["doc_id"])


SIZES = (8, 28, 16, 44, 184, 32)
FRAMED = "fr AS (SELECT *, event_id // 10 AS frame_id, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS packet, [8, 28, 16, 44, 184, 32][CAST(event_id % 6 AS INTEGER) + 1] AS size, round(value * 100) / 100.0 AS px FROM events)"


def frames(spark, sf_dir: str) -> DataFrame:
    """Ten events a frame, in packets of six sizes, one of which is unknown; every seventh frame is torn."""
    v, k = F.col("value"), F.col("event_id")
    fields = {"ltp": v, "high": v + 1, "low": v - 1, "open": v, "close": -v, "volume": k * 3, "oi": k}
    made = F.lit(None).cast("binary")
    for i, size in enumerate(SIZES):
        made = F.when(k % 6 == i, pa.packet(size, k, fields)).otherwise(made)
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(k / 10).alias("frame_id"), made.alias("p"))
    whole = rows.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "p"))), lambda x: x["p"]).alias("parts")).select("frame_id", pa.frame(F.col("parts")).alias("frame"))
    return whole.withColumn("frame", F.when(F.col("frame_id") % 7 == 0, F.substring("frame", F.lit(1), F.octet_length("frame") - 3)).otherwise(F.col("frame")))


PARSED = f"{FRAMED}, pk AS (SELECT *, max(packet) OVER (PARTITION BY frame_id) AS last FROM fr), pp AS (SELECT * FROM pk WHERE size <> 16 AND NOT (frame_id % 7 = 0 AND packet = last))"


@query("parse_binary", rounded_sql(f"WITH {PARSED}\nSELECT frame_id, CAST(packet AS INTEGER) AS packet, event_id AS token, CASE size WHEN 8 THEN 'ltp' WHEN 44 THEN 'quote' WHEN 184 THEN 'full' ELSE 'index' END AS mode, px AS ltp, CASE WHEN size = 8 THEN NULL ELSE -px END AS close, CASE WHEN size >= 44 THEN event_id * 3 END AS volume, CASE WHEN size = 184 THEN event_id END AS oi FROM pp", "ltp", "close", digits=2))
def parse_binary(spark, sf_dir: str) -> DataFrame:
    return rounded(pa.ticks(frames(spark, sf_dir), ["frame_id"]).select("frame_id", "packet", "token", "mode", "ltp", "close", "volume", "oi"), 2)


@query("parse_packet", f"WITH {PARSED}\nSELECT CAST(size AS INTEGER) AS size, CAST(count(*) AS BIGINT) AS n FROM pk WHERE NOT (frame_id % 7 = 0 AND packet = last) GROUP BY 1")
def parse_packet(spark, sf_dir: str) -> DataFrame:
    """Whole packets of frames by size."""
    return frames(spark, sf_dir).select(F.explode(pa.packets(F.col("frame"))).alias("p")).groupBy(F.col("p.size").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("build_frame", f"WITH {FRAMED}\nSELECT frame_id, CAST(sum(size + 2) + 2 - CASE WHEN frame_id % 7 = 0 THEN 3 ELSE 0 END AS INTEGER) AS bytes, CAST(count(*) AS INTEGER) AS n FROM fr GROUP BY 1")
def build_frame(spark, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", F.octet_length("frame").alias("bytes"), pa.big_endian(F.col("frame"), F.lit(0), 2).cast("int").alias("n"))


@query("tick_change_pct", rounded_sql("\nSELECT event_id, CASE WHEN c > 0 THEN (100 + value) / c - 1 ELSE 0 END AS change FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 98.5 ELSE 101 END AS c FROM events) e", "change"))
def tick_change_pct(spark, sf_dir: str) -> DataFrame:
    close = F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, 98.5).otherwise(101.0)
    return rounded(table(spark, sf_dir, "events").select("event_id", pa.change_pct(100 + F.col("value"), close).alias("change")))


#: Fixed multipliers of contracts that are ordered in lots, by venue and name.
SPECS = {
    ("MCX", "GOLD"): 100, ("MCX", "GOLDM"): 10, ("MCX", "SILVER"): 30, ("MCX", "SILVERM"): 5, ("MCX", "SILVERMIC"): 1, ("MCX", "CRUDEOIL"): 100, ("MCX", "CRUDEOILM"): 10, ("MCX", "NATURALGAS"): 1250, ("MCX", "NATGASMINI"): 250,
    ("MCX", "COPPER"): 2500, ("MCX", "ZINC"): 5000, ("MCX", "ALUMINIUM"): 5000, ("MCX", "LEAD"): 5000, ("MCX", "NICKEL"): 250, ("CDS", "USDINR"): 1000, ("CDS", "EURINR"): 1000, ("CDS", "GBPINR"): 1000, ("CDS", "JPYINR"): 1000,
}
IN_LOTS = ("MCX", "CDS")
SPEC_SQL = "sp AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{n}', {m})" for (e, n), m in SPECS.items()) + ") v(exchange, name, multiplier))"
ASKED = "ak AS (SELECT p_partkey, ['MCX', 'CDS', 'NFO'][CAST(p_partkey % 3 AS INTEGER) + 1] AS exchange, ['gold', 'USDINR', 'TIN', 'ZINC'][CAST(p_partkey % 4 AS INTEGER) + 1] AS name, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 25 ELSE 1 END AS dump_lot FROM part)"


def specs(spark) -> DataFrame:
    return spark.createDataFrame([(e, n, m) for (e, n), m in SPECS.items()], "exchange string, name string, multiplier int")


def asked(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", pick(("MCX", "CDS", "NFO")).alias("exchange"), F.upper(pick(("gold", "USDINR", "TIN", "ZINC"))).alias("name"), F.when(k % 5 == 0, None).when(k % 5 == 1, 25).otherwise(1).alias("dump_lot"))


@query("spec_for", f"WITH {SPEC_SQL}, {ASKED}\nSELECT p_partkey, CAST(multiplier AS INTEGER) AS multiplier FROM ak LEFT JOIN sp ON sp.exchange = ak.exchange AND sp.name = upper(ak.name)")
def spec_for(spark, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).join(F.broadcast(specs(spark)), ["exchange", "name"], "left").select("p_partkey", "multiplier")  # a table of constants


LOTTED = f"{SPEC_SQL}, {ASKED}, el AS (SELECT p_partkey, ak.exchange, CASE WHEN ak.exchange = 'NFO' THEN dump_lot WHEN multiplier IS NULL THEN NULL WHEN dump_lot <> 1 THEN NULL ELSE multiplier END AS lot, CASE WHEN ak.exchange = 'NFO' THEN CASE WHEN dump_lot IS NULL THEN 'no lot in the list' ELSE 'list' END WHEN multiplier IS NULL THEN 'no multiplier is known' WHEN dump_lot <> 1 THEN 'the list does not count in lots' ELSE 'contract table' END AS source, multiplier FROM ak LEFT JOIN sp ON sp.exchange = ak.exchange AND sp.name = upper(ak.name))"


def economic(spark, sf_dir: str) -> DataFrame:
    """Units of a lot, and where that is from: of venues that order in lots the contract table's, of others the list's; NULL with a reason otherwise."""
    d = asked(spark, sf_dir).join(F.broadcast(specs(spark)), ["exchange", "name"], "left")
    lots, odd = F.col("exchange").isin(*IN_LOTS), F.coalesce(F.col("dump_lot") != 1, F.lit(False))
    lot = F.when(~lots, F.col("dump_lot")).when(odd, None).otherwise(F.col("multiplier"))
    source = F.when(~lots, F.when(F.col("dump_lot").isNull(), "no lot in the list").otherwise("list")).when(F.col("multiplier").isNull(), "no multiplier is known").when(odd, "the list does not count in lots").otherwise("contract table")
    return d.select("p_partkey", "exchange", lot.alias("lot"), source.alias("source"), "multiplier")


@query("economic_lot_size", f"WITH {LOTTED}\nSELECT p_partkey, CAST(lot AS INTEGER) AS lot, source FROM el")
def economic_lot_size(spark, sf_dir: str) -> DataFrame:
    return economic(spark, sf_dir).select("p_partkey", "lot", "source")


@query("order_quantity", f"WITH {LOTTED}, oq AS (SELECT p_partkey, exchange, multiplier, CASE WHEN p_partkey % 2 = 0 THEN 5000.0 ELSE 130.0 END AS units FROM el)\nSELECT p_partkey, CAST(CASE WHEN exchange = 'NFO' THEN units WHEN abs(units / multiplier - round(units / multiplier)) > 1e-9 OR round(units / multiplier) < 1 THEN NULL ELSE round(units / multiplier) END AS BIGINT) AS quantity FROM oq")
def order_quantity(spark, sf_dir: str) -> DataFrame:
    """Units to lots where a venue orders in lots; NULL where they are not whole lots or the lot is not known."""
    units = F.when(F.col("p_partkey") % 2 == 0, 5000.0).otherwise(130.0)
    lots = units / F.col("multiplier")
    whole = (F.abs(lots - F.round(lots)) <= 1e-9) & (F.round(lots) >= 1)
    return economic(spark, sf_dir).select("p_partkey", F.when(~F.col("exchange").isin(*IN_LOTS), units).when(whole, F.round(lots)).cast("long").alias("quantity"))


#: Fixed trading hours, local: exchange, time zone, windows in minutes after midnight.
EXCHANGES = (
    ("NSE", "Asia/Kolkata", ((555, 940),)), ("LSE", "Europe/London", ((480, 990),)), ("NYSE", "America/New_York", ((570, 960),)), ("XETRA", "Europe/Berlin", ((540, 1050),)),
    ("TSE", "Asia/Tokyo", ((540, 690), (750, 900))), ("HKEX", "Asia/Hong_Kong", ((570, 720), (780, 960))), ("SGX", "Asia/Singapore", ((540, 1020),)), ("ASX", "Australia/Sydney", ((600, 960),)),
)
JANUARY = {"NSE": 330, "LSE": 0, "NYSE": -300, "XETRA": 60, "TSE": 540, "HKEX": 480, "SGX": 480, "ASX": 660}  # offsets in the month of the events, for the SQL alone
WORLD = "wx AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {JANUARY[c]}, {w[0][0]}, {w[0][1]}, {w[1][0] if w[1:] else -1}, {w[1][1] if w[1:] else -1})" for c, _, w in EXCHANGES) + ") v(code, off, a, b, c, d))"


@query("world_sessions", f"WITH {WORLD}, wt AS (SELECT event_id, code, ts + to_minutes(off) AS lt, a, b, c, d FROM events CROSS JOIN wx), wm AS (SELECT *, hour(lt) * 60 + minute(lt) AS m, isodow(lt) <= 5 AS wd FROM wt)\nSELECT event_id, code, CASE WHEN wd AND ((m >= a AND m < b) OR (m >= c AND m < d)) THEN 'open' WHEN wd AND c >= 0 AND m >= b AND m < c THEN 'lunch' ELSE 'closed' END AS state FROM wm")
def world_sessions(spark, sf_dir: str) -> DataFrame:
    """State of each exchange at each event, by its own clock."""
    rows = [(c, z, w[0][0], w[0][1], w[1][0] if w[1:] else -1, w[1][1] if w[1:] else -1) for c, z, w in EXCHANGES]
    dim = spark.createDataFrame(rows, "code string, zone string, a int, b int, c int, d int")
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(dim))  # eight rows
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.col("zone"))
    m, weekday = F.hour(local) * 60 + F.minute(local), F.weekday(local) < 5
    within = ((m >= F.col("a")) & (m < F.col("b"))) | ((m >= F.col("c")) & (m < F.col("d")))
    return e.select("event_id", "code", F.when(weekday & within, "open").when(weekday & (F.col("c") >= 0) & (m >= F.col("b")) & (m < F.col("c")), "lunch").otherwise("closed").alias("state"))


LABELS = "lb AS (SELECT p_partkey, upper(p_type) AS symbol, DATE '2026-01-01' + CAST(p_size * 9 AS INTEGER) AS expiry, p_size * 25 / 2.0 AS strike, ['EQ', 'FUT', 'CE', 'PE'][CAST(p_partkey % 4 AS INTEGER) + 1] AS kind FROM part)"
PLAIN_STRIKE = "regexp_replace(regexp_replace(CAST(CAST(strike AS DECIMAL(12, 2)) AS VARCHAR), '0+$', ''), '\\.$', '')"


def labelled(spark, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("EQ", "FUT", "CE", "PE"))), (k % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_type").alias("symbol"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("p_size") * 9).cast("int")).alias("expiry"), (F.col("p_size") * 25 / 2.0).alias("strike"), kind.alias("kind"))


@query("instrument_label", f"WITH {LABELS}\nSELECT p_partkey, CASE WHEN kind = 'EQ' THEN symbol ELSE symbol || ' ' || upper(strftime(expiry, '%d%b%y')) || CASE WHEN kind = 'FUT' THEN '' ELSE ' ' || {PLAIN_STRIKE} END || ' ' || kind END AS label FROM lb")
def instrument_label(spark, sf_dir: str) -> DataFrame:
    """Like NIFTY 18AUG26 24500 CE."""
    plain = F.regexp_replace(F.regexp_replace(F.col("strike").cast("decimal(12,2)").cast("string"), "0+$", ""), r"\.$", "")
    strike = F.when(F.col("kind") != "FUT", plain)
    named = F.concat_ws(" ", "symbol", F.upper(F.date_format("expiry", "ddMMMyy")), strike, "kind")
    return labelled(spark, sf_dir).select("p_partkey", F.when(F.col("kind") == "EQ", F.col("symbol")).otherwise(named).alias("label"))


@query("instrument_expired", f"WITH {LABELS}\nSELECT p_partkey, kind <> 'EQ' AND expiry < DATE '2026-06-01' AS expired FROM lb")
def instrument_expired(spark, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("p_partkey", ((F.col("kind") != "EQ") & (F.col("expiry") < F.lit("2026-06-01").cast("date"))).alias("expired"))


@query("denormalize_symbol", "SELECT DISTINCT p_brand, CASE p_brand WHEN 'Brand#13' THEN 'NIFTY' ELSE regexp_replace(p_brand || CASE WHEN p_partkey % 2 = 0 THEN '.NS' ELSE '' END, '\\.NS$', '') END AS name FROM part")
def denormalize_symbol(spark, sf_dir: str) -> DataFrame:
    """The name behind a ticker: an index by its alias, others without their suffix."""
    aliases = F.create_map(F.lit("Brand#13"), F.lit("NIFTY"))
    ticker = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, ".NS").otherwise(""))
    return table(spark, sf_dir, "part").select("p_brand", F.coalesce(aliases[F.col("p_brand")], F.regexp_replace(ticker, r"\.NS$", "")).alias("name")).distinct()


@query("symbol_news", "SELECT s_suppkey, CASE s_suppkey WHEN 1 THEN 'first supplier' WHEN 2 THEN 'second supplier' ELSE s_name END || ' stock' AS search FROM supplier")
def symbol_news(spark, sf_dir: str) -> DataFrame:
    """What is searched for: a symbol's alias, or its name."""
    aliases = F.create_map(F.lit(1), F.lit("first supplier"), F.lit(2), F.lit("second supplier"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.coalesce(aliases[F.col("s_suppkey").cast("int")], F.col("s_name")), F.lit(" stock")).alias("search"))


@query("spot_or_refusal", rounded_sql("\nSELECT event_id, CASE WHEN value - 50 > 0 THEN value - 50 END AS spot, CASE WHEN value - 50 > 0 THEN 'ok' ELSE 'refused: no price' END AS status FROM events", "spot"))
def spot_or_refusal(spark, sf_dir: str) -> DataFrame:
    good = F.col("value") - 50 > 0
    return rounded(table(spark, sf_dir, "events").select("event_id", F.when(good, F.col("value") - 50).alias("spot"), F.when(good, "ok").otherwise("refused: no price").alias("status")))


@query("history_clamped", rounded_sql(f"WITH {BARS}, lm AS (SELECT symbol, max(dt) AS last FROM bars GROUP BY 1)\nSELECT symbol, dt, close FROM bars JOIN lm USING (symbol) WHERE dt >= greatest(DATE '1995-01-01', last - 400)", "close"))
def history_clamped(spark, sf_dir: str) -> DataFrame:
    """Bars from a date on, but no more days than the source gives."""
    b = bars(spark, sf_dir)
    last = b.groupBy("symbol").agg(F.max("dt").alias("last"))
    return rounded(b.join(last, "symbol").where(F.col("dt") >= F.greatest(F.lit("1995-01-01").cast("date"), F.date_sub("last", 400))).select("symbol", "dt", "close"))


@query("day_oi_before", f"WITH {CHAIN}\nSELECT strike, max(ts) AS ts, max_by(call_oi, ts) AS call_oi FROM chain WHERE ts < DATE '1996-06-01' GROUP BY 1")
def day_oi_before(spark, sf_dir: str) -> DataFrame:
    """The last open interest strictly before a day, by strike."""
    return chain(spark, sf_dir).where("ts < DATE '1996-06-01'").groupBy("strike").agg(F.max("ts").alias("ts"), F.max_by("call_oi", "ts").alias("call_oi"))


@query("backfill_prev_close_oi", f"WITH {CHAIN}, pv AS (SELECT a.ts, a.strike, max_by(b.call_oi, b.ts) AS prev_oi FROM chain a JOIN chain b ON a.strike = b.strike AND b.ts < a.ts GROUP BY 1, 2)\nSELECT ts, strike, prev_oi FROM pv WHERE NOT (year(ts) = 1995)")
def backfill_prev_close_oi(spark, sf_dir: str) -> DataFrame:
    """Each contract's open interest of the snapshot before, for days that have none stored yet."""
    before = Window.partitionBy("strike").orderBy("ts")
    c = chain(spark, sf_dir).select("ts", "strike", F.lag("call_oi").over(before).alias("prev_oi")).where("prev_oi IS NOT NULL")
    stored = c.where(F.year("ts") == 1995).select("ts").distinct()
    return c.join(stored, "ts", "left_anti")


@query("resolve_chain", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'broker' WHEN o_orderkey % 3 = 1 THEN 'exchange' END AS source, CASE WHEN o_orderkey % 3 = 2 THEN 'refused: broker: no session; exchange: empty' ELSE 'ok' END AS status FROM orders")
def resolve_chain(spark, sf_dir: str) -> DataFrame:
    """The first source that answers, or the reasons of all."""
    k = F.col("o_orderkey")
    tries = F.array(F.struct(F.lit("broker").alias("source"), F.when(k % 3 == 0, None).otherwise("no session").alias("why")), F.struct(F.lit("exchange").alias("source"), F.when(k % 3 == 1, None).otherwise("empty").alias("why")))
    good = F.get(F.filter(tries, lambda t: t["why"].isNull()), F.lit(0))
    why = F.concat(F.lit("refused: "), F.array_join(F.transform(tries, lambda t: F.concat_ws(": ", t["source"], t["why"])), "; "))
    return table(spark, sf_dir, "orders").select("o_orderkey", good["source"].alias("source"), F.when(good.isNull(), why).otherwise("ok").alias("status"))


@query("quotes_that_failed", "SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE CAST(doc_id AS VARCHAR) END AS DOUBLE) AS price FROM documents")
def quotes_that_failed(spark, sf_dir: str) -> DataFrame:
    """A price that cannot be read is NULL and spoils no other."""
    raw = F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.try_cast("double").alias("price"))


@query("basket_margin", rounded_sql("\nSELECT o_orderkey, o_totalprice * 0.12 AS initial, o_totalprice * 0.001 * (o_orderkey % 200) AS final, greatest(o_totalprice * 0.12 - o_totalprice * 0.001 * (o_orderkey % 200), 0) AS hedge_benefit FROM orders", "initial", "final", "hedge_benefit", digits=6))
def basket_margin(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.12).alias("initial"), (F.col("o_totalprice") * 0.001 * (F.col("o_orderkey") % 200)).alias("final"))
    return rounded(o.withColumn("hedge_benefit", F.greatest(F.col("initial") - F.col("final"), F.lit(0.0))), 6)


@query("commodities", rounded_sql(f"WITH {BARS}, q AS (SELECT symbol, dt, close, {LAG} AS prev, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS rn FROM bars)\nSELECT symbol, dt, close, 100 * (close / prev - 1) AS change FROM q WHERE rn = 1", "close", "change"))
def commodities(spark, sf_dir: str) -> DataFrame:
    """The front future of each name with its change."""
    w = Window.partitionBy("symbol").orderBy("dt")
    q = bars(spark, sf_dir).withColumn("prev", F.lag("close").over(w)).withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt"))))
    return rounded(q.where("rn = 1").select("symbol", "dt", "close", (100 * (F.col("close") / F.col("prev") - 1)).alias("change")))


@query("company_margins", rounded_sql("\nSELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS y, 100 * sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / nullif(sum(o_totalprice), 0) AS net_margin FROM orders GROUP BY 1, 2", "net_margin"))
def company_margins(spark, sf_dir: str) -> DataFrame:
    own = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0))
    return rounded(table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg((100 * F.try_divide(own, F.sum("o_totalprice"))).alias("net_margin")))


@query("company_peers", "SELECT a, peer FROM (SELECT a.c_custkey AS a, b.c_custkey AS peer, row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.c_custkey) AS rn FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey WHERE a.c_custkey <= 5) t WHERE rn <= 24")
def company_peers(spark, sf_dir: str) -> DataFrame:
    """Up to 24 companies of the same industry: only the first 25 of an industry can be."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    first = c.withColumn("rn", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))).where("rn <= 25").select(F.col("c_custkey").alias("peer"), "c_mktsegment")
    both = c.where("c_custkey <= 5").select(F.col("c_custkey").alias("a"), "c_mktsegment").join(first, "c_mktsegment").where("a != peer")
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy("peer"))).where("rn <= 24").select("a", "peer")


@query("provenance", f"WITH {BARS}\nSELECT symbol, 'mean(close)' AS formula, 'bars' AS source, CAST(count(*) AS VARCHAR) AS n FROM bars GROUP BY 1")
def provenance(spark, sf_dir: str) -> DataFrame:
    """A value with what it was made from."""
    p = F.struct(F.lit("mean(close)").alias("formula"), F.create_map(F.lit("n"), F.count(F.lit(1)).cast("string")).alias("inputs"), F.lit("bars").alias("source"))
    return bars(spark, sf_dir).groupBy("symbol").agg(p.alias("p")).select("symbol", "p.formula", "p.source", F.col("p.inputs")["n"].alias("n"))


@query("universe_closes", rounded_sql(f"WITH {BARS}, u AS (SELECT DISTINCT p_type AS symbol FROM part)\nSELECT symbol, dt, close FROM bars JOIN u USING (symbol)", "close"))
def universe_closes(spark, sf_dir: str) -> DataFrame:
    """Closes of all symbols of a universe."""
    universe = table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol"))
    return rounded(bars(spark, sf_dir).join(universe, "symbol", "left_semi").select("symbol", "dt", "close"))


#: A log of subscriptions: each order is a client's asking for, or leaving, a symbol.
LOG = "sl AS (SELECT o_orderkey AS seq, o_custkey % 40 AS client, upper(o_orderpriority) AS symbol, o_orderstatus <> 'F' AS wants FROM orders), cur AS (SELECT client, symbol, max_by(wants, seq) AS wants FROM sl GROUP BY 1, 2)"


def held(spark, sf_dir: str) -> DataFrame:
    """client, symbol, wants: the newest word of each client on each symbol."""
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 40).alias("client"), F.upper("o_orderpriority").alias("symbol"), (F.col("o_orderstatus") != "F").alias("wants"))
    return log.groupBy("client", "symbol").agg(F.max_by("wants", "seq").alias("wants"))


@query("bus_subscriptions", f"WITH {LOG}\nSELECT symbol, CAST(count(*) AS BIGINT) AS refs FROM cur WHERE wants GROUP BY 1")
def bus_subscriptions(spark, sf_dir: str) -> DataFrame:
    """How many clients hold each symbol now."""
    return held(spark, sf_dir).where("wants").groupBy("symbol").agg(F.count(F.lit(1)).alias("refs"))


@query("bus_unsubscribe", f"WITH {LOG}, kept AS (SELECT symbol, count(CASE WHEN wants AND client >= 30 THEN 1 END) AS refs FROM cur GROUP BY 1)\nSELECT symbol, CAST(refs AS BIGINT) AS refs, refs = 0 AS upstream_leaves FROM kept")
def bus_unsubscribe(spark, sf_dir: str) -> DataFrame:
    """After most clients left: the last to leave a symbol leaves it upstream as well."""
    refs = F.count_if(F.col("wants") & (F.col("client") >= 30))
    return held(spark, sf_dir).groupBy("symbol").agg(refs.alias("refs"), (refs == 0).alias("upstream_leaves"))


@query("bus_remove_client", f"WITH {LOG}\nSELECT client, symbol FROM cur WHERE wants AND client NOT IN (1, 2, 3)")
def bus_remove_client(spark, sf_dir: str) -> DataFrame:
    gone = spark.createDataFrame([(1,), (2,), (3,)], "client long")
    return held(spark, sf_dir).where("wants").select("client", "symbol").join(F.broadcast(gone), "client", "left_anti")


@query("bus_push_drop_oldest", f"WITH {TICKS}, q AS (SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY event_id DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)\nSELECT symbol, event_id, CAST(greatest(n - 200, 0) AS BIGINT) AS dropped FROM q WHERE rn <= 200")
def bus_push(spark, sf_dir: str) -> DataFrame:
    """A queue of 200 messages for each symbol: the oldest are dropped and counted."""
    w = Window.partitionBy("symbol")
    q = ticks(spark, sf_dir).select("symbol", "event_id").withColumns({"rn": F.row_number().over(w.orderBy(F.desc("event_id"))), "n": F.count(F.lit(1)).over(w)})
    return q.where("rn <= 200").select("symbol", "event_id", F.greatest(F.col("n") - 200, F.lit(0)).alias("dropped"))


@query("bus_broadcast", f"WITH {LOG}\nSELECT DISTINCT client, 'market closes' AS message FROM cur")
def bus_broadcast(spark, sf_dir: str) -> DataFrame:
    message = spark.createDataFrame([("market closes",)], "message string")
    return held(spark, sf_dir).select("client").distinct().crossJoin(F.broadcast(message))


@query("bus_resolve", "SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 101 WHEN '2-HIGH' THEN 102 END, CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 203 END) AS token FROM orders")
def bus_resolve(spark, sf_dir: str) -> DataFrame:
    """The feed's own token of a symbol, or else the master's."""
    feed = spark.createDataFrame([("1-URGENT", 101), ("2-HIGH", 102)], "o_orderpriority string, f int")
    master = spark.createDataFrame([("2-HIGH", 203), ("3-MEDIUM", 203)], "o_orderpriority string, m int")
    o = table(spark, sf_dir, "orders").join(F.broadcast(feed), "o_orderpriority", "left").join(F.broadcast(master), "o_orderpriority", "left")
    return o.select("o_orderkey", F.coalesce("f", "m").alias("token"))


@query("bus_stats", f"WITH {LOG}, {TICKS}\nSELECT (SELECT CAST(count(DISTINCT client) AS BIGINT) FROM cur WHERE wants) AS clients, (SELECT CAST(count(DISTINCT symbol) AS BIGINT) FROM cur WHERE wants) AS symbols, (SELECT CAST(count(*) AS BIGINT) FROM ticks) AS ticks")
def bus_stats(spark, sf_dir: str) -> DataFrame:
    now = held(spark, sf_dir).where("wants").agg(F.count_distinct("client").alias("clients"), F.count_distinct("symbol").alias("symbols"))
    return now.crossJoin(ticks(spark, sf_dir).agg(F.count(F.lit(1)).alias("ticks")))


@query("ticker_subscribe", f"WITH {LOG}\nSELECT symbol FROM cur WHERE wants AND client < 5 EXCEPT SELECT symbol FROM cur WHERE wants AND client = 39")
def ticker_subscribe(spark, sf_dir: str) -> DataFrame:
    """What is wanted and not held."""
    h = held(spark, sf_dir).where("wants")
    return h.where("client < 5").select("symbol").subtract(h.where("client = 39").select("symbol"))


@query("ticker_unsubscribe", f"WITH {LOG}\nSELECT symbol FROM cur WHERE wants AND client = 7 INTERSECT SELECT symbol FROM cur WHERE wants AND client < 5")
def ticker_unsubscribe(spark, sf_dir: str) -> DataFrame:
    """What is given up and held."""
    h = held(spark, sf_dir).where("wants")
    return h.where("client = 7").select("symbol").intersect(h.where("client < 5").select("symbol"))


@query("alert_fire_once", f"WITH {TICKS}, a AS (SELECT * FROM (VALUES ('click', 150.0, TRUE), ('view', 40.0, FALSE), ('purchase', 1e9, TRUE)) v(symbol, level, above)), f AS (SELECT ticks.symbol, event_id, ltp, row_number() OVER (PARTITION BY ticks.symbol, level ORDER BY event_id) AS rn FROM ticks JOIN a ON a.symbol = ticks.symbol AND CASE WHEN above THEN ltp >= level ELSE ltp <= level END)\nSELECT symbol, event_id, round(ltp, 6) AS ltp FROM f WHERE rn = 1")
def alert_fire_once(spark, sf_dir: str) -> DataFrame:
    """An alert fires at the first tick that meets it, and not again."""
    alerts = spark.createDataFrame([("click", 150.0, True), ("view", 40.0, False), ("purchase", 1e9, True)], "symbol string, level double, above boolean")
    met = F.when(F.col("above"), F.col("ltp") >= F.col("level")).otherwise(F.col("ltp") <= F.col("level"))
    hit = ticks(spark, sf_dir).join(F.broadcast(alerts), "symbol").where(met)
    return rounded(hit.groupBy("symbol", "level").agg(F.min_by(F.struct("event_id", "ltp"), "event_id").alias("t")).select("symbol", "t.event_id", "t.ltp"))


#: Monthly dumps of the contracts of a chain: which sides of a strike are listed.
DUMPS = f"{CHAIN}, du AS (SELECT ts AS day, strike, call_oi > 0 AS has_call, put_oi > 0 AS has_put FROM chain)"
LIVES = f"""{DUMPS}, dd AS (SELECT day, row_number() OVER (ORDER BY day) AS n, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM du) d),
 dl AS (SELECT du.*, n, nxt, CASE WHEN lag(n) OVER w = n - 1 AND lag(has_call) OVER w = has_call AND lag(has_put) OVER w = has_put THEN 0 ELSE 1 END AS fresh FROM du JOIN dd USING (day) WINDOW w AS (PARTITION BY strike ORDER BY n)),
 di AS (SELECT *, sum(fresh) OVER (PARTITION BY strike ORDER BY n) AS island FROM dl),
 lives AS (SELECT strike, any_value(has_call) AS has_call, any_value(has_put) AS has_put, min(day) AS valid_from, max_by(coalesce(nxt, DATE '9999-12-31'), n) AS upto FROM di GROUP BY strike, island)"""


def dumps(spark, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir).select(F.col("ts").alias("day"), "strike", (F.col("call_oi") > 0).alias("has_call"), (F.col("put_oi") > 0).alias("has_put"))


@query("contract_lives", f"WITH {LIVES}\nSELECT strike, has_call, has_put, valid_from, nullif(upto, DATE '9999-12-31') AS valid_to FROM lives")
def contract_lives(spark, sf_dir: str) -> DataFrame:
    """How long each strike was listed with the same sides, from monthly dumps."""
    return archive.lives(dumps(spark, sf_dir), ["strike"])


@query("contract_as_of", f"WITH {LIVES}, asked AS (SELECT CAST(900 + 2 * p_size AS DOUBLE) AS strike, CAST(l_shipdate AS DATE) + 20 AS day FROM lineitem JOIN part ON l_partkey = p_partkey)\nSELECT a.strike, a.day, has_call, has_put, CAST(count(*) AS BIGINT) AS n FROM asked a LEFT JOIN lives l ON l.strike = a.strike AND valid_from <= a.day AND a.day < upto GROUP BY ALL")
def contract_as_of(spark, sf_dir: str) -> DataFrame:
    """What the archive knew of a trade's strike on the day of its settlement, 20 days on, counted."""
    trades = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    asked = trades.select((900 + 2 * F.col("p_size")).cast("double").alias("strike"), F.date_add(F.to_date("l_shipdate"), 20).alias("day")).groupBy("strike", "day").agg(F.count(F.lit(1)).alias("n"))
    return archive.looked_up(asked, archive.lives(dumps(spark, sf_dir), ["strike"]), ["strike"], "day")
