"""Parsers of raw inputs as columns: contract lists, participant and constituent files, chain, quote and news JSON, binary tick frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_text, unescaped

#: Fixed column names of the contract list, all of which must be there.
INSTRUMENT_COLUMNS = ("instrument_token", "tradingsymbol", "name", "expiry", "strike", "lot_size", "instrument_type")
#: Fixed names of the participant file's columns, and ours.
PARTICIPANT_COLUMNS = {
    "Client Type": "client_type", "Future Index Long": "fut_idx_long", "Future Index Short": "fut_idx_short", "Option Index Call Long": "opt_idx_call_long",
    "Option Index Put Long": "opt_idx_put_long", "Option Index Call Short": "opt_idx_call_short", "Option Index Put Short": "opt_idx_put_short",
}
#: Fixed layouts of packets by size: mode, and the places of their fields after the token. Prices are in hundredths.
PRICES = ("ltp", "high", "low", "open", "close")
LAYOUTS = {
    8: ("ltp", {"ltp": 4}),
    28: ("index", {"ltp": 4, "high": 8, "low": 12, "open": 16, "close": 20}),
    32: ("index", {"ltp": 4, "high": 8, "low": 12, "open": 16, "close": 20}),
    44: ("quote", {"ltp": 4, "volume": 16, "open": 28, "high": 32, "low": 36, "close": 40}),
    184: ("full", {"ltp": 4, "volume": 16, "open": 28, "high": 32, "low": 36, "close": 40, "oi": 48}),
}


def csv_rows(lines: DataFrame, names: list[str], wanted: tuple[str, ...], key: list[str] | None = None) -> DataFrame:
    """Rows of CSV lines (column value) whose header is `names`; lines that repeat the header are left out."""
    missing = [w for w in wanted if w not in [n.strip() for n in names]]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    schema = ", ".join(f"`{n.strip()}` string" for n in names)
    rows = lines.where(F.trim("value") != "").select(*(key or []), F.from_csv("value", schema).alias("r")).select(*(key or []), "r.*")
    first = names[0].strip()
    return rows.where(F.trim(first) != first)


def number(x: Column | str, kind: str = "double") -> Column:
    """A number, 0 where it is none."""
    return F.coalesce((F.col(x) if isinstance(x, str) else x).try_cast(kind), F.lit(0).cast(kind))


def instruments(lines: DataFrame, names: list[str]) -> DataFrame:
    """Contracts: expiry is a date (NULL where it is none), strike and lot size are numbers (0 where they are none)."""
    r = csv_rows(lines, names, INSTRUMENT_COLUMNS)
    return r.select("instrument_token", "tradingsymbol", "name", F.try_to_date("expiry", "yyyy-MM-dd").alias("expiry"), number("strike").alias("strike"), number("lot_size", "int").alias("lot_size"), "instrument_type")


def trading_symbols(asked: DataFrame, contracts: DataFrame) -> DataFrame:
    """asked (name, expiry, instrument_type, strike) with their tradingsymbol, NULL where there is no such contract."""
    return asked.join(contracts.select("name", "expiry", "instrument_type", "strike", "tradingsymbol"), ["name", "expiry", "instrument_type", "strike"], "left")


def lot_sizes(contracts: DataFrame) -> DataFrame:
    """name, expiry, lot_size: NULL, with a reason, where contracts disagree."""
    one = F.min("lot_size") == F.max("lot_size")
    return contracts.groupBy("name", "expiry").agg(F.when(one, F.min("lot_size")).alias("lot_size"), F.when(~one, "contracts disagree").alias("reason"))


def participant_rows(lines: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """Positions by client class: the title line and the total go, counts that are no number are 0, and nets follow."""
    header = [n.strip() for n in names]
    table_lines = lines.where(~F.col("value").startswith('"'))
    r = csv_rows(table_lines, header, tuple(PARTICIPANT_COLUMNS), key)
    r = r.select(*key, *(F.trim(n).alias(c) if c == "client_type" else number(F.trim(n), "long").alias(c) for n, c in PARTICIPANT_COLUMNS.items())).where(F.upper("client_type") != "TOTAL")
    long, short = F.col("opt_idx_call_long") + F.col("opt_idx_put_short"), F.col("opt_idx_call_short") + F.col("opt_idx_put_long")
    return r.withColumns({"idx_fut_net": F.col("fut_idx_long") - F.col("fut_idx_short"), "idx_opt_net": long - short})


def constituents(lines: DataFrame, names: list[str], index: str) -> DataFrame:
    r = csv_rows(lines, names, ("Company Name", "Industry", "Symbol"))
    return r.select(F.trim("Symbol").alias("symbol"), F.trim("Company Name").alias("name"), F.lit(index).alias("index_name"), F.trim("Industry").alias("industry"))


SIDE = "struct<lastPrice:double,openInterest:double,impliedVolatility:double>"
CHAIN_JSON = f"struct<records:struct<underlyingValue:double,expiryDates:array<string>,data:array<struct<strikePrice:double,expiryDate:string,CE:{SIDE},PE:{SIDE}>>>>"


def chain_rows(payloads: DataFrame, key: list[str]) -> DataFrame:
    """The strikes of the first expiry of chain payloads (column json): a volatility of 0 is NULL, others are shares. A side that is missing is 0."""
    r = payloads.select(*key, F.from_json("json", CHAIN_JSON).alias("p")).select(*key, F.col("p.records.underlyingValue").alias("spot"), F.col("p.records.expiryDates")[0].alias("first"), F.inline("p.records.data"))
    side = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.lit(0.0))
    iv = lambda s: F.when(side(s, "impliedVolatility") > 0, side(s, "impliedVolatility") / 100)
    return r.where("expiryDate = first AND spot > 0").select(
        *key, "spot", F.try_to_date("first", "yyyy-MM-dd").alias("expiry"), F.col("strikePrice").alias("strike"),
        *(x.alias(f"{n}_{f}") for s, n in (("CE", "call"), ("PE", "put")) for f, x in (("ltp", side(s, "lastPrice")), ("oi", side(s, "openInterest")), ("iv", iv(s)))),
    )


NEWS_JSON = "struct<title:string,link:string,publisher:string,content:struct<title:string,canonicalUrl:struct<url:string>,provider:struct<displayName:string>>>"


def news_rows(payloads: DataFrame, key: list[str]) -> DataFrame:
    """Flat rows of news JSON of either shape; without a title there is no row."""
    r = payloads.select(*key, F.from_json("json", NEWS_JSON).alias("n"))
    r = r.select(*key, F.coalesce("n.content.title", "n.title").alias("title"), F.coalesce("n.content.canonicalUrl.url", "n.link").alias("link"), F.coalesce("n.content.provider.displayName", "n.publisher").alias("publisher"))
    return r.where("title IS NOT NULL")


ITEM_XML = "ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING, source: STRUCT<_VALUE: STRING, _url: STRING>>>"
FEED_XML = f"channel STRUCT<item: {ITEM_XML}>, item {ITEM_XML}, broken STRING"
#: Fixed names of months and zones (hours from UTC) in the dates of mails and feeds.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def mail_time(x: Column) -> Column:
    """The moment of a mail's date (`Tue, 05 Mar 2024 10:00:00 +0530`; the weekday and seconds may be left out): UTC without a zone or with one
    that is unknown, years of two digits are from 1969 to 2068. NULL where it is no date."""
    part = lambda i: F.regexp_extract(x, r"^\s*(?:[A-Za-z]+,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Za-z]+)?", i)
    whole = lambda i: part(i).try_cast("int")
    year = F.when(F.length(part(3)) == 4, whole(3)).otherwise(whole(3) + F.when(whole(3) < 69, 2000).otherwise(1900))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2))), F.lit(0)).cast("int")
    at = F.try_make_timestamp(year, month, whole(1), whole(4), whole(5), F.coalesce(whole(6), F.lit(0)).cast("decimal(16,6)"), F.lit("UTC"))
    named = F.create_map(*(F.lit(v) for name, hours in ZONES.items() for v in (name, hours * 3600)))
    digits = F.substring(part(7), 2, 2).try_cast("int") * 3600 + F.substring(part(7), 4, 2).try_cast("int") * 60
    ahead = F.when(part(7).startswith("-"), -digits).when(part(7).startswith("+"), digits).otherwise(F.coalesce(F.try_element_at(named, F.upper(part(7))), F.lit(0)))
    return F.timestamp_micros(F.unix_micros(at) - ahead.cast("long") * 1_000_000)


def feeds(payloads: DataFrame, key: list[str]) -> DataFrame:
    """key, items, broken (the text, if it is no XML): feeds (column xml) whose items are in a channel or beside it. Other elements are not read."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true"}
    r = payloads.select(*key, F.from_xml("xml", FEED_XML, options).alias("_feed"))
    none = F.array().cast(ITEM_XML)
    items = F.concat(F.coalesce("_feed.channel.item", none), F.coalesce("_feed.item", none))
    return r.select(*key, F.when(F.col("_feed.broken").isNull(), items).otherwise(none).alias("items"), F.col("_feed.broken").alias("broken"))


def feed_items(payloads: DataFrame, key: list[str]) -> DataFrame:
    """key, place (from 0), title, link, source, published, description: a row for each item of feeds (column xml); none for a broken feed.

    A title loses a publisher that it ends with, a description its tags, and all of itself if it begins as the title does (60
    letters and digits of it). Without a date that can be read, published is NULL; other missing fields are empty.
    """
    r = feeds(payloads, key).select(*key, F.posexplode("items").alias("place", "_item"))
    field = lambda n: F.coalesce(F.col(n), F.lit(""))
    r = r.select(*key, "place", field("_item.title").alias("title"), field("_item.link").alias("link"), field("_item.source._VALUE").alias("source"), field("_item.description").alias("d"), mail_time(F.col("_item.pubDate")).alias("published"))
    echoed = (F.col("source") != "") & F.endswith(F.col("title"), F.concat(F.lit(" - "), F.col("source")))
    bare = F.when(echoed, F.expr("left(title, length(title) - length(source) - 3)")).otherwise(F.col("title"))
    r = r.withColumns({"title": F.trim(unescaped(bare)), "description": plain_text(F.replace(F.col("d"), F.lit("\u00a0"), F.lit(" ")))})
    key_of = lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", "")
    repeats = F.startswith(key_of("description"), F.substring(key_of("title"), 1, 60))
    return r.select(*key, "place", "title", "link", F.trim("source").alias("source"), "published", F.when(repeats, "").otherwise(F.col("description")).alias("description"))


def big_endian(data: Column, at: Column, size: int) -> Column:
    """A signed big-endian integer of bytes that begin at a place, from 0."""
    n = F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).cast("long")
    return F.when(n >= 1 << (8 * size - 1), n - (1 << 8 * size)).otherwise(n)


def packets(frame: Column) -> Column:
    """array<struct<at, size>> of a frame: a number of packets, each behind its length. What a torn frame lacks is left out."""
    n = F.when(F.octet_length(frame) >= 2, big_endian(frame, F.lit(0), 2)).otherwise(0)
    empty = F.array().cast("array<struct<at:int,size:int>>")

    def step(a: Column, _: Column) -> Column:
        size = F.when(a["at"] + 2 <= F.octet_length(frame), big_endian(frame, a["at"], 2)).otherwise(0).cast("int")
        whole = a["open"] & (size >= 8) & (a["at"] + 2 + size <= F.octet_length(frame))
        found = F.when(whole, F.concat(a["found"], F.array(F.struct((a["at"] + 2).alias("at"), size.alias("size"))))).otherwise(a["found"])
        return F.struct(F.when(whole, a["at"] + 2 + size).otherwise(a["at"]).cast("int").alias("at"), whole.alias("open"), found.alias("found"))

    start = F.struct(F.lit(2).alias("at"), F.lit(True).alias("open"), empty.alias("found"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), start, step, lambda a: a["found"])).otherwise(empty)


def ticks(frames: DataFrame, key: list[str]) -> DataFrame:
    """Ticks of binary frames (column frame): token, mode, prices, volume, oi. Packets of an unknown size are left out."""
    rows = frames.select(*key, "frame", F.posexplode(packets(F.col("frame"))).alias("packet", "p")).select(*key, "packet", "frame", "p.*")
    value = lambda at: big_endian(F.col("frame"), F.col("at") + at, 4)

    def field(name: str) -> Column:
        out = F.lit(None)
        for size, (_, places) in LAYOUTS.items():
            if name in places:
                out = F.when(F.col("size") == size, value(places[name]) / 100 if name in PRICES else value(places[name])).otherwise(out)
        return out.cast("double" if name in PRICES else "long").alias(name)

    mode = F.create_map(*(F.lit(x) for size, (m, _) in LAYOUTS.items() for x in (size, m)))[F.col("size")]
    return rows.where(F.col("size").isin(*LAYOUTS)).select(*key, "packet", value(0).alias("token"), mode.alias("mode"), *map(field, (*PRICES, "volume", "oi")))


def frame(parts: Column) -> Column:
    """The binary frame of an array of packets."""
    short = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    return F.concat(short(F.size(parts)), F.unhex(F.array_join(F.transform(parts, lambda p: F.concat(F.lpad(F.hex(F.octet_length(p)), 4, "0"), F.hex(p))), "")))


def packet(size: int, token: Column, fields: dict[str, Column]) -> Column:
    """A packet of a size: the token, and prices and numbers at their places; other bytes are 0."""
    places = {0: token} | {at: F.round(fields[n] * 100).cast("long") if n in PRICES else fields[n] for n, at in LAYOUTS.get(size, ("", {"ltp": 4}))[1].items() if n in fields}
    words = [F.lpad(F.hex(F.pmod(places[i].cast("long"), F.lit(1 << 32))), 8, "0") if i in places else F.lit("00000000") for i in range(0, size, 4)]
    return F.unhex(F.concat(*words))


def change_pct(ltp: Column, close: Column) -> Column:
    return F.coalesce(F.try_divide(ltp, F.when(close > 0, close)) - 1, F.lit(0.0))
