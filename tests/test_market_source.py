"""Recorded payloads and frames, read offline."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from barloom.queries.feeds import frames, parse_binary
from barloom.sources import market, parsers


@pytest.fixture
def root(tmp_path):
    def put(provider, symbol, month, body):
        file = tmp_path / provider / symbol / f"{month}.json"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(body if isinstance(body, str) else json.dumps(body))

    put("broker", "AAA", "2024-01", {"data": {"candles": [["2024-01-02T00:00:00+0530", 1, 2, 0.5, 1.5, 10], ["2024-01-03T00:00:00+0530", 1.5, 3, 1, 2, 20, 7]]}})
    put("broker", "AAA", "2024-02", "{torn")
    put("broker", "BBB", "2024-01", {"candles": []})
    put("public", "AAA", "2024-01", [{"Date": "2024-01-02", "Open": 9, "High": 9, "Low": 9, "Close": 9, "Volume": 9}])
    put("public", "AAA", "2024-02", {"date": [1706832000, 1706918400], "open": [2, None], "high": [2, 2], "low": [2, 2], "close": [2, 2], "volume": [None, 5]})
    put("public", "BBB", "2024-01", [{"Date": "2024-01-05", "Open": 5, "High": 6, "Low": 4, "Close": 5.5, "Volume": 50}])
    return str(tmp_path)


def test_fallback_chain(spark, root):
    market.register(spark)
    bars = spark.read.format("market_bars").option("providers", "broker,public").load(root)
    assert bars.schema.simpleString() == "struct<symbol:string,dt:date,open:double,high:double,low:double,close:double,volume:bigint,provider:string>"
    got = sorted((r["symbol"], str(r["dt"]), r["close"], r["volume"], r["provider"]) for r in bars.collect())
    assert got == [("AAA", "2024-01-02", 1.5, 10, "broker"), ("AAA", "2024-01-03", 2.0, 20, "broker"), ("AAA", "2024-02-02", 2.0, 0, "public"), ("BBB", "2024-01-05", 5.5, 50, "public")]
    turned = spark.read.format("market_bars").option("providers", "public,broker").load(root)
    assert {r["provider"] for r in turned.collect()} == {"public"}
    assert spark.read.format("market_bars").option("providers", "nobody").load(root).count() == 0
    with pytest.raises(Exception, match="folder of the payloads"):
        spark.read.format("market_bars").load().collect()


def test_filters_are_pushed(spark, root):
    market.register(spark)
    bars = spark.read.format("market_bars").option("providers", "broker,public").load(root)
    some = bars.where((F.col("symbol") == "AAA") & (F.col("dt") > "2024-01-02") & (F.col("dt") < "2024-02-01") & (F.col("close") > 0))
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(symbol,AAA), GreaterThan(dt,2024-01-02), LessThan(dt,2024-02-01)]" in plan
    assert [(r["symbol"], str(r["dt"])) for r in some.collect()] == [("AAA", "2024-01-03")]
    reader = market.BarsReader(root, ["broker", "public"])
    rest = list(reader.pushFilters([market.In(("symbol",), ("AAA", "CCC")), market.GreaterThan(("dt",), datetime.date(2024, 1, 31)), market.EqualTo(("close",), 2.0)]))
    assert rest == [market.EqualTo(("close",), 2.0)] and [(p.symbol, p.month) for p in reader.partitions()] == [("AAA", "2024-02")]
    assert bars.where("symbol = 'AAA' AND symbol = 'BBB'").count() == 0


def test_frames_stream_goes_on_after_a_restart(spark, small, tmp_path):
    """Recordings in two goes, with a restart between, decode to the rows of the query over all frames."""
    market.register(spark)
    table = frames(spark, small)
    rows = [(r["frame_id"], bytes(r["frame"])) for r in table.orderBy("frame_id").collect()]
    (tmp_path / "in").mkdir()

    def record(number, some, torn=b""):
        (tmp_path / "in" / f"{number:06}.frames").write_bytes(b"".join(len(f).to_bytes(4, "big") + f for _, f in some) + torn)

    def run():
        ids = spark.readStream.format("tick_frames").load(str(tmp_path / "in"))
        q = parsers.ticks(ids, ["recording", "number"]).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out"))

    third = len(rows) // 3
    record(0, rows[:third])
    first = run().count()
    record(1, rows[third : 2 * third], torn=b"\x00\x00\x00\x09half")
    record(2, rows[2 * third :])
    got = run()
    begin = {"000000": 0, "000001": third, "000002": 2 * third}
    wanted = ["packet", "token", "mode", "ltp", "close", "volume", "oi"]
    plain = lambda r, i: (i, *(round(x, 2) if isinstance(x := r[c], float) else x for c in wanted))
    have = sorted((plain(r, rows[begin[r["recording"]] + r["number"]][0]) for r in got.collect()), key=repr)
    want = sorted((plain(r, r["frame_id"]) for r in parse_binary(spark, small).collect()), key=repr)
    assert have == want and 0 < first < len(want)
