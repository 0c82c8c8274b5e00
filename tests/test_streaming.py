"""Streams end with the rows of the same query on a table."""

from __future__ import annotations

from barloom.sources.views import ticks
from barloom.streaming import ticks as stream


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, small, tmp_path):
    table = ticks(spark, small).limit(500)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    source = lambda: stream.tick_stream(spark, str(tmp_path / "in"), table.schema)
    newest = run(spark, stream.latest(source()), "latest", "complete")
    assert sorted(newest.collect()) == sorted(stream.latest(table).collect()) != []
    clients = spark.createDataFrame([(1, "click"), (2, "view"), (2, "view")], "client long, symbol string")
    sent = run(spark, stream.routed(source(), clients), "routed", "append")
    assert sorted(sent.collect()) == sorted(stream.routed(table, clients).collect())
    bars = run(spark, stream.minute_bars(source(), "10000 days"), "bars", "complete")
    assert sorted(bars.collect()) == sorted(stream.minute_bars(table).collect()) != []


def test_alerts_fire_once_and_snapshots_are_kept_once(spark, small, tmp_path):
    ticks(spark, small).orderBy("event_id").limit(300).coalesce(1).write.parquet(str(tmp_path / "ticks"))
    table = spark.read.parquet(str(tmp_path / "ticks"))
    symbol = table.first()["symbol"]
    alerts = spark.createDataFrame([(symbol, 0.0, True), (symbol, 1e9, True)], "symbol string, level double, above boolean")
    fired = run(spark, stream.alerts_met(stream.tick_stream(spark, str(tmp_path / "ticks"), table.schema), alerts, "10000 days"), "fired", "append").collect()
    assert len(fired) == 1 and fired[0]["level"] == 0.0
    rows = [(f"2024-01-0{d}", "2024-02-01", float(k)) for d in (1, 2) for k in (1, 2, 2, 1)]
    spark.createDataFrame(rows, "ts string, expiry string, strike double").selectExpr("CAST(ts AS timestamp) AS ts", "CAST(expiry AS date) AS expiry", "strike").coalesce(1).write.parquet(str(tmp_path / "chains"))
    chains = spark.read.parquet(str(tmp_path / "chains"))
    once = run(spark, stream.snapshots_once(stream.tick_stream(spark, str(tmp_path / "chains"), chains.schema)), "once", "append")
    assert once.count() == 4
