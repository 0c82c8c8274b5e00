"""Stores: round trips, merges, and what is refused."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import recursive, simulate
from barloom.plans.rulespec import Condition, Operand, RuleSpec
from barloom.plans.script import run_script
from barloom.sources import stores


@pytest.fixture
def path(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    return str(tmp_path)


def minute(m: int) -> dt.datetime:
    return dt.datetime(2024, 1, 2 + m // 100, 9, m % 100 % 60)


def test_bars_keep_the_last_of_a_minute(spark, path):
    store = stores.TickStore(path)
    bar = "symbol string, minute timestamp, close double"
    store.write_bars(spark.createDataFrame([("A", minute(15), 1.0), ("A", minute(16), 2.0), ("A", minute(115), 9.0), ("B", minute(15), 5.0)], bar))
    store.write_bars(spark.createDataFrame([("A", minute(16), 3.0), ("A", minute(17), 4.0)], bar))
    assert [r["close"] for r in store.read_bars(spark, "A", "2024-01-02").collect()] == [1.0, 3.0, 4.0]
    assert [r["close"] for r in store.read_bars(spark, "A").collect()] == [1.0, 3.0, 4.0, 9.0]
    assert store.read_bars(spark, "B").count() == 1
    store.write_tick_segment(spark.createDataFrame([("A", minute(15), 1.0)], "symbol string, ts timestamp, ltp double"))
    assert spark.read.parquet(store.segments).count() == 1


def test_snapshots_are_stored_once(spark, path):
    store = stores.ChainStore(path)
    schema = "symbol string, ts timestamp, expiry date, strike double, is_model boolean"
    day = dt.date(2024, 1, 30)
    rows = [("A", minute(15), day, 100.0, False), ("A", minute(15), day, 110.0, False), ("A", minute(16), day, 100.0, True)]
    assert store.snapshot(spark.createDataFrame(rows, schema)).count() == 2
    assert store.snapshot(spark.createDataFrame([*rows[:2], ("A", minute(20), day, 100.0, False)], schema)).count() == 1
    assert store.snapshots_of(spark, "A", "2024-01-02").count() == 3
    one = spark.createDataFrame(rows[:1], schema).drop("symbol", "is_model")
    assert store.write_day_snapshot(one, "B", "2024-01-03") and not store.write_day_snapshot(one, "B", "2024-01-03")


def test_history_newest_wins_and_refuses_made_up_bars(spark, path):
    archive = stores.HistoryArchive(path)
    bars = spark.createDataFrame([("A", minute(15), 1.0), ("A", minute(115), 2.0)], "symbol string, dt timestamp, close double")
    archive.upsert(bars, "first")
    archive.upsert(bars.where("close = 2.0").withColumn("close", F.lit(3.0)), "second")
    assert [(r["close"], r["source"]) for r in archive.read(spark, "A").collect()] == [(1.0, "first"), (3.0, "second")]
    with pytest.raises(ValueError):
        archive.upsert(bars, "synthetic")


def test_journal_ledger_and_alerts(spark, path):
    journal = stores.Journal(path)
    day = dt.date(2024, 1, 2)
    entry = lambda n: spark.createDataFrame([("A", day, n, "x")], "symbol string, day date, n int, note string")
    journal.write(entry(1))
    journal.write(entry(2))
    assert [r["entry"]["n"] for r in journal.read(spark, "n int, note string").collect()] == [1]
    assert stores.load_ledger(spark, path, "p").first()["cash"] == 0.0
    fills = spark.createDataFrame([(i, "BUY", 1.0, 2.0) for i in range(600)], "seq long, side string, qty double, price double")
    stores.save_ledger(spark, path, "p", 7.5, spark.createDataFrame([("A", 3.0)], "instrument string, net double"), fills)
    got = stores.load_ledger(spark, path, "p").first()
    assert got["cash"] == 7.5 and got["positions"] == {"A": 3.0} and len(got["journal"]) == 500 and got["journal"][0]["seq"] == 100
    alerts = spark.createDataFrame([("A", "rsi", "<", 30.0, True, None)], "symbol string, metric string, op string, level double, armed boolean, fired_at timestamp")
    stores.save_alerts(alerts, path)
    assert stores.load_alerts(spark, path).collect() == alerts.collect()


def test_lines_that_cannot_be_read_are_kept_apart(spark, path):
    lines = spark.createDataFrame([('{"a": 1}',), ("nothing",), ('{"a": 2}',)], "value string")
    good, bad = stores.quarantined(lines, "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["value"] for r in bad.collect()] == ["nothing"]


def test_what_rules_and_scripts_refuse(spark):
    bars = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0)], "symbol string, dt date, open double, high double, low double, close double, volume double")
    for bad in ({"indicator": "NOTHING"}, {"indicator": "SMA", "period": 1}, {"indicator": "SMA", "period": 201}):
        with pytest.raises(ValueError):
            Operand.of(bad)
    for bad in ({"left": {"indicator": "SMA"}, "op": "~", "value": 1}, {"left": {"indicator": "SMA"}, "op": "<"}, {"left": {"indicator": "SMA"}, "op": "<", "value": 1, "join": "XOR"}):
        with pytest.raises(ValueError):
            Condition.of(bad)
    with pytest.raises(ValueError):
        RuleSpec.of({"direction": "up"})
    for bad in ("import os", "x = close.foo", "__import__('os')", "y = nothing + 1", "for i in close: sma(i, 2)", "x = [1]", "sma(close, 2)" + "\nx = 1" * 200):
        with pytest.raises((ValueError, SyntaxError)):
            run_script(bad, bars)


def test_simulated_gaps_and_stops_come_before_targets(spark):
    """A long from the second bar's open at 100 with a stop of 5 and a target of 10 percent."""
    def run(*after):
        rows = [(0, 99, 99, 99, 99), (1, 100, 101, 99, 100), *((i + 2, *a) for i, a in enumerate(after))]
        frame = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(d), *map(float, x), d == 0, False, False, False) for d, *x in rows], "symbol string, dt date, open double, high double, low double, close double, long_entry boolean, long_exit boolean, short_entry boolean, short_exit boolean")
        done = simulate.simulate(frame, simulate.Execution(stop=("percent", 5.0), target=("percent", 10.0)))
        return [(r["exit_price"], r["exit_reason"]) for r in done.where("exit_reason IS NOT NULL").collect()]

    assert [(round(p, 9), w) for p, w in run((100, 112, 94, 100))] == [(95.0, "stop")]  # both are reached: the stop is taken
    assert run((90, 91, 89, 90)) == [(90.0, "stop")]  # a gap fills at the open
    assert [(round(p, 9), w) for p, w in run((100, 111, 99, 105))] == [(110.0, "target")]
    assert run((115, 116, 114, 115)) == [(115.0, "target")]
    assert run((100, 101, 99, 100.5)) == [(100.5, "end-of-data")]


def test_means_are_missing_until_they_are_warm(spark):
    rows = spark.createDataFrame([("A", i, float(i) if i else None) for i in range(6)], "symbol string, dt int, x double")
    got = [r["m"] for r in recursive.smooth(rows, [("m", "x", 0.5, 2)]).orderBy("dt").collect()]
    assert got[:2] == [None, None] and got[2] == 1.5 and got[3] == 2.25
