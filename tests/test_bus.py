"""Keyed streams: routing, bounded queues and alerts give the rows of plain Python and of the batch, over restarts too."""

from __future__ import annotations

import random
import time

import pytest

from barloom.queries.feeds import bus_push
from barloom.sources.views import ticks
from barloom.streaming import bus

COMMANDS = "symbol string, metric string, client string, seq long, kind string, alert long, op string, level double, value double, event_id long, ltp double, n long"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    bus.stateful(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Stream:
    """Batches of commands through a query that is stopped and started again for each of them."""

    def __init__(self, spark, tmp_path, make, schema=COMMANDS):
        self.spark, self.folder, self.make, self.schema, self.batches = spark, tmp_path, make, schema, 0

    def send(self, rows) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        df = rows if hasattr(rows, "write") else self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], self.schema)
        df.select(*names).coalesce(2).write.mode("append").parquet(str(self.folder / "in"))
        q = self.make(self.spark.readStream.schema(self.schema).parquet(str(self.folder / "in"))).writeStream.format("parquet")
        q = q.option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()

    def rows(self):
        return [r.asDict() for r in self.spark.read.parquet(str(self.folder / "out")).collect()]


def test_refcounts_and_routing(spark, tmp_path):
    """The feed goes on with the first client and off with the last; a tick reaches who wants its symbol then."""
    s = Stream(spark, tmp_path, lambda df: bus.route(df.withColumn("client", df["n"])))
    tick = lambda seq, symbol: {"symbol": symbol, "seq": seq, "kind": "tick", "event_id": seq * 10, "ltp": 1.5}
    ask = lambda seq, kind, symbol, client: {"symbol": symbol, "seq": seq, "kind": kind, "n": client}
    s.send([tick(1, "A"), ask(2, "subscribe", "A", 1), ask(3, "subscribe", "A", 1), tick(4, "A"), ask(5, "subscribe", "A", 2), ask(6, "unsubscribe", "B", 9)])
    s.send([tick(7, "A"), ask(8, "unsubscribe", "A", 1), tick(9, "A"), ask(10, "unsubscribe", "A", 1), ask(11, "unsubscribe", "A", 2), tick(12, "A"), tick(13, "B")])
    got = sorted((r["seq"], r["kind"], r["client"]) for r in s.rows() if r["kind"] == "tick")
    assert got == [(4, "tick", 1), (7, "tick", 1), (7, "tick", 2), (9, "tick", 2)]
    assert sorted((r["seq"], r["kind"], r["symbol"]) for r in s.rows() if r["kind"] != "tick") == [(2, "feed_on", "A"), (11, "feed_off", "A")]


def test_full_queues_drop_the_oldest(spark, tmp_path):
    """200 frames wait; of 205 the first 5 are dropped and counted, over a restart in between."""
    s = Stream(spark, tmp_path, bus.queues)
    frame = lambda i: {"client": "c", "seq": i, "kind": "frame", "symbol": "A", "event_id": i, "ltp": float(i)}
    s.send([frame(i) for i in range(150)])
    s.send([frame(i) for i in range(150, 205)])
    s.send([{"client": "c", "seq": 300, "kind": "drain", "n": 1}, {"client": "c", "seq": 301, "kind": "drain", "n": 1000}, frame(302), {"client": "c", "seq": 303, "kind": "leave"}])
    rows = s.rows()
    assert sorted(r["event_id"] for r in rows if r["kind"] == "frame") == list(range(5, 205))
    assert next(r["event_id"] for r in rows if r["kind"] == "frame" and r["seq"] == 300) == 5
    ends = sorted((r["seq"], r["kind"], r["waiting"], r["dropped"], r["sent"]) for r in rows if r["kind"] != "frame")
    assert ends == [(300, "drained", 199, 5, 1), (301, "drained", 0, 5, 200), (303, "gone", 1, 5, 200)]


def test_queues_against_a_plain_ring(spark, tmp_path):
    rng, seq, s = random.Random(1), 0, Stream(spark, tmp_path, lambda df: bus.queues(df, frames=7))
    rings: dict = {}
    want = []
    for _ in range(3):
        rows = []
        for _ in range(150):
            seq += 1
            c = rng.choice("xyz")
            ring, figures = rings.setdefault(c, ([], [0, 0]))
            if rng.random() < 0.8:
                rows.append({"client": c, "seq": seq, "kind": "frame", "symbol": "S", "event_id": seq, "ltp": 0.0})
                ring.append(seq)
                if len(ring) > 7:
                    ring.pop(0)
                    figures[0] += 1
            else:
                n = rng.randrange(6)
                rows.append({"client": c, "seq": seq, "kind": "drain", "n": n})
                taken, ring[:] = ring[:n], ring[n:]
                figures[1] += len(taken)
                want += [(c, seq, e) for e in taken] + [(c, seq, len(ring), *figures)]
        rng.shuffle(rows)
        s.send(rows)
    got = [(r["client"], r["seq"], r["event_id"]) if r["kind"] == "frame" else (r["client"], r["seq"], r["waiting"], r["dropped"], r["sent"]) for r in s.rows()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_queue_stream_equals_the_batch(spark, small, tmp_path):
    """Every symbol's ticks pushed into one queue and drained once give the registered query's rows."""
    pushed = ticks(spark, small).selectExpr("symbol AS client", "event_id AS seq", "'frame' AS kind", "symbol", "event_id", "ltp", "CAST(NULL AS LONG) AS n")
    schema = "client string, seq long, kind string, symbol string, event_id long, ltp double, n long"
    s = Stream(spark, tmp_path, bus.queues, schema)
    middle = pushed.agg({"event_id": "avg"}).first()[0]
    s.send(pushed.where(pushed.event_id <= middle))
    s.send(pushed.where(pushed.event_id > middle).unionByName(pushed.selectExpr("client", "9000000000 AS seq", "'drain' AS kind", "symbol", "CAST(NULL AS LONG) AS event_id", "CAST(NULL AS DOUBLE) AS ltp", "1000 AS n").distinct()))
    rows = s.rows()
    dropped = {r["client"]: r["dropped"] for r in rows if r["kind"] == "drained"}
    got = sorted((r["symbol"], r["event_id"], dropped[r["symbol"]]) for r in rows if r["kind"] == "frame")
    assert got == sorted((r["symbol"], r["event_id"], r["dropped"]) for r in bus_push(spark, small).collect()) != []


def test_idle_clients_are_forgotten(spark, tmp_path):
    """A queue that is not drained in time goes with its figures, without any further input."""
    rows = [("c", i, "frame", "A", i, 1.0, None) for i in range(3)]
    schema = "client string, seq long, kind string, symbol string, event_id long, ltp double, n long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = bus.queues(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle=50).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("idle").count():
            time.sleep(0.5)
    finally:
        q.stop()
    assert [(r["client"], r["kind"], r["waiting"], r["dropped"], r["sent"]) for r in spark.table("idle").collect()] == [("c", "gone", 3, 0, 0)]


def plain_alerts(rows):
    """Alerts looked at one by one."""
    compare = {">": lambda v, x: v > x, ">=": lambda v, x: v >= x, "<": lambda v, x: v < x, "<=": lambda v, x: v <= x, "==": lambda v, x: v == x}
    known, out = {}, []
    for r in sorted(rows, key=lambda r: r["seq"]):
        key = (r["symbol"], r["metric"], r.get("alert"))
        if r["kind"] == "add":
            known[key] = [r["op"], r["level"], True]
        elif r["kind"] == "remove":
            known.pop(key, None)
        elif r["kind"] == "rearm" and key in known:
            known[key][2] = True
        elif r["kind"] == "value" and r["value"] is not None:
            for (symbol, metric, a), k in known.items():
                if (symbol, metric) == key[:2] and k[2] and compare[k[0]](r["value"], k[1]):
                    k[2] = False
                    out.append((symbol, metric, r["seq"], a, r["value"]))
    return sorted(out)


def test_alerts_disarm_and_are_armed_again(spark, tmp_path):
    rng, s, seq, everything = random.Random(2), Stream(spark, tmp_path, bus.alerts), 0, []
    for _ in range(3):
        rows = []
        for _ in range(200):
            seq += 1
            base = {"symbol": rng.choice("AB"), "metric": rng.choice(["price", "rsi"]), "seq": seq}
            kind = rng.choices(["add", "value", "rearm", "remove"], [4, 3, 2, 1])[0]
            more = {"alert": rng.randrange(60), "op": rng.choice([">", ">=", "<", "<=", "=="]), "level": float(rng.randrange(12))} if kind != "value" else {"value": rng.choice([None, float(rng.randrange(12))])}
            rows.append(base | {"kind": kind} | (more if kind in ("add", "value") else {"alert": more["alert"]}))
        everything += rows
        rng.shuffle(rows)
        s.send(rows)
    got = sorted((r["symbol"], r["metric"], r["seq"], r["alert"], r["value"]) for r in s.rows())
    assert got == plain_alerts(everything) and len(got) > 100


def test_many_alerts_are_one_pass(spark, tmp_path):
    """100,000 alerts: each fires once in the stream, and the batch compares all in one join."""
    alerts = spark.range(100_000).selectExpr("id AS alert", "concat('S', id % 10) AS symbol", "'price' AS metric", "CASE WHEN id % 2 = 0 THEN '>' ELSE '<=' END AS op", "CAST(id % 1000 AS double) AS level")
    values = spark.createDataFrame([(f"S{i}", "price", 500.0) for i in range(10)], "symbol string, metric string, value double")
    checked = bus.checked(values, alerts)
    met = {r["alert"] for r in checked.where("fired").collect()}
    assert checked.count() == 100_000 and met == {i for i in range(100_000) if (500 > i % 1000 if i % 2 == 0 else 500 <= i % 1000)}
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    schema = "symbol string, metric string, seq long, kind string, alert long, op string, level double, value double"
    s = Stream(spark, tmp_path, bus.alerts, schema)
    s.send(alerts.selectExpr("symbol", "metric", "alert AS seq", "'add' AS kind", "alert", "op", "level", "CAST(NULL AS double) AS value"))
    tick = values.selectExpr("symbol", "metric", "200000 AS seq", "'value' AS kind", "CAST(NULL AS long) AS alert", "CAST(NULL AS string) AS op", "CAST(NULL AS double) AS level", "value")
    s.send(tick)
    s.send(tick.selectExpr("symbol", "metric", "200001 AS seq", "kind", "alert", "op", "level", "value"))
    assert sorted(r["alert"] for r in s.rows()) == sorted(met)
