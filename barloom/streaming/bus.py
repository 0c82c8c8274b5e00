"""Live routing with state: which client wants which symbol, bounded queues of clients, and alerts that disarm once they fire.

All three are keyed processors of a stream of commands and ticks, so subscriptions, queues and alerts may be any number: they
are spread over tasks by symbol or client, and are restored from the checkpoint after a restart. Commands and ticks carry a number
(seq) that orders them within a batch; batches are in order by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Frames that wait for a client; beyond that the oldest goes and is counted.
QUEUE_FRAMES = 200
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """The state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a batch; how many there are at once follows from the source's limit for a batch."""
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


ROUTED = "symbol string, seq long, kind string, client long, event_id long, ltp double"


class Router(StatefulProcessor):
    """By symbol: who wants it. A tick goes to each client that does; the first one to want a symbol and the last one to leave turn the feed on and off.

    Rows in: seq, kind (subscribe, unsubscribe or tick), client, event_id, ltp. Repeated subscriptions count once, and leaving what was not wanted does nothing.
    Rows out: kind tick for each client, feed_on and feed_off without one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clients = handle.getMapState("clients", "client long", "since long")
        self.refs = handle.getValueState("refs", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.refs.get()
        n, wanted, out = (known[0] if known else 0), None, []
        for r in _in_order(rows).itertuples(index=False):
            if r.kind == "tick":
                wanted = sorted(c for (c,) in self.clients.keys()) if wanted is None and n else wanted or []
                out += [(key[0], r.seq, "tick", c, r.event_id, r.ltp) for c in wanted]
                continue
            client, wanted = (int(r.client),), None
            wants = self.clients.containsKey(client)
            if r.kind == "subscribe" and not wants:
                self.clients.updateValue(client, (int(r.seq),))
                n += 1
                if n == 1:
                    out.append((key[0], r.seq, "feed_on", None, None, None))
            elif r.kind == "unsubscribe" and wants:
                self.clients.removeKey(client)
                n -= 1
                if n == 0:
                    out.append((key[0], r.seq, "feed_off", None, None, None))
        self.refs.update((n,))
        yield _frame(out, ROUTED)

    def close(self) -> None:
        pass


QUEUED = "client string, seq long, kind string, symbol string, event_id long, ltp double, waiting long, dropped long, sent long"


class Queue(StatefulProcessor):
    """By client: a ring of the newest `frames` frames. What is pushed into a full ring drops the oldest frame, and drops are counted.

    Rows in: seq, kind (frame, drain or leave), symbol, event_id, ltp, n (frames that a drain takes at most). Rows out: the drained frames, oldest
    first, then one row `drained` with what still waits, and the drops and frames sent so far. A client that drains nothing for `idle` milliseconds (of processing time) has gone:
    one row `gone` with its figures, and its state is cleared, as with a leave.
    """

    def __init__(self, frames: int = QUEUE_FRAMES, idle: int | None = None):
        self.frames, self.idle = frames, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getMapState("ring", "slot long", "seq long, symbol string, event_id long, ltp double")
        self.figures = handle.getValueState("figures", "head long, tail long, dropped long, sent long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.figures.get()
        head, tail, dropped, sent = known or (0, 0, 0, 0)
        fresh: dict[int, tuple] = {}  # frames of this batch: only those that stay reach the store
        out, alive = [], known is None
        for r in _in_order(rows).itertuples(index=False):
            if r.kind == "frame":
                fresh[tail] = (int(r.seq), r.symbol, int(r.event_id), float(r.ltp))
                tail += 1
                if tail - head > self.frames:
                    fresh.pop(head, None)
                    head, dropped = head + 1, dropped + 1
                continue
            alive = True
            take = min(tail - head, int(r.n)) if r.kind == "drain" else 0
            for at in range(head, head + take):
                frame = fresh.pop(at, None) or self.ring.getValue((at % self.frames,))
                sent += 1
                out.append((key[0], r.seq, "frame", *frame[1:], None, None, None))
            head += take
            out.append((key[0], r.seq, "drained" if r.kind == "drain" else "gone", None, None, None, tail - head, dropped, sent))
            if r.kind == "leave":
                self._forget()
                head = tail = dropped = sent = 0
                fresh, alive = {}, False
        for at, frame in fresh.items():
            self.ring.updateValue((at % self.frames,), frame)
        if tail or sent or dropped:
            self.figures.update((head, tail, dropped, sent))
        if self.idle and alive:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield _frame(out, QUEUED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, tail, dropped, sent = self.figures.get() or (0, 0, 0, 0)
        self._forget()
        yield _frame([(key[0], None, "gone", None, None, None, tail - head, dropped, sent)], QUEUED)

    def _forget(self) -> None:
        self.ring.clear()
        self.figures.clear()

    def close(self) -> None:
        pass


FIRED = "symbol string, metric string, seq long, alert long, op string, level double, value double"


class ArmedAlerts(StatefulProcessor):
    """By symbol and metric: armed alerts, in order of their levels, so a value finds those that it meets by bisection however many there are.

    Rows in: seq, kind (add, remove, rearm or value), alert, op (> >= < <= ==), level, value. An alert that fires disarms and stays known until it is removed;
    rearm arms it again. A number added twice is the newest alert of that number; values that are NULL or NaN meet nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "alert long", "op string, level double, armed boolean")
        self.armed = handle.getMapState("armed", "op string", "levels array<double>, alerts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        index = {op: (np.array(levels, float), np.array(alerts, np.int64)) for (op,), (levels, alerts) in self.armed.iterator()}
        before = set(index)
        changed: dict[int, tuple | None] = {}  # of the known alerts, in this batch
        add: dict[int, tuple[str, float]] = {}
        leave: set[int] = set()
        out = []

        def flush() -> None:
            """Puts what was armed and disarmed since the last value in order."""
            gone = np.array([*leave, *add], np.int64)
            for op, (levels, alerts) in list(index.items()):
                stay = ~np.isin(alerts, gone)
                index[op] = levels[stay], alerts[stay]
            for op in {o for o, _ in add.values()}:
                levels, alerts = index.get(op, (np.zeros(0), np.zeros(0, np.int64)))
                new = [(x, a) for a, (o, x) in add.items() if o == op]
                levels, alerts = np.concatenate([levels, [x for x, _ in new]]), np.concatenate([alerts, np.array([a for _, a in new], np.int64)])
                order = np.lexsort((alerts, levels))
                index[op] = levels[order], alerts[order]
            add.clear()
            leave.clear()

        def of(alert: int) -> tuple | None:
            return changed[alert] if alert in changed else self.known.getValue((alert,))

        for r in _in_order(rows).itertuples(index=False):
            if r.kind == "value":
                if r.value is None or np.isnan(r.value):
                    continue
                if add or leave:
                    flush()
                for op, (levels, alerts) in index.items():
                    low, high = met(op, levels, r.value)
                    if low < high:
                        out += [(*key, r.seq, int(a), op, float(x), float(r.value)) for x, a in zip(levels[low:high], alerts[low:high], strict=True)]
                        changed.update((int(a), (op, float(x), False)) for x, a in zip(levels[low:high], alerts[low:high], strict=True))
                        index[op] = np.delete(levels, slice(low, high)), np.delete(alerts, slice(low, high))
                continue
            alert = int(r.alert)
            if r.kind == "add":
                changed[alert], add[alert] = (r.op, float(r.level), True), (r.op, float(r.level))
            elif known := of(alert):
                if r.kind == "remove":
                    changed[alert] = None
                    leave.add(alert)
                    add.pop(alert, None)
                elif not known[2]:
                    changed[alert], add[alert] = (known[0], known[1], True), (known[0], known[1])
            if r.kind == "add":
                leave.discard(alert)
        flush()
        for alert, known in changed.items():
            if known is None:
                self.known.removeKey((alert,))
            else:
                self.known.updateValue((alert,), known)
        for op in before | set(index):
            levels, alerts = index[op]
            if len(alerts):
                self.armed.updateValue((op,), (levels.tolist(), alerts.tolist()))
            elif op in before:
                self.armed.removeKey((op,))
        yield _frame(out, FIRED)

    def close(self) -> None:
        pass


def met(op: str, levels: np.ndarray, value: float) -> tuple[int, int]:
    """Which of the rising levels a value meets."""
    left, right = int(np.searchsorted(levels, value, "left")), int(np.searchsorted(levels, value, "right"))
    return {">": (0, left), ">=": (0, right), "<": (right, len(levels)), "<=": (left, len(levels)), "==": (left, right)}[op]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {"string": "object", "long": "Int64", "double": "float64"}
    columns = [c.split() for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=[c for c, _ in columns]).astype({c: kinds[k] for c, k in columns})


def route(rows: DataFrame) -> DataFrame:
    """rows: symbol, seq, kind, client, event_id, ltp; see Router."""
    return rows.groupBy("symbol").transformWithStateInPandas(Router(), ROUTED, "append", "None")


def queues(rows: DataFrame, frames: int = QUEUE_FRAMES, idle: int | None = None) -> DataFrame:
    """rows: client, seq, kind, symbol, event_id, ltp, n; see Queue."""
    return rows.groupBy("client").transformWithStateInPandas(Queue(frames, idle), QUEUED, "append", "ProcessingTime" if idle else "None")


def alerts(rows: DataFrame) -> DataFrame:
    """rows: symbol, metric, seq, kind, alert, op, level, value; see ArmedAlerts."""
    return rows.groupBy("symbol", "metric").transformWithStateInPandas(ArmedAlerts(), FIRED, "append", "None")


def checked(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """alert, symbol, metric, op, level, value, fired: one pass over newest values (symbol, metric, value) for any number of alerts (alert, symbol, metric, op, level).

    An alert without a value has none and does not fire. Alerts are grouped by what they compare, so this is one join on symbol and metric.
    """
    value, level = F.col("value"), F.col("level")
    by = {">": value > level, ">=": value >= level, "<": value < level, "<=": value <= level, "==": value == level}
    fired = F.lit(False)
    for op, yes in by.items():
        fired = F.when(F.col("op") == op, yes).otherwise(fired)
    found = alerts.join(metrics, ["symbol", "metric"], "left")
    return found.select("alert", "symbol", "metric", "op", "level", "value", F.coalesce(fired, F.lit(False)).alias("fired"))
