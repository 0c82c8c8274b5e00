"""Merges that stop half-way lose nothing, and merges that meet lose nothing either."""

from __future__ import annotations

import pytest

from barloom.sources.versioned import Conflict, VersionedStore

ROWS = "contract string, day string, close double"


def rows(df):
    return sorted(tuple(r[c] for c in ("contract", "day", "close")) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "store"), ["contract", "day"], ["day"])


def test_merges(spark, store):
    assert store.read() is None and store.version == 0 and store.merge(spark.createDataFrame([], ROWS)) == 0
    assert store.merge(spark.createDataFrame([("a", "1", 1.0), ("b", "1", 2.0), ("a", "2", 3.0), ("c", None, 4.0)], ROWS)) == 1
    untouched = {p: f for p, f in store.folders().items()}
    assert store.merge(spark.createDataFrame([("a", "1", 9.0), ("d", "1", 5.0)], ROWS)) == 2
    assert sum(untouched[p] == f for p, f in store.folders().items()) == 2  # only the day that was touched is written again
    want = [("a", "1", 9.0), ("a", "2", 3.0), ("b", "1", 2.0), ("d", "1", 5.0)]
    assert rows(store.read().where("day IS NOT NULL")) == want and store.read().count() == 5
    assert store.read(1).count() == 4
    again = store.merge(spark.createDataFrame(want, ROWS))
    assert rows(store.read(again).where("day IS NOT NULL")) == want
    wider = spark.createDataFrame([("z", "3", 1.0, 7)], ROWS + ", oi long")
    store.merge(wider)
    assert {r["oi"] for r in store.read().collect()} == {None, 7}


def test_a_merge_that_stops_half_way(spark, store, monkeypatch):
    store.merge(spark.createDataFrame([("a", "1", 1.0)], ROWS))
    new = spark.createDataFrame([("a", "1", 2.0), ("b", "1", 3.0)], ROWS)

    def stops(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", stops)
        with pytest.raises(KeyboardInterrupt):
            store.merge(new)
    assert rows(store.read()) == [("a", "1", 1.0)] and store.version == 1
    assert store.merge(new) == 2 and rows(store.read()) == [("a", "1", 2.0), ("b", "1", 3.0)]
    assert len(store.sweep(keep=1)) == 2  # the first version's rows and what was left behind
    assert rows(store.read()) == [("a", "1", 2.0), ("b", "1", 3.0)] and store.sweep(keep=1) == []


def test_merges_that_meet(spark, store, monkeypatch):
    """The second of two merges from one version merges anew, onto the first."""
    store.merge(spark.createDataFrame([("a", "1", 1.0)], ROWS))
    other = VersionedStore(spark, store.path, store.key, store.partitions)
    publish, met = store._publish, []

    def overtaken(version, folders):
        if not met:
            met.append(other.merge(spark.createDataFrame([("b", "1", 2.0)], ROWS)))
        publish(version, folders)

    monkeypatch.setattr(store, "_publish", overtaken)
    assert store.merge(spark.createDataFrame([("c", "1", 3.0)], ROWS)) == 3
    assert rows(store.read()) == [("a", "1", 1.0), ("b", "1", 2.0), ("c", "1", 3.0)]
    with pytest.raises(Conflict):
        store._publish(2, {})
