"""Recorded market data as Spark data sources: bars from provider payloads with a fallback chain, and binary tick frames as a stream.

`market_bars` reads JSON payloads `root/<provider>/<symbol>/<yyyy-mm>.json`. A partition is a symbol and a month; filters on symbol and dt are
pushed down, so neither payloads of other symbols nor of other months are opened. Of each partition the first provider in the chain
that has a readable payload with bars is taken; its name is in the column provider.

`tick_frames` streams recordings `root/<number>.frames`: frames one after another, each behind its length in four big-endian bytes. The
offset is the number of recordings read, so a restarted stream goes on behind the last one; recordings are put in place
whole and never change. A torn end of a recording is left out.

Folders are read by pyarrow's file systems: a plain path that all executors see, or an address such as hdfs:// or s3://.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkValueError
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BARS = "symbol string, dt date, open double, high double, low double, close double, volume long, provider string"
FIELDS = ("open", "high", "low", "close", "volume")
FIRST, LAST = datetime.date(1, 1, 1), datetime.date(9999, 12, 31)
DAY = datetime.timedelta(days=1)


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def names(root: str, *below: str, kind: fs.FileType = fs.FileType.Directory) -> list[str]:
    files, path = opened(root)
    found = files.get_file_info(fs.FileSelector("/".join((path, *below)), allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == kind)


def _day(x: object) -> datetime.date:
    """Seconds since 1970 (or thousandths of them), or a date or time as text."""
    if isinstance(x, int | float):
        return datetime.datetime.fromtimestamp(x / 1000 if x > 1e11 else x, datetime.UTC).date()
    return datetime.date.fromisoformat(str(x)[:10])


def payload_bars(text: str) -> list[tuple]:
    """(dt, open, high, low, close, volume) of a payload: candles as lists (under data or not), rows as objects, or columns of equal length.

    Bars with a missing price are left out, a missing volume is 0; anything else that cannot be read is an error.
    """
    body = json.loads(text)
    body = body.get("data", body) if isinstance(body, dict) else body
    if isinstance(body, dict) and "candles" in body:
        rows = [c[:6] for c in body["candles"]]
    elif isinstance(body, dict):
        columns = {k.lower(): v for k, v in body.items()}
        rows = list(zip(*(columns[k] for k in ("date", *FIELDS)), strict=True))
    else:
        rows = [[{k.lower(): v for k, v in r.items()}.get(k) for k in ("date", *FIELDS)] for r in body]
    return [(_day(r[0]), *map(float, r[1:5]), int(r[5] or 0)) for r in rows if all(x is not None for x in r[:5])]


@dataclass
class Month(InputPartition):
    symbol: str
    month: str


class BarsReader(DataSourceReader):
    def __init__(self, root: str, providers: list[str]):
        self.root, self.providers = root, providers
        self.symbols: set[str] | None = None
        self.low, self.high = FIRST, LAST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on symbol and dt, all of which `read` applies whole; gives back the others."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if isinstance(f, EqualTo | In) and column == ("symbol",):
                asked = set(f.value) if isinstance(f, In) else {value}
                self.symbols = asked if self.symbols is None else self.symbols & asked
            elif column == ("dt",) and isinstance(value, datetime.date) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + DAY if isinstance(f, GreaterThan) and value < LAST else value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, value - DAY if isinstance(f, LessThan) and value > FIRST else value)
            else:
                yield f

    def partitions(self) -> list[Month]:
        found = set()
        for provider in self.providers:
            for symbol in names(self.root, provider):
                if self.symbols is None or symbol in self.symbols:
                    months = (f.removesuffix(".json") for f in names(self.root, provider, symbol, kind=fs.FileType.File) if f.endswith(".json"))
                    found |= {(symbol, m) for m in months if self.low.isoformat()[:7] <= m <= self.high.isoformat()[:7]}
        return [Month(*x) for x in sorted(found)]

    def read(self, part: Month | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # so Spark asks where there are no partitions
            return
        files, path = opened(self.root)
        for provider in self.providers:
            try:
                with files.open_input_stream(f"{path}/{provider}/{part.symbol}/{part.month}.json") as stream:
                    bars = payload_bars(stream.read().decode())
            except (FileNotFoundError, ValueError, KeyError, TypeError, IndexError):  # the next provider may have it
                continue
            if bars:
                bars = [b for b in bars if self.low <= b[0] <= self.high]
                columns = list(zip(*bars, strict=True)) if bars else [()] * 6
                kinds = [pa.date32(), *[pa.float64()] * 4, pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                same = lambda x: pa.array([x] * len(bars), pa.string())
                yield pa.RecordBatch.from_arrays([same(part.symbol), *arrays, same(provider)], ["symbol", "dt", *FIELDS, "provider"])
                return


class MarketBars(DataSource):
    """Options: path (or the argument of load), providers (in order of preference; all folders by name where there is none)."""

    @classmethod
    def name(cls) -> str:
        return "market_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> BarsReader:
        root = self.options.get("path")
        if not root:
            raise PySparkValueError("market_bars needs the folder of the payloads")
        chain = [p.strip() for p in self.options.get("providers", "").split(",") if p.strip()]
        return BarsReader(root.rstrip("/"), chain or names(root.rstrip("/")))


@dataclass
class Recording(InputPartition):
    number: int
    file: str


class FramesReader(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def recordings(self) -> list[str]:
        return [f for f in names(self.root, kind=fs.FileType.File) if f.endswith(".frames")]

    def initialOffset(self) -> dict:
        return {"recordings": 0}

    def latestOffset(self) -> dict:
        return {"recordings": len(self.recordings())}

    def partitions(self, start: dict, end: dict) -> list[Recording]:
        return [Recording(i, f) for i, f in enumerate(self.recordings()) if start["recordings"] <= i < end["recordings"]]

    def read(self, part: Recording) -> Iterator[tuple]:
        files, path = opened(self.root)
        with files.open_input_stream(f"{path}/{part.file}") as stream:
            at = 0
            while len(head := stream.read(4)) == 4:
                size = int.from_bytes(head, "big")
                frame = stream.read(size)
                if len(frame) < size:
                    return
                yield part.file.removesuffix(".frames"), at, bytes(frame)
                at += 1


class TickFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tick_frames"

    def schema(self) -> str:
        return "recording string, number long, frame binary"

    def streamReader(self, schema) -> FramesReader:
        root = self.options.get("path")
        if not root:
            raise PySparkValueError("tick_frames needs the folder of the recordings")
        return FramesReader(root.rstrip("/"))


def register(spark: SparkSession) -> SparkSession:
    """Makes both formats known to a session, with filters pushed into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MarketBars)
    spark.dataSource.register(TickFrames)
    return spark
