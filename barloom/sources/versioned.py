"""Stores whose merges happen whole or not at all: rows are staged apart, and a new list of folders takes the place of the old one.

`path/data/<merge>/_part=<partition>` holds rows, `path/versions/<number>.json` the folder of each partition. A merge writes the partitions that it
touches into a folder of its own and then publishes the next number; a number is taken by renaming a file onto a name that must not
exist yet, so of two merges from one version the second one merges anew. What stops before that leaves every reader with the
version before, and its folder to `sweep`. All of it goes through Hadoop's file systems, so any folder that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import merged

PART = "_part"


class Conflict(RuntimeError):
    """Another merge took the number first."""


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str, key: list[str], partitions: list[str]):
        self.spark, self.path, self.key, self.partitions = spark, path.rstrip("/"), key, partitions
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, *below: str) -> list[str]:
        folder = self._hadoop.Path("/".join((self.path, *below)))
        return sorted(f.getPath().getName() for f in self._files.listStatus(folder)) if self._files.exists(folder) else []

    @property
    def version(self) -> int:
        """The newest one, 0 where nothing is stored yet."""
        return max((int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[0] != "."), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Of each partition, the folder of its rows below data."""
        version = self.version if version is None else version
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows of a version, None where there are none; columns that a partition lacks are NULL."""
        return self._rows(list(self.folders(version).values()))

    def _rows(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/data/{f}" for f in folders))

    def merge(self, rows: DataFrame, tries: int = 5) -> int:
        """Stores rows, the new one where a key is stored already; gives the version that has them. Of rows of one key in a merge one stays."""
        for _ in range(tries):
            try:
                return self._merge_once(rows)
            except Conflict:
                continue
        raise Conflict(f"{tries} merges were overtaken")

    def _merge_once(self, rows: DataFrame) -> int:
        base = self.version
        folders = self.folders(base)
        name = F.concat_ws("~", *(F.coalesce(F.col(p).cast("string"), F.lit("none")) for p in self.partitions))
        named = rows.withColumn(PART, F.md5(name))  # a name that any file system takes
        touched = {r[0] for r in named.select(PART).distinct().collect()}  # days and symbols of a batch
        if not touched:
            return base
        old = self._rows([f for p, f in folders.items() if p in touched])
        whole = merged(old, rows, self.key).withColumn(PART, F.md5(name))
        merge = uuid.uuid4().hex
        whole.write.partitionBy(PART).parquet(f"{self.path}/data/{merge}")
        new = {n.split("=", 1)[1]: f"{merge}/{n}" for n in self._names("data", merge) if n.startswith(f"{PART}=")}
        self._publish(base + 1, {**folders, **new})
        return base + 1

    def _publish(self, version: int, folders: dict[str, str]) -> None:
        staged, final = (self._hadoop.Path(f"{self.path}/versions/{n}") for n in (f".{uuid.uuid4().hex}", f"{version}.json"))
        self._files.mkdirs(final.getParent())
        out = self._files.create(staged, False)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self._hadoop, "Options$Rename")
        kinds = self.spark.sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.NONE
        try:
            context.rename(staged, final, kinds)
        except Exception as e:
            self._files.delete(staged, False)
            if self._files.exists(final):
                raise Conflict(version) from e
            raise

    def sweep(self, keep: int = 2) -> list[str]:
        """Deletes merges that none of the newest `keep` versions refers to, and older versions. Not while a merge runs: its folder is not listed yet."""
        newest = self.version
        last = range(max(1, newest - keep + 1), newest + 1)
        used = {f.split("/")[0] for v in last for f in self.folders(v).values()}
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            self._files.delete(self._hadoop.Path(f"{self.path}/data/{n}"), True)
        for n in self._names("versions"):
            if not (n.endswith(".json") and n[0] != "." and int(n.removesuffix(".json")) in last):
                self._files.delete(self._hadoop.Path(f"{self.path}/versions/{n}"), False)
        return gone
