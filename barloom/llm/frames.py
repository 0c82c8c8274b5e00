"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoints(spark: SparkSession) -> None:
    """The cluster's checkpoint folder; a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-checkpoints-"))


def saved(df: DataFrame) -> DataFrame:
    """Rows kept in the shared checkpoint folder; lineage ends there."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(df: DataFrame) -> DataFrame:
    """Like `saved`; what was shuffled to make the rows is given free at once. Spark drops shuffles whose frames the JVM has collected, which
    otherwise waits until the driver's heap is full, so jobs of many rounds would pile up the shuffles of all rounds on the executors' disks."""
    out = saved(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def buckets_for(docs: DataFrame, text: str, bytes_each: int) -> int:
    """How many hash buckets hold about `bytes_each` bytes of text each; grows with the input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // bytes_each))


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id (long) and text alone, and those of `carry`. Columns that are so already stay as they are: an alias on one side of two
    joins would keep Spark from reusing the shuffle of the texts."""
    kinds = dict(docs.dtypes)
    one = F.col(doc_id) if (doc_id, kinds[doc_id]) == ("doc_id", "bigint") else F.col(doc_id).cast("long").alias("doc_id")
    return docs.select(one, F.col(text) if text == "text" else F.col(text).alias("text"), *carry)


def vector_sum(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of a column of packed 64-bit vectors of one size, a few a task; added up in a tree, so that the driver gets a few."""
    if not parts.rdd.getNumPartitions():
        return np.zeros(size, np.int64)
    return parts.rdd.map(lambda row: np.frombuffer(row[0], np.int64)).treeReduce(np.add, depth=3)
