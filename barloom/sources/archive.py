"""Dated archive of tables that are dumped whole, day by day: intervals in which a row stayed the same, and reads as of any day.

A dump lists all that is valid on its day. Rows that do not change are stored once, with the first day and the day of the first dump that no
longer has them so; what the newest dump has is valid until further notice (no end). A row is known from one dump to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lives(dumps: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """key, other columns, valid_from, valid_to of dumps (key, day and other columns): islands of consecutive dumps with equal rows.

    Dumps are told apart by their days, of which there are few; repeated rows of a dump count once. Columns of any type that can be compared.
    """
    rest = [c for c in dumps.columns if c not in (*key, day)]
    days = dumps.select(F.col(day).alias("_day")).distinct()
    order = Window.orderBy("_day")  # a row for each dump
    days = days.select("_day", F.row_number().over(order).alias("_n"), F.lead("_day").over(order).alias("_next"))
    rows = dumps.groupBy(*key, F.col(day).alias("_day")).agg(F.max(F.struct(F.lit(0).alias("_"), *rest)).alias("_row")).join(days, "_day")
    series = Window.partitionBy(*key).orderBy("_n")
    fresh = ~((F.lag("_n").over(series) == F.col("_n") - 1) & F.lag("_row").over(series).eqNullSafe(F.col("_row")))
    rows = rows.withColumn("_island", F.sum(F.coalesce(fresh, F.lit(True)).cast("long")).over(series))
    found = rows.groupBy(*key, "_island").agg(F.first("_row").alias("_row"), F.min("_day").alias("valid_from"), F.max_by("_next", "_n").alias("valid_to"))
    return found.select(*key, *(F.col("_row")[c].alias(c) for c in rest), "valid_from", "valid_to")


def as_of(archive: DataFrame, day) -> DataFrame:
    """What was valid on a day: a column or a literal."""
    at = F.lit(day).cast("date") if isinstance(day, str) else F.lit(day)
    return archive.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))).drop("valid_from", "valid_to")


def looked_up(asked: DataFrame, archive: DataFrame, key: list[str], day: str) -> DataFrame:
    """Rows of asked (key, day, ...), each with what the archive knew of its key on its day: NULL where it knew nothing."""
    other = [c for c in archive.columns if c not in key]
    known = archive.select(*(F.col(c).alias(f"_k_{c}") for c in key), *other)
    here = [F.col(c) == F.col(f"_k_{c}") for c in key] + [F.col("valid_from") <= F.col(day), F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to"))]
    on = here[0]
    for c in here[1:]:
        on = on & c
    return asked.join(known, on, "left").select(*(asked[c] for c in asked.columns), *(c for c in other if c not in ("valid_from", "valid_to")))
