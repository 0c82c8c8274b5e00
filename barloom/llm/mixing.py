"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the mix is as large as all sources together (sizes are words) and is shared by weight; a source's target stops
at `most` times its size and what it cannot take is shared by the others. Every source is used in complete epochs, and
the rest of its target by a fraction of its documents: each has the key u ** (1 / w), u a uniform number from a hash of
its id and w its quality weight; keys are taken from the largest down until the sizes add up to the rest.

The sums run in two levels: keys are cut into slices of about SLICE documents (by the distribution that keys of the source's
quality weights have, so all slices are alike), the slices' sums are added up, and rows are only ordered within their
slice, so a source of any size is spread over many tasks. All of it is DataFrame work. Sources are taken to be a
dimension: their table, one row each, is ordered in one task and broadcast if it has MANY_SOURCES rows at most.

Defined results: a null or empty text has size 0 and takes no words. A null source is one source, the last. A source
without words has target 0. Quality: rows with quality 1 weigh 2, with 0 they weigh 0.5, all others 1; repeated rows of
`labels` count once (the largest). Reruns agree: keys come from ids, and from texts where there is no id; equal keys go by
id, size and digest of the text, and rows equal in these are one as good as the other. Every row is mixed, also repeated
ones. An empty table gives no rows; texts of any length count whole; columns but those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import saved

SLICE = 5_000
QUALITY = (2.0, 1.0, 0.5)
MANY_SOURCES = 100_000
#: Java's \v is a class of its own, so the bytes are named.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """sources: source, source_size (one row each). Adds weight and target.

    Sources ordered by cap / weight: the first k are at their caps, with the least k for which the level, what is left
    of the total over the weights of the others, does not exceed the next one's cap / weight.
    """
    total = sources.agg(F.sum("source_size").alias("total"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # a row for each source
    ranked = sources.withColumn("at", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("at") % len(weights)).cast("int"))).withColumn("cap", most * F.col("source_size"))
    ratio = F.col("cap") / F.col("weight")
    rising = Window.orderBy(ratio, "at")
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    level = (F.col("total") - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("ratio", ratio).withColumn("level", level)
    final = ranked.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at", "level")))["level"].alias("final"))
    return ranked.crossJoin(F.broadcast(final)).select("source", "source_size", "weight", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, digest (md5 of the text), quality_weight, epochs (complete ones, plus 1 if the fraction takes the row) and taken (words) of docs (doc_id, text, source).

    Texts are read once, for their sizes, and never shuffled.
    """
    sized = docs.select("doc_id", "source", F.md5("text").alias("digest"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if labels is not None:
        quality = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality"))
        sized = sized.join(quality, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    else:
        sized = sized.withColumn("quality", F.lit(None).cast("int"))
    sized = sized.withColumn("quality_weight", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)).drop("quality")
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), "digest"), F.lit("none"))))
    u = (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    sized = saved(sized.withColumn("key", F.pow(u, 1 / F.col("quality_weight"))))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("quality_weight") == w).alias(f"rows_{i}") for i, w in enumerate(QUALITY)))
    counted = [f"rows_{i}" for i in range(len(QUALITY))]
    goal = targets(sources.select("source", "source_size"), weights, most).join(sources.select(F.col("source").alias("s"), "rows", *counted), F.expr("source <=> s")).drop("s")
    whole = F.floor(F.col("target") / F.col("source_size") + 1e-12)
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", F.when(F.col("source_size") > 0, whole).otherwise(0).alias("whole"), F.greatest(F.ceil(F.col("rows") / SLICE), F.lit(1)).alias("slices"), "rows", *counted)
    goal = saved(goal)
    few = F.broadcast(goal) if goal.count() <= MANY_SOURCES else goal
    rows = sized.join(few, F.expr("source <=> s")).drop("s")
    below = sum(F.col(c) * F.pow("key", F.lit(w)) for c, w in zip(counted, QUALITY, strict=True)) / F.col("rows")  # share of keys up to this one, to be expected
    rows = rows.withColumn("slice", F.floor(below * F.col("slices"))).drop("rows", *counted)
    rows = rows.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("slice").alias("l"), F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("offset"))
    tie = [F.desc("key"), F.col("doc_id"), F.col("size"), F.col("digest")]
    within = Window.partitionBy("source", "slice").orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    light = rows.join(offsets, F.expr("source <=> s AND slice = l")).drop("s", "l")
    upto = light.withColumn("upto", F.col("offset") + F.sum("size").over(within))
    # the row that crosses the rest is taken if that comes nearer to it
    fraction = (F.col("size") > 0) & (F.col("upto") - F.col("size") < F.col("rest")) & (F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")))
    return upto.withColumn("epochs", (F.col("whole") + fraction.cast("long")).cast("long")).withColumn("taken", F.col("epochs") * F.col("size")).drop("key", "whole", "slices", "slice", "rest", "offset", "upto")


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE l.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS w
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
keyed AS (
  SELECT *, pow((CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0, 1 / CAST(w AS DOUBLE)) AS key
  FROM sized),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS weight, 3.0 * source_size AS cap,
         (SELECT CAST(sum(source_size) AS DOUBLE) FROM src) AS total FROM src),
levels AS (
  SELECT *, cap / weight AS ratio,
         (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
goal AS (
  SELECT source, source_size, CASE WHEN f.final IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), f.final * weight) END AS target
  FROM levels LEFT JOIN (SELECT level AS final FROM levels WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1) f ON TRUE),
joined AS (
  SELECT k.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size + 1e-12) ELSE 0 END AS whole,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key DESC, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source),
rest AS (SELECT *, target - whole * source_size AS rest FROM joined)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND upto - size < rest AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rest
"""
