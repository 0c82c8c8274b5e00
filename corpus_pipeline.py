"""A training corpus from raw documents, in five stages; each works on what the one before it kept.

Defined results: empty tables pass through as empty tables. Rows without doc_id pass the filters that need one; rows with
a null or empty text go in the first stage, as no language can be read in them. Texts of any length count whole. Every row
is a document: rows that share an id but not their text are judged apart, of equal rows near-dedup keeps one. Extra columns
of the input are carried through, also where they are named like those that a stage adds (the input's are kept then).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import decontaminate, langid, mixing, neardup, pii
from barloom.llm.frames import saved, table

#: Normalised phrases for a byte of text from which no language is readable; prose has 2 to 5.
UNREADABLE = 8.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which no letter, or no language that was learned, can be read."""
    model = langid.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    whole = docs.select(F.struct("*").alias("row"), "text")  # columns of the input may be named like those that are added
    kept = langid.identify(whole, model).where((F.col("lang_pred") != "und") & (F.col("phrases_per_byte") < UNREADABLE))
    return kept.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id and, among those, the least digest of its text.

    Of repeated rows one stays; maps tell no rows apart. Rows without doc_id and rows without words are in no group and all stay.
    """
    digest = F.md5("text")
    found = neardup.near_duplicates(docs.select("doc_id", "text", digest.alias("digest")), percent=80, carry=("digest",))
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.digest").alias("digest"))
    grouped = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(mixing.WORD), F.lit(False))
    orderable = F.struct(F.lit(0), *(F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind))
    rows = docs.where(grouped).groupBy(F.col("doc_id").alias("id"), digest.alias("digest")).agg(F.min_by(F.struct("*"), orderable).alias("row"))
    return rows.join(first, ["id", "digest"], "left_semi").select("row.*").union(docs.where(~grouped))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go. Each is judged by its text alone, whatever its id."""
    whole = docs.select(F.struct("*").alias("row"), "text", F.md5("text").alias("digest"))
    leaks = decontaminate.contamination(whole.select(F.col("digest").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("digest")).distinct()
    return whole.join(leaks, "digest", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    clean = docs.withColumn("text", pii.redact(F.col("text"), pii.pii_spans(F.col("text"))))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often each is taken (epochs) and how many words that gives; those not taken go.

    Texts are shuffled once. Of rows that are equal in id, source and text as many are taken once more as the mix says.
    Rows with an empty or null text have no words and are not taken.
    """
    name = lambda text: F.md5(F.to_json(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), text.alias("t"))))
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels")).select(name(F.col("digest")).alias("k"), "size", "target", "epochs")
    alike = mixed.groupBy("k").agg(F.first("size").alias("size"), F.first("target").alias("target"), F.min("epochs").alias("least"), F.sum("epochs").alias("all"), F.count(F.lit(1)).alias("n"))
    alike = alike.where("all > 0 AND size > 0").select("k", F.struct("*").alias("mix"))
    rows = docs.select(name(F.md5("text")).alias("k"), F.struct("*").alias("row")).join(alike, "k")
    turn = F.row_number().over(Window.partitionBy("k").orderBy("k"))
    rows = rows.select("row", "mix.*", turn.alias("turn")).withColumn("epochs", F.col("least") + (F.col("turn") <= F.col("all") - F.col("n") * F.col("least")).cast("long"))
    rows = rows.where("epochs > 0").withColumn("taken", F.col("epochs") * F.col("size"))
    return rows.select("row.*", *(c for c in ("size", "target", "epochs", "taken") if c not in docs.columns))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", source_mix),
]
#: Language id, alignment and similarity components are not SQL; tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
