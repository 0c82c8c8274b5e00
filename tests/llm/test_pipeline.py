"""Stages on rows with nulls, repeats and columns named like their own."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_keep_rows_apart(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text IS NOT NULL").limit(40)
    odd = docs.withColumn("score", F.lit("own")).withColumn("taken", F.lit("own"))
    odd = odd.unionByName(odd.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    odd = spark.createDataFrame(odd.collect(), odd.schema)
    named = corpus_pipeline.language_id(spark, odd, small)
    assert named.columns == odd.columns and 0 < named.count() <= odd.count()
    assert {r["score"] for r in named.collect()} == {"own"}
    mixed = corpus_pipeline.source_mix(spark, named, small)
    assert mixed.columns == [*odd.columns, "size", "target", "epochs"]
    rows = mixed.collect()
    assert 0 < len(rows) <= named.count() and sum(r["doc_id"] is None for r in rows) <= 5
    assert corpus_pipeline.source_mix(spark, named.limit(0), small).count() == 0


def test_near_dedup_against_all_pairs(spark, medium):
    """One document of each group of the brute-force components stays; rows with one id and two texts are two documents; equal rows are one."""
    from test_brute_force import documents, plain_components

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, medium).collect()}
    texts = documents(spark, medium)
    want = {d for d, (_, _, first) in plain_components(texts, 80).items() if first}
    assert kept == want
    p, q = (" ".join(f"{c}{i}" for i in range(40)) for c in "pq")
    rows = [(1, p, "en"), (5, q, "en"), (5, f"{p} x", "de"), (9, f"{q} x", "de"), (9, f"{q} x", "de"), (7, None, "en"), (None, p, "en"), (2, "", "en")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), medium)
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["lang"]) for r in got.collect()) == sorted([(1, p, "en"), (5, q, "en"), (7, "", "en"), (0, p, "en"), (2, "", "en")])


def test_other_stages_take_effect(spark, small):
    import re

    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    items = [x for x in items if len(x.split()) >= 3]
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.decontamination(spark, docs, small).collect()}
    whole = {r["doc_id"] for r in docs.collect() if any(f" {x} " in f" {plain(r['text'])} " for x in items)}
    assert whole and not whole & left.keys() and len(left) > 0.7 * docs.count()
    clean = corpus_pipeline.personal_data(spark, docs, small).collect()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(clean) == len(before)
    for r in clean:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        if not re.search(r"[0-9@]", before[r["doc_id"]] or ""):
            assert r["text"] == before[r["doc_id"]]
    mixed = corpus_pipeline.source_mix(spark, docs, small).collect()
    total: dict = {}
    for r in mixed:
        assert r["taken"] == r["epochs"] * r["size"] > 0 and r["text"] == before[r["doc_id"]] and r["epochs"] <= 3
        total.setdefault(r["source"], [0, r["target"], 0])
        total[r["source"]][0] += r["taken"]
        total[r["source"]][2] = max(total[r["source"]][2], r["size"])
    assert all(abs(taken - target) <= largest for taken, target, largest in total.values())


def test_mix_of_rows_that_are_equal_or_share_an_id(spark, small):
    rows = [(1, "a b c", "x")] * 4 + [(1, "a b d e", "x"), (None, "f g", "y"), (None, "f g", "y"), (None, "h", None), (3, None, "x"), (4, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = corpus_pipeline.source_mix(spark, docs, small).collect()
    assert {(r["doc_id"], r["text"], r["source"]) for r in mixed} <= set(rows) and all(r["text"] for r in mixed)
    by: dict = {}
    for r in mixed:
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
    targets = {r["source"]: r["target"] for r in mixed}
    assert all(abs(by[s] - targets[s]) <= 4 for s in by)


def test_decontamination_is_by_row(spark, small):
    """A copy of an item goes also without an id, and a clean row stays that shares the id of a leaking one."""
    item = max((r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()), key=len)
    rows = [(None, item, "en"), (None, "clean words of no item at all", "en"), (4, item, "en"), (4, "other clean words that stand alone", "en"), (5, None, "en"), (6, f"before it {item} and after", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leak string")
    kept = corpus_pipeline.decontamination(spark, docs, small)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, (rows[1], rows[3], rows[4])))


def test_near_dedup_with_a_map_column(spark, small):
    docs = spark.createDataFrame([(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"y": 2}), (2, "a b c d e f", {"z": 3}), (3, "other text here", None)], "doc_id long, text string, m map<string,int>")
    kept = corpus_pipeline.near_dedup(spark, docs, small).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]
