"""Text queries over whole texts."""

from __future__ import annotations

import re

import duckdb
from pyspark.sql import functions as F

from barloom.catalog import ORACLE_SQL, QUERIES
from barloom.functions import text as tx
from barloom.queries.texts import spiced


def documents(spark, folder, texts):
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return con.execute(ORACLE_SQL[name]).fetchall()


def test_news_far_behind_the_beginning(spark, tmp_path):
    """The word counts wherever it stands, in a first sentence of any length and behind it."""
    texts = ["the first word", "word " * 60 + "the end", "Short one. " + "word " * 9000 + "the last", "other " * 50, "theme lathe The", "", None]
    folder = documents(spark, tmp_path, texts)
    got = sorted(map(tuple, QUERIES["news_for"](spark, folder).collect()))
    assert got == [(i, texts[i]) for i in range(3)] == sorted(by_sql(folder, "news_for"))


#: A text for each alternative of each pattern, and near misses.
SAID = """rbi;mpc;repo rate;monetary policy;fed;fomc;wall street;nasdaq;dow;s&p;treasury;us market;powell;fii;dii;foreign portfolio investor;foreign investor;fpi;inflation;cpi;wpi;gdp;iip;pmi;
fiscal deficit;crude;brent;opec;oil price;sebi;gst;budget;taxation;tariff;import duty;export ban;war;border;missile;geopolit;election;attack;conflict;q1;q2;q3;q4;results;earnings;net profit;
revenue;ebitda;guidance;merger;acquisition;stake;buyback;ipo;delisting;bonus issue;split;rbis;arbil;federal;toward;foreign hands;q5;aq1;window;fpis;ipos;repo  rate;profit""".replace("\n", "").split(";")


def plain_category(text):
    return next((name for name, pattern, _, _ in tx.CATEGORIES if re.search(pattern, text, re.ASCII)), "other")


def test_category_of_every_alternative(spark):
    """A text without a mark is not searched, so each mark must stand in all that its pattern matches, in any case and place."""
    texts = [a + f(w) + b for w in SAID for f in (str.lower, str.upper, str.title) for a, b in (("", ""), ("So ", " it is."), ("x", "y"), ("\u00c9t\u00e9\n", "\n\u4e2d"), ("split ", ""), ("7", "_"))]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "words " * 9000 + "CRUDE"]], "t string")
    got = rows.select("t", tx.category(F.col("t"))["name"].alias("c")).collect()
    assert [(r["t"], r["c"]) for r in got if r["c"] != plain_category(r["t"])] == []
    assert {r["c"] for r in got} == {*tx.MARKS, "other"} and list(tx.MARKS) == [n for n, *_ in tx.CATEGORIES]


def test_a_text_is_searched_once(spark, small):
    """Each pattern stands once in the plan of an impact call, whichever of its parts are used."""
    plan = spiced(spark, small).select(tx.impact(F.col("title"), F.col("ts")).alias("i")).select("i.*")._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(pattern) for _, pattern, _, _ in tx.CATEGORIES] == [1] * len(tx.CATEGORIES) and plan.count(tx.RATES) == 1


def test_bias_searches_a_text_once_and_agrees_with_sql(spark, tmp_path):
    """Weights and directions of all categories, of empty texts and of long ones with cuts, with and without rates."""
    texts = [f"{w} {m}" for w in SAID[:56] for m in ("gains sharply", "not cut", "FED cuts")] + ["", None, "calm " * 5000 + "panic"]
    folder = documents(spark, tmp_path, texts)
    bias = QUERIES["aggregate_bias"](spark, folder)
    plan = bias._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(pattern) for _, pattern, _, _ in tx.CATEGORIES] == [1] * len(tx.CATEGORIES)
    assert list(map(tuple, bias.collect())) == by_sql(folder, "aggregate_bias")


def test_bias_lowers_a_text_once_and_agrees_with_sql(spark, tmp_path):
    """Words, cuts, rates and marks are looked for in one lower-cased text, in any case, also where it is empty, null or long."""
    texts = [f(t) for t in ("Fed CUTS rates", "shares cut, not gains", "OPEC: crude surges", "Window, toward", "calm " * 5000 + "War fears") for f in (str.lower, str.upper, str.title)] + ["", None]
    folder = documents(spark, tmp_path, texts)
    bias = QUERIES["aggregate_bias"](spark, folder)
    assert bias._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert list(map(tuple, bias.collect())) == by_sql(folder, "aggregate_bias")
    for name in ("assess_impact", "score_sentiment_detailed"):
        assert sorted(map(tuple, QUERIES[name](spark, folder).collect())) == sorted(by_sql(folder, name))
