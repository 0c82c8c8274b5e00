"""Feed items of recorded XML; smiles fitted by simplex against a grid searched in SQL."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import simplex
from barloom.queries.vols import QUOTED, calibrate_chain, market_quotes
from barloom.sources import parsers

FEED = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>All</title>
<item><title>Oil &amp;amp; gas up - The Wire</title><link>http://a/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate>
<description>&lt;a href="x"&gt;Oil &amp;amp; gas up&lt;/a&gt;&amp;nbsp;&lt;font&gt;The Wire&lt;/font&gt;</description><source url="http://a">The Wire</source></item>
<item><title>Rates - held</title><pubDate>5 Mar 24 10:00 +0530</pubDate><description>&lt;p&gt;The bank&lt;/p&gt;  kept
 rates</description><source>Desk</source></item>
<item><link>http://a/3</link><pubDate>yesterday</pubDate><media:content>x</media:content></item></channel></rss>"""
ONE = "<rss><channel><item><title>Alone</title><description>Other text</description></item></channel></rss>"
BESIDE = "<RDF><channel><title>c</title></channel><item><title>First</title></item><item><title>Second</title></item></RDF>"


def test_feed_items(spark):
    rows = [(1, FEED), (2, ONE), (3, BESIDE), (4, "<rss><channel><item>"), (5, "no feed"), (6, ""), (7, None), (8, "<rss><channel/></rss>")]
    df = spark.createDataFrame(rows, "feed int, xml string")
    got = parsers.feed_items(df, ["feed"]).withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([
        (1, 0, "Oil & gas up", "http://a/1", "The Wire", "2024-03-05 10:00", ""),
        (1, 1, "Rates - held", "", "Desk", "2024-03-05 04:30", "The bank kept rates"),
        (1, 2, "", "http://a/3", "", None, ""),
        (2, 0, "Alone", "", "", None, "Other text"),
        (3, 0, "First", "", "", None, ""),
        (3, 1, "Second", "", "", None, ""),
    ], key=str)
    broken = {r["feed"] for r in parsers.feeds(df, ["feed"]).where("broken IS NOT NULL").collect()}
    assert {4, 5} <= broken and not broken & {1, 2, 3, 8}


@pytest.mark.parametrize("text, want", [
    ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05 10:00:00"), ("05 Mar 2024 10:00:00 -0800", "2024-03-05 18:00:00"), ("Fri, 1 Jan 99 00:00 EST", "1999-01-01 05:00:00"),
    ("31 Dec 2023 23:59:59 +0530", "2023-12-31 18:29:59"), ("Thu, 29 February 2024 01:02:03", "2024-02-29 01:02:03"), ("30 Feb 2024 01:02:03", None), ("soon", None), ("", None), (None, None),
])
def test_mail_time(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(F.date_format(parsers.mail_time(F.col("x")), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == want


def smile(n: int = 21, rho: float = -0.45, nu: float = 0.85, t: float = 0.1, f: float = 24000.0):
    k = np.linspace(0.88, 1.12, n) * f
    return f, t, k, simplex.sabr(np.array([[np.log(0.3 * f**0.5), np.arctanh(rho), np.log(nu)]]), np.array([f]), k[None], np.array([t]), 0.5)[0]


def quotes(spark, *smiles):
    rows = []
    for i, (f, t, k, iv, *w) in enumerate(smiles):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(i)
        rows += [(day, day, f, float(a), t, None if b is None else float(b), float(c)) for a, b, c in zip(k, iv, w[0] if w else np.ones(len(k)), strict=True)]
    return spark.createDataFrame(rows, "ts date, expiry date, f double, k double, t double, iv double, w double")


def test_fits(spark):
    f, t, k, iv = smile()
    rng = np.random.default_rng(0)
    gaps = [*[None] * 5, *iv[5:]]
    wings = (f, t, np.concatenate([[f * 0.4, f * 1.9, -1.0], k]), np.concatenate([[0.9, 0.9, 0.3], iv]))
    cases = [(f, t, k, iv), smile(5), (f, t, k, gaps), wings, (f, t, k, iv + rng.normal(0, 0.03, len(k))), (f, t, k, iv, np.zeros(len(k))), (f, t, k, [*[float("nan")] * 12, *iv[12:]])]
    got = {r["ts"].day - 1: r for r in simplex.sabr_fits(quotes(spark, *cases)).collect()}
    assert sorted(got) == [0, 2, 3, 4, 5, 6]  # a thin smile has no fit
    for i in (0, 2, 3, 5):
        assert abs(got[i]["rho"] + 0.45) < 0.02 and abs(got[i]["nu"] - 0.85) < 0.05 and got[i]["rmse"] < 0.01
    assert [(got[i]["n"], got[i]["n_available"]) for i in (0, 2, 3)] == [(21, 21), (16, 21), (21, 24)]
    assert got[4]["rmse"] > 0.5
    assert got[6]["warnings"] == [simplex.WARNINGS[2]] and got[0]["warnings"] == []
    made_up = quotes(spark, cases[0]).withColumn("is_model", F.lit(True))
    assert simplex.sabr_fits(made_up).count() == 0
    assert simplex.sabr_fits(quotes(spark, cases[0]).limit(0)).count() == 0


def test_many_simplexes_are_as_one_each():
    rng = np.random.default_rng(1)
    target, scale = rng.normal(0, 2, (50, 3)), rng.uniform(0.2, 5, (50, 3))
    loss = lambda which, p: (scale[which] * (p - target[which]) ** 2).sum(axis=1)
    points, values = simplex.least_points(loss, np.zeros((50, 3)))
    assert np.abs(points - target).max() < 1e-4 and values.max() < 1e-8
    for i in (0, 17, 49):
        alone, _ = simplex.least_points(lambda which, p, i=i: loss(np.full(len(p), i), p), np.zeros((1, 3)))
        assert np.array_equal(alone[0], points[i])


GRID = f"""WITH {QUOTED}, u AS (SELECT ts, spot * exp(0.065 * t) AS f, strike AS k, t, CASE WHEN strike >= spot * exp(0.065 * t) THEN call_iv ELSE put_iv END AS iv,
  greatest(CASE WHEN strike >= spot * exp(0.065 * t) THEN call_oi ELSE put_oi END, 0) AS w FROM qc),
 v AS (SELECT *, w / sum(w) OVER (PARTITION BY ts) AS share, arg_min(iv, (abs(k - f), k)) OVER (PARTITION BY ts) * sqrt(f) AS a0 FROM u WHERE iv > 1e-4 AND abs(ln(f / k)) <= 0.35),
 g AS (SELECT exp((a - 10) * 0.06) AS ga, -0.95 + r * 0.1 AS rho, exp(-3 + m * 0.3) AS nu FROM range(21) x(a), range(20) y(r), range(15) z(m)),
 e AS (SELECT *, a0 * ga AS alpha, ln(f / k) AS lg, pow(f * k, 0.25) AS mean FROM v, g), z AS (SELECT *, nu / alpha * mean * lg AS z FROM e),
 i AS (SELECT *, alpha / (mean * (1 + 0.25 / 24 * lg * lg + 0.0625 / 1920 * pow(lg, 4))) * CASE WHEN abs(z) < 1e-6 THEN 1 - rho * z / 2 ELSE z / ln((sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho)) END
  * (1 + (0.25 / 24 * alpha * alpha / (mean * mean) + 0.125 * rho * nu * alpha / mean + (2 - 3 * rho * rho) / 24 * nu * nu) * t) AS model FROM z),
 l AS (SELECT ts, ga, rho, nu, sum(share * (model - iv) * (model - iv)) AS loss FROM i GROUP BY ALL)
SELECT ts, min(loss) AS loss FROM l GROUP BY ts"""


def test_no_point_of_a_grid_fits_the_quotes_better(spark, small):
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    grid = {str(d)[:10]: x for d, x in con.execute(GRID).fetchall()}
    fits = {str(r["ts"])[:10]: r for r in calibrate_chain(spark, small).collect()}
    losses = {str(r["ts"])[:10]: r["loss"] for r in simplex.sabr_fits(market_quotes(spark, small)).collect()}
    assert fits.keys() == losses.keys() and len(fits) > 10
    assert [d for d in losses if losses[d] > grid[d] * 1.001 + 1e-9] == []


def test_swarm_counts_all_trials(spark, small):
    from barloom.operators import models
    from barloom.sources.views import bars

    rows = bars(spark, small).where("symbol IN ('ECONOMY', 'LARGE')").cache()
    known, path = models.swarm(rows, ((3, 9), (8, 14)), particles=6, rounds=4, resolution=2)
    assert {(3, 8), (3, 14), (9, 8), (9, 14)} <= known.keys() and known[9, 8] == models.PENALTY
    fits = [f for _, _, f in path]
    assert len(path) == 4 and fits == sorted(fits) and all(known[x, y] == f for x, y, f in path)
    assert models.swarm(rows, ((3, 9), (8, 14)), particles=6, rounds=4, resolution=2) == (known, path)
