"""Headline and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import parsers
from ..sources.views import HEADLINES, headlines, table
from . import query, rounded, rounded_sql


def quoted(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def listed(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


#: Five texts in six get a made-up beginning of words that the scorer knows, as the tables' invented words are in no list: a fixture of the rules, no finding.
#: What is scored is that and the whole body, in which the title stands.
SPICE = ("Markets surge strongly as RBI cuts repo rate", "Company cuts guidance, shares not fall", "Crude oil prices jump sharply", "Bank profit growth despite inflation fears", "Election risk hits rupee", "")
SPICED = f"h AS (SELECT doc_id, {listed(SPICE)}[CAST(doc_id % 6 AS INTEGER) + 1] || ' ' || coalesce(body, '') AS title, title AS raw FROM headlines)"
SENT = f"""{HEADLINES}, {SPICED}, tk AS (SELECT doc_id, title, regexp_extract_all(lower(title), '[a-z'']+') AS t, regexp_matches(lower(title), '\\brates?\\b|\\brepo\\b|\\brbi\\b|\\bfed\\b') AS rates FROM h),
 ex AS (SELECT doc_id, rates, t, i, t[i] AS w FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM tk) u),
 ow AS (SELECT *, CASE WHEN w IN ('cut', 'cuts') AND NOT rates THEN -1.0 WHEN w IN {quoted(tx.POSITIVE)} THEN 1.0 WHEN w IN {quoted(tx.NEGATIVE)} THEN -1.0 ELSE 0.0 END AS own, t[greatest(i - 3, 1):i - 1] AS b FROM ex),
 wt AS (SELECT doc_id, own * CASE WHEN list_has_any(b, {listed(tx.NEGATORS)}) THEN -0.8 ELSE 1 END * CASE WHEN list_has_any(b, {listed(tx.INTENSIFIERS)}) THEN 1.5 ELSE 1 END AS v FROM ow WHERE own <> 0),
 ag AS (SELECT doc_id, CAST(sum(v) AS DOUBLE) AS total, count(*) AS hits FROM wt GROUP BY doc_id),
 sent AS (SELECT h.doc_id, h.title, CASE WHEN hits IS NULL THEN 0.0 ELSE greatest(least(0.6 * total / pow(hits, 0.7), 1.0), -1.0) END AS score, CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM h LEFT JOIN ag USING (doc_id))"""


def spiced(spark, sf_dir: str) -> DataFrame:
    spice = F.get(F.array(*map(F.lit, SPICE)), (F.col("doc_id") % 6).cast("int"))
    return headlines(spark, sf_dir).select("doc_id", F.concat(spice, F.lit(" "), F.coalesce("body", F.lit(""))).alias("title"), F.timestamp_seconds(1704067200 + F.col("doc_id") * 3607).alias("ts"))


@query("score_sentiment_detailed", rounded_sql(f"WITH {SENT}\nSELECT doc_id, score, hits FROM sent", "score"))
def score_sentiment(spark, sf_dir: str) -> DataFrame:
    return rounded(spiced(spark, sf_dir).withColumn("s", tx.sentiment(F.col("title"))).select("doc_id", "s.score", "s.hits"))


LABEL = "CASE WHEN score >= 0.35 THEN 'bullish' WHEN score >= 0.12 THEN 'mildly bullish' WHEN score <= -0.35 THEN 'bearish' WHEN score <= -0.12 THEN 'mildly bearish' ELSE 'neutral' END"


@query("sentiment_label", f"WITH {SENT}\nSELECT doc_id, {LABEL} AS label FROM sent")
def sentiment_label(spark, sf_dir: str) -> DataFrame:
    return spiced(spark, sf_dir).select("doc_id", tx.sentiment_label(tx.sentiment(F.col("title"))["score"]).alias("label"))


CASES = "CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p, _, _ in tx.CATEGORIES) + " ELSE 'other' END"
WEIGHT = "CASE category " + " ".join(f"WHEN '{n}' THEN {w}" for n, _, w, _ in tx.CATEGORIES) + " ELSE 0.3 END"
LOCAL = "(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 3607) + INTERVAL 330 MINUTE)"
PHASE = "CASE WHEN isodow(lt) > 5 THEN 'overnight' " + " ".join(f"WHEN mi >= {b} THEN '{n}'" for b, n in reversed(tx.PHASES)) + " ELSE 'overnight' END"
IMPACT = f"""{SENT}, c AS (SELECT *, {CASES} AS category, {LOCAL} AS lt FROM sent), c1 AS (SELECT *, hour(lt) * 60 + minute(lt) AS mi FROM c),
 c2 AS (SELECT *, {PHASE} AS phase, score * CASE WHEN category = 'crude_oil' THEN -1 ELSE 1 END AS eff, {WEIGHT} AS w FROM c1),
 c3 AS (SELECT *, CASE WHEN eff > 0.08 THEN 'bullish' WHEN eff < -0.08 THEN 'bearish' ELSE 'neutral' END AS direction,
   least(0.5 + 0.45 * abs(eff) * w * CASE phase {' '.join(f"WHEN '{n}' THEN {m}" for n, m in tx.TIMING.items())} END, 0.85) AS cf FROM c2),
 impact AS (SELECT doc_id, category, phase, direction, CAST(CASE WHEN direction = 'neutral' THEN least(cf, 0.5) ELSE cf END AS DOUBLE) AS confidence FROM c3)"""


@query("assess_impact", rounded_sql(f"WITH {IMPACT}\nSELECT * FROM impact", "confidence"))
def assess_impact(spark, sf_dir: str) -> DataFrame:
    return rounded(spiced(spark, sf_dir).select("doc_id", tx.impact(F.col("title"), F.col("ts")).alias("i")).select("doc_id", "i.*"))


@query("aggregate_bias", rounded_sql(f"""WITH {IMPACT}, a AS (SELECT CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * confidence * pow(0.5, (doc_id % 48) / 6.0) AS part, confidence * pow(0.5, (doc_id % 48) / 6.0) AS w FROM impact)
SELECT sum(part) / sum(w) AS score, CAST(count(*) AS BIGINT) AS n FROM a""", "score"))
def aggregate_bias(spark, sf_dir: str) -> DataFrame:
    """Confidence-weighted direction of all headlines; weights halve every six hours."""
    d = spiced(spark, sf_dir).select((F.col("doc_id") % 48).alias("age"), tx.impact(F.col("title"), F.col("ts")).alias("i")).select("age", "i.*")
    weight = F.col("confidence") * F.pow(F.lit(0.5), F.col("age") / 6.0)
    sign = F.when(F.col("direction") == "bullish", 1).when(F.col("direction") == "bearish", -1).otherwise(0)
    return rounded(d.agg((F.sum(sign * weight) / F.sum(weight)).alias("score"), F.count(F.lit(1)).alias("n")))


@query("session_phase", f"WITH t AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS lt FROM events), m AS (SELECT *, hour(lt) * 60 + minute(lt) AS mi FROM t)\nSELECT event_id, {PHASE} AS phase FROM m")
def session_phase(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.session_phase(F.col("ts")).alias("phase"))


KEY = "substring(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), 1, 120) || '|nodate'"


@query("headline_key", f"WITH {HEADLINES}\nSELECT doc_id, {KEY} AS key FROM headlines")
def headline_key(spark, sf_dir: str) -> DataFrame:
    return headlines(spark, sf_dir).select("doc_id", tx.headline_key(F.col("title")).alias("key"))


@query("read_all_keep_first", f"WITH {HEADLINES}, k AS (SELECT doc_id, {KEY} AS key FROM headlines)\nSELECT key, min(doc_id) AS doc_id FROM k GROUP BY key")
def read_all_keep_first(spark, sf_dir: str) -> DataFrame:
    return headlines(spark, sf_dir).groupBy(tx.headline_key(F.col("title")).alias("key")).agg(F.min("doc_id").alias("doc_id"))


@query("persist_new_headlines", f"WITH {HEADLINES}, k AS (SELECT doc_id, {KEY} AS key FROM headlines), old AS (SELECT DISTINCT key FROM k WHERE doc_id < 500)\nSELECT min(doc_id) AS doc_id, key FROM k WHERE doc_id >= 500 AND key NOT IN (SELECT key FROM old) GROUP BY key")
def persist_new_headlines(spark, sf_dir: str) -> DataFrame:
    """Of a batch those headlines whose key is not stored yet, each once."""
    k = headlines(spark, sf_dir).select("doc_id", tx.headline_key(F.col("title")).alias("key"))
    return k.where("doc_id >= 500").join(k.where("doc_id < 500"), "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


ALIASES = (("therly", "THER"), ("erand", "ERAN"), ("the", "THE"), ("of", "OF"), ("in", "IN"))


@query("map_title", f"""WITH {HEADLINES}, a AS (SELECT * FROM (VALUES {', '.join(f"('{x}', '{y}')" for x, y in ALIASES)}) t(alias, sym))
SELECT DISTINCT doc_id, sym FROM headlines JOIN a ON regexp_matches(lower(title), '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)')""")
def map_title(spark, sf_dir: str) -> DataFrame:
    """Symbols whose alias stands in a title between non-alphanumerics. The alias list is a driver constant: one expression for each alias, no join."""
    found = F.array_compact(F.array(*(F.when(F.lower("title").rlike(f"(?<![a-z0-9]){a}(?![a-z0-9])"), s) for a, s in ALIASES)))
    return headlines(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(found)).alias("sym"))


@query("alias_table", f"""WITH {HEADLINES}, a AS (SELECT * FROM (VALUES {', '.join(f"('{x}', '{y}')" for x, y in ALIASES)}) t(alias, sym) WHERE len(alias) >= 3)
SELECT alias, sym, CAST(len(alias) AS BIGINT) AS n, CAST(count(doc_id) AS BIGINT) AS mentions FROM a LEFT JOIN headlines ON regexp_matches(lower(title), '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)') GROUP BY 1, 2""")
def alias_table(spark, sf_dir: str) -> DataFrame:
    """Aliases of three letters or more, and how many titles have them."""
    a = spark.createDataFrame(list(ALIASES), "alias string, sym string").withColumn("n", F.length("alias").cast("long")).where("n >= 3")
    there = F.array_compact(F.array(*(F.when(F.lower("title").rlike(f"(?<![a-z0-9]){x}(?![a-z0-9])"), x) for x, _ in ALIASES)))
    found = headlines(spark, sf_dir).where("doc_id IS NOT NULL").select(F.explode(there).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("mentions"))
    return a.join(found, "alias", "left").select("alias", "sym", "n", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions")).orderBy(F.desc("n"), "alias")


@query("news_coverage", f"WITH {HEADLINES}\nSELECT lang, source, CAST(count(*) AS BIGINT) AS n FROM headlines GROUP BY 1, 2")
def news_coverage(spark, sf_dir: str) -> DataFrame:
    """Headlines by language and source: rows, since the sources are as many as there are."""
    return headlines(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("news_for", "SELECT doc_id, text FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def news_for(spark, sf_dir: str) -> DataFrame:
    """Documents that have the word anywhere in their whole text, which is given whole: no title stands for it."""
    return table(spark, sf_dir, "documents").where(F.array_contains(F.split("text", " "), "the")).select("doc_id", "text")


@query("normalize_text", f"WITH {HEADLINES}\nSELECT doc_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS t FROM headlines")
def normalize_text(spark, sf_dir: str) -> DataFrame:
    return headlines(spark, sf_dir).select("doc_id", F.regexp_replace(F.lower("title"), "[^a-z0-9]", "").alias("t"))


ENTITIES = "replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


@query("parse_rss_clean", f"WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS x FROM pages)\nSELECT page_id, md5(trim(regexp_replace({ENTITIES}, '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM p")
def parse_rss_clean(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.plain_text(F.col("html"))).alias("text_md5"))


ITEMS_SQL = r"""SELECT *, regexp_replace(lower(description), '[^a-z0-9]', '', 'g') AS dk, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS tk FROM (
 SELECT doc_id, coalesce(source, '') AS source, trim(regexp_replace(coalesce(substring(text, 1, 200), ''), '[\x00-\x20]+', ' ', 'g')) AS title,
  trim(regexp_replace(coalesce(CASE WHEN doc_id % 2 = 0 THEN substring(text, 101) ELSE text END, ''), '[\x00-\x20]+', ' ', 'g')) AS description FROM documents WHERE doc_id IS NOT NULL) t"""


@query("parse_rss", f"WITH fi AS ({ITEMS_SQL})\nSELECT doc_id, md5(title) AS title_md5, source, CAST(1704067200 + doc_id * 3607 AS BIGINT) AS published, CASE WHEN description = '' OR starts_with(dk, substring(tk, 1, 60)) THEN '' ELSE md5(description) END AS description_md5 FROM fi")
def parse_rss(spark, sf_dir: str) -> DataFrame:
    """Feeds of 25 documents each, written as XML with the publisher behind the title and dates in a zone of their own, read back by item.

    Items of even ids are described by their text from its 101st character on, the others by the whole of it, which repeats the title.
    """
    clean = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x20]+", " "))
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    even = F.col("doc_id") % 2 == 0
    source = F.coalesce("source", F.lit(""))
    fields = {
        "title": F.concat(escaped(clean(F.col("title"))), F.when(source != "", F.concat(F.lit(" - "), escaped(source))).otherwise("")),
        "link": F.col("doc_id").cast("string"),
        "pubDate": F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.timestamp_seconds(1704067200 + F.col("doc_id") * 3607).cast("timestamp_ntz")), "E, dd MMM yyyy HH:mm:ss '+0530'"),
        "source": escaped(source),
        "description": escaped(escaped(clean(F.when(even, F.substr("body", F.lit(101))).otherwise(F.col("body"))))),
    }
    item = F.concat(F.lit("<item>"), *(x for n, c in fields.items() for x in (F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))), F.lit("</item>"))
    docs = headlines(spark, sf_dir).where("doc_id IS NOT NULL").select(F.floor(F.col("doc_id") / 25).alias("feed"), item.alias("item"))
    written = docs.groupBy("feed").agg(F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("xml"))
    hashed = F.when(F.col("description") == "", "").otherwise(F.md5("description")).alias("description_md5")
    read = parsers.feed_items(written, ["feed"])
    return read.select(F.col("link").cast("long").alias("doc_id"), F.md5("title").alias("title_md5"), "source", F.unix_seconds("published").alias("published"), hashed)


@query("news_newest_first", f"WITH {HEADLINES}\nSELECT doc_id, source FROM headlines ORDER BY doc_id DESC LIMIT 50")
def news_newest_first(spark, sf_dir: str) -> DataFrame:
    return headlines(spark, sf_dir).select("doc_id", "source").orderBy(F.desc_nulls_last("doc_id")).limit(50)


@query("age_hours", "SELECT event_id, round(greatest(epoch(TIMESTAMP '2024-02-01' - ts) / 3600.0, 0), 9) AS age FROM events")
def age_hours(spark, sf_dir: str) -> DataFrame:
    age = F.greatest((F.lit(1706745600.0) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 3600.0, F.lit(0.0))
    return rounded(table(spark, sf_dir, "events").select("event_id", F.coalesce(age, F.lit(999.0)).alias("age")), 9)


MARK = "chr(1)"
PLAIN = f"pl AS (SELECT page_id, trim(regexp_replace({ENTITIES}, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS x FROM pages) p)"
SUMMED = f"""{PLAIN}, se AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-Z0-9])', '\\1' || {MARK} || '\\2', 'g'), {MARK}), lambda s: trim(s)), lambda s: len(s) > {tx.LEAST_SENTENCE}) AS s FROM pl),
 si AS (SELECT page_id, len(s) AS n, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS i FROM se),
 to_ AS (SELECT page_id, i, list_filter(regexp_extract_all(lower(sentence), '[a-z'']{{3,}}'), lambda w: NOT list_contains({listed(tx.STOP)}, w)) AS t FROM si WHERE n > 2),
 wc AS (SELECT page_id, i, len(t) AS m, w, count(*) AS c FROM (SELECT page_id, i, t, unnest(t) AS w FROM to_) u GROUP BY ALL),
 pr AS (SELECT a.page_id, a.i, sum(least(a.c, b.c)) / (ln(1 + a.m) + ln(1 + b.m)) AS v FROM wc a JOIN wc b ON a.page_id = b.page_id AND a.w = b.w AND a.i <> b.i GROUP BY a.page_id, a.i, b.i, a.m, b.m),
 sr AS (SELECT si.page_id, si.i, round(coalesce(sum(v), 0), 6) AS score FROM si LEFT JOIN pr ON pr.page_id = si.page_id AND pr.i = si.i WHERE n > 2 GROUP BY 1, 2),
 tp AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, i) AS rn FROM sr),
 su AS (SELECT page_id, string_agg(sentence, ' ' ORDER BY i) AS summary FROM (SELECT si.page_id, si.i, sentence FROM si LEFT JOIN tp ON tp.page_id = si.page_id AND tp.i = si.i WHERE (n = 2) OR rn <= 2) q GROUP BY 1)"""


@query("summarize", f"WITH {SUMMED}\nSELECT pl.page_id, md5(coalesce(summary, text, '')) AS summary_md5 FROM pl LEFT JOIN su USING (page_id)")
def summarize(spark, sf_dir: str) -> DataFrame:
    return summaries(table(spark, sf_dir, "pages")).select("page_id", F.md5("summary").alias("summary_md5"))


def summaries(pages: DataFrame, most: int = 2) -> DataFrame:
    """page_id, summary: the `most` sentences of each page's text that are most alike to its others, in their order.

    Two sentences of n and m words that share c of them, counted as often as both have them, are alike by c / (ln(1 + n) + ln(1 + m)).
    A word's first, second and further occurrences are words of their own, so counts of sentences by page, word and m give the sums
    and no pairs are listed. Pages with fewer sentences than two keep their text, those with no more than `most` all of them.
    """
    docs = pages.select("page_id", F.coalesce(tx.plain_text(F.col("html")), F.lit("")).alias("text"))
    rows = pieces(docs)
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "i")
    ranked = rows.join(similarity(pages, most), ["page_id", "i"], "left").withColumn("rn", F.row_number().over(order)).where((F.col("n") <= most) | (F.col("rn") <= most))
    best = ranked.groupBy("page_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "sentence"))), lambda s: s["sentence"])).alias("best"))
    return docs.join(best, "page_id", "left").select("page_id", F.coalesce("best", "text").alias("summary"))


def pieces(docs: DataFrame) -> DataFrame:
    """page_id, n (sentences of the page, two at least), i, sentence."""
    parts = docs.select("page_id", tx.sentences(F.col("text")).alias("s")).withColumn("n", F.size("s"))
    return parts.where(F.col("n") > 1).select("page_id", "n", F.posexplode("s").alias("i", "sentence"))


def similarity(pages: DataFrame, most: int = 2) -> DataFrame:
    """page_id, i, score of the sentences of pages that have more than `most`; scores are rounded, so equal sentences tie."""
    docs = pages.select("page_id", F.coalesce(tx.plain_text(F.col("html")), F.lit("")).alias("text"))
    rows = pieces(docs)
    bags = rows.where(F.col("n") > most).select("page_id", "i", tx.tokenize(F.col("sentence")).alias("bag")).select("page_id", "i", F.size("bag").alias("m"), F.explode("bag").alias("word"))
    again = F.row_number().over(Window.partitionBy("page_id", "i", "word").orderBy("m"))
    words = bags.withColumn("occurrence", again)
    holding = words.groupBy("page_id", "word", "occurrence", F.col("m").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    alike = (F.col("c") - (F.col("k") == F.col("m")).cast("int")) / (F.log1p("m") + F.log1p("k"))
    score = words.join(holding, ["page_id", "word", "occurrence"]).groupBy("page_id", "i").agg(F.sum(alike).alias("score"))
    kept = rows.where(F.col("n") > most).select("page_id", "i").join(score, ["page_id", "i"], "left")
    return kept.select("page_id", "i", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query("tokenize", f"WITH {PLAIN}\nSELECT page_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT page_id, list_filter(regexp_extract_all(lower(text), '[a-z'']{{3,}}'), lambda w: NOT list_contains({listed(tx.STOP)}, w)) AS t FROM pl) q")
def tokenize(spark, sf_dir: str) -> DataFrame:
    t = tx.tokenize(tx.plain_text(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("sentence_similarity", rounded_sql(f"WITH {SUMMED}\nSELECT page_id, i - 1 AS i, score FROM sr", "score").replace("i - 1 AS i", "CAST(i - 1 AS INTEGER) AS i"))
def sentence_similarity(spark, sf_dir: str) -> DataFrame:
    """How alike each sentence is to the others of its page, summed; pages of more than two sentences."""
    return rounded(similarity(table(spark, sf_dir, "pages")))
