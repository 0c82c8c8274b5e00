"""Headline functions: keys, cleaning, sentiment, impact, sessions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed word lists of the sentiment scorer.
POSITIVE = (
    "gain gains gained rally rallies rallied surge surges surged soar soars soared jump jumps jumped rise rises rose rising up upbeat beat beats "
    "record high highs strong stronger strength boost boosts boosted bullish outperform outperforms upgrade upgrades upgraded buy accumulate profit "
    "profits growth grows expands expansion recovery recovers rebound rebounds positive optimism optimistic advance advances climb climbs climbed "
    "inflow inflows easing eases cut cuts dovish stimulus winner winners top robust"
).split()
NEGATIVE = (
    "fall falls fell fallen drop drops dropped plunge plunges plunged crash crashes crashed slump slumps slumped sink sinks sank slide slides slid "
    "down decline declines declined weak weaker weakness loss losses lost bearish downgrade downgrades downgraded sell selloff sell-off miss misses "
    "missed low lows fear fears concern concerns worry worries risk risks pressure outflow outflows hawkish hike hikes inflation deficit fraud probe "
    "penalty default war tension tensions tariff tariffs sanctions recession volatile volatility uncertainty crisis shutdown strike laggard laggards "
    "tumble tumbles tumbled rout panic"
).split()
NEGATORS = "not no without despite unlikely halt halts snap snaps".split()
INTENSIFIERS = "sharply strongly massively heavily steep steeply big huge major".split()
RATES = r"\brates?\b|\brepo\b|\brbi\b|\bfed\b"
#: Fixed categories of the impact call, first match first: pattern, weight, sign for equities.
CATEGORIES = (
    ("rbi_policy", r"(?i)\brbi\b|\bmpc\b|repo rate|monetary policy", 0.95, 1),
    ("global_cues", r"(?i)\bfed\b|fomc|wall street|nasdaq|dow|s&p|treasury|us market|powell", 0.80, 1),
    ("fii_flows", r"(?i)\bfii\b|\bdii\b|foreign (portfolio )?investor|fpi", 0.75, 1),
    ("inflation_macro", r"(?i)inflation|\bcpi\b|\bwpi\b|\bgdp\b|\biip\b|\bpmi\b|fiscal deficit", 0.70, 1),
    ("crude_oil", r"(?i)crude|brent|\bopec\b|oil price", 0.60, -1),
    ("regulation_tax", r"(?i)\bsebi\b|\bgst\b|budget|taxation|tariff|import duty|export ban", 0.65, 1),
    ("geopolitics", r"(?i)\bwar\b|border|missile|geopolit|election|attack|conflict", 0.65, 1),
    ("earnings", r"(?i)\bq[1-4]\b|results|earnings|net profit|revenue|ebitda|guidance", 0.55, 1),
    ("corporate_action", r"(?i)merger|acquisition|stake|buyback|\bipo\b|delisting|bonus issue|split", 0.45, 1),
)
#: Of each category pieces in lower case, one of which stands in any text that its pattern matches; these are far cheaper to look for.
MARKS = {
    "rbi_policy": "rbi|mpc|repo rate|monetary policy",
    "global_cues": "fed|fomc|wall street|nasdaq|dow|s&p|treasury|us market|powell",
    "fii_flows": "fii|dii|foreign |fpi",
    "inflation_macro": "inflation|cpi|wpi|gdp|iip|pmi|fiscal deficit",
    "crude_oil": "crude|brent|opec|oil price",
    "regulation_tax": "sebi|gst|budget|taxation|tariff|import duty|export ban",
    "geopolitics": "war|border|missile|geopolit|election|attack|conflict",
    "earnings": "q1|q2|q3|q4|results|earnings|net profit|revenue|ebitda|guidance",
    "corporate_action": "merger|acquisition|stake|buyback|ipo|delisting|bonus issue|split",
}
#: Fixed multiplier of each session phase; the closing auction and the derivatives tail count as closing.
TIMING = {"overnight": 1.15, "post_market": 1.05, "pre_open": 1.20, "opening": 1.10, "midday": 0.90, "closing": 0.95, "auction": 0.95, "closing_deriv": 0.95}
#: Fixed beginnings of the session phases in Indian time, minutes after midnight.
PHASES = ((540, "pre_open"), (555, "opening"), (600, "midday"), (870, "closing"), (915, "auction"), (935, "closing_deriv"), (940, "post_market"), (1080, "overnight"))


def headline_key(title: Column, day: Column | None = None) -> Column:
    """Lower-case letters and digits, 120 at most, and the day."""
    plain = F.substring(F.regexp_replace(F.lower(title), "[^a-z0-9]", ""), 1, 120)
    return F.concat_ws("|", plain, F.coalesce(day.cast("string"), F.lit("nodate")) if day is not None else F.lit("nodate"))


def words(low: Column) -> Column:
    """Words of a lower-cased text."""
    return F.regexp_extract_all(low, F.lit("[a-z']+"), 0)


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def sentiment(text: Column) -> Column:
    """struct(score, hits) of a text: list words count 1 or -1, turned to -0.8 by a negator and raised by half by an intensifier in the three words before.

    Each step is bound by a one-element array, so a text is lower-cased and split, and its words are weighed, once however often they are used.
    """
    return bind(F.lower(text), low_sentiment)


def low_sentiment(low: Column) -> Column:
    """The sentiment of a text that is lower-cased already."""
    one = lambda names: F.array(*map(F.lit, names))
    rates = low.contains("cut") & low.rlike(RATES)  # of no use without a cut

    def weights(x: Column) -> Column:
        def weigh(t: Column, i: Column) -> Column:
            own = F.when(t.isin("cut", "cuts") & ~x["rates"], -1.0).when(t.isin(*POSITIVE), 1.0).otherwise(-1.0)
            before = F.slice(x["tokens"], F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            turned = F.when(F.arrays_overlap(before, one(NEGATORS)), -0.8 * own).otherwise(own)
            return F.when(F.arrays_overlap(before, one(INTENSIFIERS)), 1.5 * turned).otherwise(turned)

        listed = lambda t, i: F.when(t.isin(*POSITIVE, *NEGATIVE), weigh(t, i)).otherwise(0.0)
        return F.filter(F.transform(x["tokens"], listed), lambda w: w != 0)

    def scored(w: Column) -> Column:
        total, hits = F.aggregate(w, F.lit(0.0), lambda a, v: a + v), F.size(w)
        score = F.when(hits == 0, 0.0).otherwise(F.greatest(F.least(0.6 * total / F.pow(F.greatest(hits, F.lit(1)).cast("double"), F.lit(0.7)), F.lit(1.0)), F.lit(-1.0)))
        return F.struct(score.alias("score"), hits.cast("long").alias("hits"))

    return bind(F.struct(words(low).alias("tokens"), rates.alias("rates")), lambda x: bind(weights(x), scored))


def sentiment_label(score: Column) -> Column:
    return F.when(score >= 0.35, "bullish").when(score >= 0.12, "mildly bullish").when(score <= -0.35, "bearish").when(score <= -0.12, "mildly bearish").otherwise("neutral")


def category(text: Column) -> Column:
    """struct(name, weight, flip) of the first category whose pattern a text matches. Only texts with one of its marks are searched for a pattern."""
    return bind(F.lower(text), lambda low: low_category(text, low))


def low_category(text: Column, low: Column) -> Column:
    """The category of a text that is also there lower-cased."""
    made = lambda n, w, f: F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(f).alias("flip"))
    out = made("other", 0.30, 1)
    for name, pattern, weight, flip in reversed(CATEGORIES):
        marked = reduce(Column.__or__, (low.contains(m) for m in MARKS[name].split("|")))
        out = F.when(marked & text.rlike(pattern), made(name, weight, flip)).otherwise(out)
    return out


def session_phase(ts: Column) -> Column:
    """Phase of the Indian session at a UTC time; weekends are overnight."""
    local = F.from_utc_timestamp(ts, "Asia/Kolkata")
    minute = F.hour(local) * 60 + F.minute(local)
    out = F.lit("overnight")
    for begin, name in PHASES:
        out = F.when(minute >= begin, name).otherwise(out)
    return F.when(F.weekday(local) >= 5, "overnight").otherwise(out)


def impact(text: Column, ts: Column) -> Column:
    """struct(category, phase, direction, confidence) of a headline."""
    phase = session_phase(ts)
    timing = F.create_map(*(F.lit(x) for pair in TIMING.items() for x in pair))[phase]

    def scored(low: Column) -> Column:
        return F.struct(low_sentiment(low)["score"].alias("score"), low_category(text, low).alias("found"), phase.alias("phase"), timing.alias("timing"))

    def facts(x: Column) -> Column:
        found = x["found"]
        return F.struct((x["score"] * found["flip"]).alias("effective"), found["name"].alias("category"), found["weight"].alias("weight"), x["phase"].alias("phase"), x["timing"].alias("timing"))

    def call(x: Column) -> Column:
        direction = F.when(x["effective"] > 0.08, "bullish").when(x["effective"] < -0.08, "bearish").otherwise("neutral")
        confidence = F.least(0.5 + 0.45 * F.abs(x["effective"]) * x["weight"] * x["timing"], F.lit(0.85))
        return F.struct(x["category"].alias("category"), x["phase"].alias("phase"), direction.alias("direction"), F.when(direction == "neutral", F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"))

    return bind(bind(F.lower(text), scored), lambda x: bind(facts(x), call))


def unescaped(x: Column) -> Column:
    """Text with the common entities' characters."""
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(mark))
    return x


def plain_text(html: Column) -> Column:
    """Text of a piece of HTML: tags and runs of space become one space, the common entities their characters."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, "<[^>]*>", " ")), r"[ \t\n\r]+", " "))


#: Fixed words that say nothing of a sentence.
STOP = (
    "the and for are but not you all any can her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "that this with from they will have been were said each which their time would there what about into more other could than then them these some only over "
    "after also just most such where through before between during under while"
).split()
LEAST_SENTENCE = 20


def tokenize(sentence: Column) -> Column:
    """Words of three letters or more, lower-cased, without those that say nothing; a word that repeats counts each time."""
    return F.filter(F.regexp_extract_all(F.lower(sentence), F.lit("[a-z']{3,}"), 0), lambda w: ~w.isin(*STOP))


def sentences(text: Column) -> Column:
    """Pieces of a text that end in . ! or ? before a space and a capital or digit, longer than LEAST_SENTENCE characters."""
    pieces = F.transform(F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " ")), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: F.length(s) > LEAST_SENTENCE)
