"""PII: regular expressions propose spans, checksums confirm them, context words adjust their scores.

All of it is column expressions. Where a match starts follows from the lengths of the pieces that `split` leaves and of
the matches; offsets are code points, ends exclusive. The base kinds email, ip, card and phone are always reported if
they pass their check (parts of an address up to 255, Luhn, numbers of digits); the added kinds iban (mod 97) and ssn
are reported from a score of MIN_SCORE up. A score is the kind's own plus CONTEXT_BONUS if one of the kind's context
words stands in the CONTEXT_CHARS characters before the span, 1 at most.

The patterns are written so that Java's matcher neither backtracks nor recurses over long runs: loops are possessive,
and a run of name characters or digits is only entered at its beginning or where the last match ended, which finds
the same leftmost matches. Cheap tests keep most texts from the expensive patterns.

Defined results: a null or empty text has no spans; redaction leaves it as it is. Overlapping spans of different kinds
are all reported; redaction puts one mark, of the kind that begins first, for what they cover together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE, CONTEXT_BONUS, CONTEXT_CHARS = 0.6, 0.3, 40
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """13 to 19 digits whose weighted sum is a multiple of 10; every second one from the right counts double, less 9 above 9."""
    d = digits(m)
    n = F.length(d)

    def value(i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda a, i: a + value(i)) % 10 == 0)


def mod_97(m: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35, leave 1 when divided by 97."""
    packed = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 4))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.length(packed).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


#: kind: (test that a text may hold one, pattern, check of a match, own score, context words)
KINDS = {
    "email": (lambda t: t.contains("@"), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.9, "e-?mail|contact|write"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"), 0.6, "ip|address|host|server"),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.8, "card|visa|credit|payment"),
    "phone": (lambda t: t.contains("+"), r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(9, 15), 0.6, "phone|tel|call|mobile"),
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod_97, 0.9, "iban|account|bank"),
    "ssn": (lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.4, "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one kind, by start."""
    may, pattern, check, own, words = KINDS[kind]
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    placed = F.aggregate(
        F.filter(pieces, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string>>").alias("found")),
        lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["m"])).alias("at"), F.concat(a["found"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["m"].alias("m")))).alias("found")),
        lambda a: a["found"],
    )

    def scored(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT_CHARS))))
        score = F.least(F.lit(own) + F.when(before.rlike(rf"(?<![a-z])(?:{words})(?![a-z])"), CONTEXT_BONUS).otherwise(0.0), F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), x["m"].alias("value"), score.alias("score"))

    found = F.transform(F.filter(placed, lambda x: check(x["m"])), scored)
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= MIN_SCORE)
    return F.when(may(text), found).otherwise(F.array().cast(SPAN))


def pii_spans(text: Column) -> Column:
    """All spans of a text, by kind as listed and then by start: kind, start, end, value, score."""
    return F.concat(*(spans_of(F.coalesce(text, F.lit("")), kind) for kind in KINDS))


def redact(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of what spans cover."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        more = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(a["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    found = table(spark, sf_dir, "documents").select("doc_id", pii_spans(F.col("text")).alias("found"))
    of = lambda *kinds: F.filter("found", lambda s: reduce(Column.__or__, [s["kind"] == k for k in kinds]))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))
