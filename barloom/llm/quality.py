"""Quality rules: a table of thresholds compiled into one projection of ratios of a text.

Measures are built-in functions only, so the whole judgement is a single projection over the scan: no shuffle, no user
function, nothing gathered beyond one text. Steps that several measures need (a text's words, its window hashes) are bound once by
a one-element array. Windows of REPEAT words are compared by hash; where hashes of one text meet, the words themselves are compared.

Defined results: a null text has no words and is judged like an empty one. A ratio without a denominator is NULL and breaks no
rule; texts that short break `least_words`. Every row is judged alone, so repeats, ties and null ids do not matter, an empty table
gives no rows, and columns of the input other than text pass through (those named like a result are replaced). Texts count whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import table

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
REPEAT = 8
#: Marks that a word loses at its ends before it is looked up among the stop words.
MARKS = ".,;:!?\"'()"
#: Frequent function words of the corpus' languages; a parameter of every function below.
STOP_WORDS = tuple(
    (
        "a an and are as at be been but by for from had has have he her his if in is it its not of on or she that the their they this to was we were which will with you "
        "als am an auch auf aus bei das dass dem den der des die ein eine einer es für hat ich im in ist mit nach nicht sich sie sind und von war werden wie zu zum "
        "au aux avec ce ces cette dans de des du elle en est et il la le les mais ne ou par pas plus pour que qui sa se son sur un une "
        "al como con de del el en es esta este la las lo los más no para pero por que se sin su sus un una y"
    ).split()
)
STOP_WORDS = tuple(sorted(set(STOP_WORDS)))


@dataclass(frozen=True)
class Threshold:
    """A text breaks the rule if its measure is below `least` or above `most`."""

    rule: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The base rules are those that every text must pass first.
BASE = (
    Threshold("least_words", "n_words", least=20),
    Threshold("repeated_windows", "repeated_share", most=30),
)
RULES = (
    Threshold("word_length", "mean_word_chars", least=2, most=12),
    Threshold("symbols", "symbols_per_word", most=0.25),
    Threshold("stop_words", "stop_share", least=0.06),
    Threshold("repeated_lines", "repeated_line_share", most=0.4),
    Threshold("bullets", "bullet_share", most=0.9),
    Threshold("ellipses", "ellipsis_share", most=0.3),
)


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def repeated_words(words: Column, k: int = REPEAT) -> Column:
    """How many words are in windows of k words that are in the list twice or more."""
    window = lambda at: F.slice(words, at + 1, F.lit(k))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda at: F.xxhash64(window(at)))

    def covered(entries: Column) -> Column:
        """entries: struct(h, at) in order, so equal windows are neighbours."""

        def same(x: Column, j: Column) -> Column:
            other = F.get(entries, j)
            return F.coalesce((other["h"] == x["h"]) & (window(other["at"]) == window(x["at"])), F.lit(False))

        found = F.transform(entries, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["at"]))
        places = F.sort_array(F.filter(found, lambda at: at.isNotNull()))
        return bind(places, lambda p: total(F.transform(p, lambda at, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - at, F.lit(k))).cast("long"))))

    def judged(h: Column) -> Column:
        entries = F.sort_array(F.transform(h, lambda x, at: F.struct(x.alias("h"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(entries, covered))

    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(bind(hashes, judged))


def counts(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """struct of the counts of a text, all long: n_words, word_chars, n_symbols, n_stop_words, n_repeat_words, n_lines (with a word), n_dup_lines, n_bullets, n_ellipses."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted(set(stop_words))
    has_word = lambda x: x.rlike(WORD)

    def of_words(words: Column) -> Column:
        stops = F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(*stop)) if stop else F.array()
        return F.struct(F.size(words).cast("long").alias("n"), F.size(stops).cast("long").alias("stop"), repeated_words(words).alias("repeated"))

    def of_lines(lines: Column) -> Column:
        number = lambda x: F.size(x).cast("long")
        bullets = F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*([-*•]|[0-9]+[.)])[\x20\x09-\x0D]"))
        ellipses = F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))
        return F.struct(number(lines).alias("n"), (number(lines) - number(F.array_distinct(lines))).alias("dup"), number(bullets).alias("bullets"), number(ellipses).alias("ellipses"))

    words = bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)
    lines = bind(F.filter(F.split(text, "\n", -1), has_word), of_lines)
    number_of = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return bind(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            x["w"]["n"].alias("n_words"), (F.length(text) - number_of(SPACE)).alias("word_chars"), number_of(f"[{SYMBOLS}]").alias("n_symbols"),
            x["w"]["stop"].alias("n_stop_words"), x["w"]["repeated"].alias("n_repeat_words"), x["l"]["n"].alias("n_lines"), x["l"]["dup"].alias("n_dup_lines"),
            x["l"]["bullets"].alias("n_bullets"), x["l"]["ellipses"].alias("n_ellipses"),
        ),
    )


#: A measure of the counts c; shares of repeated words are in per cent, so whole numbers are compared.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda c: c["n_words"],
    "mean_word_chars": lambda c: F.try_divide(c["word_chars"], c["n_words"]),
    "symbols_per_word": lambda c: F.try_divide(c["n_symbols"], c["n_words"]),
    "stop_share": lambda c: F.try_divide(c["n_stop_words"], c["n_words"]),
    "repeated_share": lambda c: F.try_divide(100 * c["n_repeat_words"], c["n_words"]),
    "repeated_line_share": lambda c: F.try_divide(c["n_dup_lines"], c["n_lines"]),
    "bullet_share": lambda c: F.try_divide(c["n_bullets"], c["n_lines"]),
    "ellipsis_share": lambda c: F.try_divide(c["n_ellipses"], c["n_lines"]),
    "words_per_line": lambda c: F.try_divide(c["n_words"], c["n_lines"]),
}


def read_rules(rows: Iterable) -> tuple[Threshold, ...]:
    """Thresholds of rows (rule, measure, least, most), such as the collected rows of a table; what cannot be applied is an error."""
    rules = tuple(Threshold(*row) for row in rows)
    for i, r in enumerate(rules):
        if r.measure not in MEASURES:
            raise ValueError(f"no measure {r.measure!r}; there are {', '.join(MEASURES)}")
        if r.least is None and r.most is None:
            raise ValueError(f"rule {r.rule!r} has no threshold")
        if any(r.rule == x.rule for x in rules[:i]):
            raise ValueError(f"two rules are named {r.rule!r}")
    return rules


def broken(counted: Column, rules: Iterable[Threshold]) -> Column:
    """Names of the rules that a text with these counts breaks, in the table's order."""

    def breaks(r: Threshold) -> Column:
        x = MEASURES[r.measure](counted)
        below = x < r.least if r.least is not None else F.lit(False)
        above = x > r.most if r.most is not None else F.lit(False)
        return F.when(below | above, F.lit(r.rule))

    return F.array_compact(F.array(*map(breaks, rules))) if (rules := tuple(rules)) else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: Iterable[Threshold] = RULES, base: Iterable[Threshold] = BASE, text: str = "text", stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Adds counts (see `counts`), base_failed, failed (names of the broken rules, base ones first) and kept."""
    found = ("counts", "base_failed", "failed", "kept")
    base, rules = read_rules(map(_row, base)), read_rules(map(_row, rules))

    def verdict(c: Column) -> Column:
        return bind(
            F.struct(broken(c, base).alias("base"), broken(c, rules).alias("more")),
            lambda b: F.struct(c.alias("counts"), (F.size(b["base"]) > 0).alias("base_failed"), F.concat(b["base"], b["more"]).alias("failed"), (F.size(b["base"]) + F.size(b["more"]) == 0).alias("kept")),
        )

    judged = docs.select(F.struct("*").alias("row"), bind(counts(F.col(text), stop_words), verdict).alias("judged"))
    return judged.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in found), *(F.col("judged")[c].alias(c) for c in found))


def _row(r: Threshold) -> tuple:
    return r.rule, r.measure, r.least, r.most


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = [F.col("counts")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")]
    return judged.select("doc_id", *shown, "base_failed", "kept", F.concat_ws(",", "failed").alias("failed"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    stop = ", ".join(map(quoted, STOP_WORDS))
    ratio = {
        "n_words": "n_words", "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbols_per_word": "n_symbols / nullif(n_words, 0)", "stop_share": "n_stop_words / nullif(n_words, 0)",
        "repeated_share": "100 * n_repeat_words / nullif(n_words, 0)", "repeated_line_share": "n_dup_lines / nullif(n_lines, 0)", "bullet_share": "n_bullets / nullif(n_lines, 0)",
        "ellipsis_share": "n_ellipses / nullif(n_lines, 0)",
    }
    breaks = lambda r: " OR ".join(f"{ratio[r.measure]} {sign} {x}" for sign, x in (("<", r.least), (">", r.most)) if x is not None)
    names = lambda rules: ", ".join(f"CASE WHEN {breaks(r)} THEN '{r.rule}' END" for r in rules)
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
windows AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + {REPEAT - 1}], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {REPEAT - 2})) AS pos FROM split)),
repeated AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, CAST(sum(least({REPEAT}, coalesce(nxt - pos, {REPEAT}))) AS BIGINT) AS n_repeat_words FROM repeated GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, len(ws) AS n_words, CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         len(list_filter(ws, lambda w: lower(trim(w, {quoted(MARKS)})) IN ({stop}))) AS n_stop_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^{SPACE}*([-*•]|[0-9]+[.)]){SPACE}'))) AS n_bullets,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){SPACE}*$'))) AS n_ellipses
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
judged AS (SELECT *, list_filter([{names(BASE)}], lambda x: x IS NOT NULL) AS base, list_filter([{names(RULES)}], lambda x: x IS NOT NULL) AS more FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, len(base) > 0 AS base_failed, len(base) + len(more) = 0 AS kept,
       array_to_string(list_concat(base, more), ',') AS failed FROM judged
"""


OP12_SQL = _sql()
