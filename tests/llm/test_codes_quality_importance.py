"""Vector codes, quality rules and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import codes, importance, quality

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd's algorithm with every distance computed, in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == n]
    ends = np.cumsum([n // parts + (p < n % parts) for p in range(parts)]).tolist()
    cut = [[v[a:b] for a, b in zip([0, *ends], ends, strict=False)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups: dict = {}
            for c in cut:
                groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[k]) for col in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    coded = [(i, label, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _, label), f in zip(kept, found, strict=True)]
    return sorted(coded, key=repr), [x for book in books for e in book for x in e]


@pytest.mark.parametrize("n,length,entries,kind", [(700, 16, 16, "grid"), (300, 13, 16, "normal"), (9, 16, 16, "normal"), (400, 5, 4, "grid"), (300, 8, 200, "normal")])
def test_codes_are_lloyds(spark, monkeypatch, n, length, entries, kind):
    """Points on a coarse grid tie often; chunks of 128 make many trees."""
    monkeypatch.setattr(codes, "CHUNK", 128)
    rng = np.random.default_rng(n)
    made = rng.integers(-2, 3, (n, length)) / 8 if kind == "grid" else rng.normal(0, 0.2, (n, length))
    rows = [(i * 7 % 1009, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)) if i % 5 else None) for i, v in enumerate(made)]
    rows += [(None, rows[0][1], 1), rows[3], (rows[4][0], rows[5][1], 2), (1, None, 1), (2, [None, *rows[0][1][1:]], 1), (3, [math.nan, *rows[0][1][1:]], 1), (4, [math.inf, *rows[0][1][1:]], 1), (-5000, [0.5], 1)][:7]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    coded, books, shape = codes.compress(vectors, entries=entries)
    want, book = plain_codes(rows, entries=entries)
    assert codes.flat(books, shape) == book
    assert sorted([(r["vec_id"], r["label"], r["code"], r["error"]) for r in coded.collect()], key=repr) == want


def test_forest_assigns_whole_subtrees():
    """Clustered points: most are assigned by their subtree, sums are those of all points, and packing loses nothing."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 8)))[None]
    forest = codes.Forest.unpack(codes.Forest.build(points).pack())
    books = centres[None].astype(np.int64)
    far = ((points[0][:, None] - books[0]) ** 2).sum(2)
    entry, error = forest.codes(books)
    assert (entry[:, 0] == far.argmin(1)).all() and (error == far.min(1)).all()
    sums = forest.totals(books)[0]
    assert all((sums[k, :-1] == points[0][entry[:, 0] == k].sum(0)).all() and sums[k, -1] == (entry[:, 0] == k).sum() for k in range(16))
    undecided = [len(part) for level, part, _, _ in forest.owners(books) if level == -1]
    assert undecided[0] * codes.LEAF < 0.5 * 4000


def test_codes_of_wide_numbers_and_nothing(spark):
    rows = [(i, [3e38 * (-1) ** i, 1e-30, -1e-30, float(i)] * 2, 1) for i in range(40)]
    coded, books, _ = codes.compress(spark.createDataFrame(rows, VECTORS))
    assert coded.count() == 40 and np.abs(books).max() <= codes.MOST and all(r["error"] >= 0 for r in coded.collect())
    coded, books, _ = codes.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], VECTORS))
    assert [(r["code"], r["error"]) for r in coded.collect()] == [("00" * 8, 0), ("01" * 8, 0)][:1] * 2
    assert codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS))[0].count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    n = len(words)
    stop = sum(w.strip(quality.MARKS).lower() in quality.STOP_WORDS for w in words)
    base = n < 20 or 100 * len(covered) > 30 * n
    symbols, dup = len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines))
    bullets, ellipses = sum(bool(re.match(r"[\x20\x09-\x0D]*([-*•]|[0-9]+[.)])[\x20\x09-\x0D]", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines)
    chars = sum(map(len, words))
    bad = n and (not 2 * n <= chars <= 12 * n or symbols > 0.25 * n or stop < 0.06 * n or dup / len(lines) > 0.4 or bullets / len(lines) > 0.9 or ellipses / len(lines) > 0.3)
    return n, chars, symbols, dup, len(covered), stop, len(lines), base, not base and not bad


def odd_texts():
    rng = random.Random(11)
    texts = [None, "", " \n\t", "one", "a b  c", "é" * 50, "日本 " * 30, "the " * 30, "x" * 300_000, "\n".join(["- the cat sat on it"] * 3 + ["end of the list ..."] * 9)]
    for _ in range(150):
        vocabulary = [rng.choice(["the", "and", "la", "der", "cat", "Dog,", "x1", "$$$", "a|b", "(of)", "naïve", "…"]) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(2, 30))]
        texts.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "\r\n", "\t", "  "]) for _ in range(rng.randrange(1, 200))))
    unique = " ".join(f"the w{i} of" for i in range(30_000))
    return [*texts, unique, unique + " " + unique[:2000]]


def test_quality_counts(spark):
    texts = odd_texts()
    judged = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    for r in judged.collect():
        c = r["counts"]
        got = (*(c[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")), r["base_failed"], r["kept"])
        assert got == plain_quality(r["text"]), repr(r["text"])[:200]
        assert r["kept"] == (not r["failed"]) and (not r["base_failed"] or {"least_words", "repeated_windows"} & set(r["failed"]))


def test_quality_table_is_checked_and_compiled(spark):
    rules = quality.read_rules([("short", "n_words", 5, None), ("long lines", "words_per_line", None, 50)])
    docs = spark.createDataFrame([(1, "a b c", 7), (2, "a b c d e f", 8), (3, "w " * 60, 9)], "doc_id long, text string, kept int")
    got = {r["doc_id"]: (r["failed"], r["kept"]) for r in quality.judge(docs, rules, base=()).collect()}
    assert got == {1: (["short"], False), 2: ([], True), 3: (["long lines"], False)}
    plan = quality.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    for bad in ([("x", "nothing", 1, None)], [("x", "n_words", None, None)], [("x", "n_words", 1, None)] * 2):
        with pytest.raises(ValueError):
            quality.read_rules(bad)


def test_clean_documents_stay(spark, medium):
    """Labelled good documents that pass the base rules are kept, and most of the labelled bad ones go."""
    judged = quality.op12_quality_rules(spark, medium).join(spark.read.parquet(f"{medium}/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert len(good) > 200 and all(good) and sum(bad) < 0.1 * len(bad)


def plain_features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent, least):
    hashed = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(hashed, plain_features(x)[1]))
    for x in target:
        t.update(map(hashed, plain_features(x)[1]))
    a, b = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (a + 10000) / ((s[k] + 1) * (b + 10000))))
    rows = []
    for i, x in docs:
        n, f = plain_features(x)
        weight = sum(gain(hashed(g)) for g in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter((r[:4], k) for k, r in enumerate(may[: percent * len(may) // 100], 1))
    return rows, drawn


@pytest.mark.parametrize("piece,each", [(importance.PIECE, importance.SORTED_ROWS), (64, 7)])
def test_importance(spark, monkeypatch, piece, each):
    """Texts cut into pieces and ranks put together from many ranges give the same."""
    monkeypatch.setattr(importance, "PIECE", piece)
    monkeypatch.setattr(importance.pieces, "__defaults__", (piece, importance.RUNS))
    monkeypatch.setattr(importance.ranked, "__defaults__", (None, each))
    docs = [(i * 3, x) for i, x in enumerate(odd_texts()) if not x or len(x) < 100_000] + [(None, "the cat of la " * 9)] * 3 + [(7, "the cat la " * 20)] * 30
    docs += [(5000, "y" * 500 + " the " + "Z" * 90 + "9 end"), (5001, "ÀÉ日本-x " * 40)]
    target = ["the cat sat", None, "", "la cat x1s dog"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), 25, 20).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    rows, drawn = plain_resample(docs, target, 25, 20)
    assert Counter(r[:4] for r in got) == Counter(r[:4] for r in rows)
    assert Counter((r[:4], r[4]) for r in got if r[4]) == drawn and sum(drawn.values()) > 20
    none = importance.resample(frame, spark.createDataFrame([], "text string"), 0)
    assert none.count() == len(docs) and none.where("rank IS NOT NULL").count() == 0


def test_pieces_cover_a_long_text():
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c", "éé", "Zz9"]) + rng.choice([" ", ".", " - ", "\n"]) for _ in range(3000)).encode()
    want = Counter(importance.buckets([text])[0].tolist())
    got = Counter()
    for piece, own in importance.pieces(text, 100):
        got.update(importance.buckets([piece], own=np.array([own]))[0].tolist())
    assert got == want
