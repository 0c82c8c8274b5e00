"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters, lower-cased. Every item's n-grams are counted over all
documents; an item's rare ones are those in at most COMMON times as many documents as the median of those that occur. A
document that holds one is aligned with the item around it: words that match score 1, others and gaps -1, and the best
local alignment over the item's number of words is the score. Copies score 1; each replaced word costs 2 / n, each lost
word 1 / n, each inserted one 1 / n. A place with common n-grams alone is aligned too, unless it has too few of the item's
words for the least score: rarity spares alignments and loses no pair. Around a seed all is looked at that an alignment
with the least score can reach. A copy without one whole n-gram of its item is not found.

The benchmark is taken in blocks of about BLOCK_BYTES, each of which is small enough to send to every task; a larger
benchmark is more passes over the documents. Documents are never shuffled.

Defined results: items with fewer words than a seed have no seeds and match nothing; null or empty texts match nothing.
Repeated rows of documents are each reported, repeated rows of the benchmark once. A row for each document and item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .langid import normal
from .vec import run_starts

TASK_BYTES = 2 << 20
BLOCK_BYTES = 16 << 20
COMMON = 10
CELLS = 4 << 20  # cells of alignment rows held at once
_WORD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)], np.uint8)


def words_of(texts: list[bytes]) -> vec.Words:
    return vec.Words(texts, change=lambda b: normal(b, _WORD))


class Sieve:
    """Which of many hashes are in a small set: a table of marks first, the sorted set for what passes."""

    def __init__(self, members: np.ndarray):
        self.members = np.unique(members)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.members & vec.U64(0xFFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the members in h, and which member each is."""
        at = np.flatnonzero(self.marks[(h & vec.U64(0xFFFFF)).astype(np.int64)])
        if not len(at) or not len(self.members):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.minimum(np.searchsorted(self.members, h[at]), len(self.members) - 1)
        good = self.members[found] == h[at]
        return at[good], found[good]


class Items:
    """Words and n-grams of a block of the benchmark."""

    def __init__(self, ids: list[int], texts: list[bytes], n: int):
        words = words_of(texts)
        self.ids, self.n = np.array(ids, np.int64), n
        self.words, self.first, self.counts = words.hashes(), words.first, words.counts
        at = words.inside(n)
        self.grams, self.item = vec.windows(self.words, n)[at], words.text_of()[at]
        self.place = at - self.first[self.item]

    def seeds(self, gram: np.ndarray, frequency: np.ndarray) -> None:
        """Puts the n-grams in order and marks as rare each item's up to COMMON times the median frequency of those that occur."""
        order = np.argsort(gram)
        gram, frequency = gram[order], frequency[order]
        often = np.zeros(len(self.grams))
        if len(gram):
            at = np.minimum(np.searchsorted(gram, self.grams), len(gram) - 1)
            often = np.where(gram[at] == self.grams, frequency[at], 0)
        rare = np.zeros(len(self.grams), bool)
        first = np.append(run_starts(self.item), len(self.item))
        for i, j in zip(first[:-1], first[1:], strict=True):
            here = often[i:j][often[i:j] > 0]
            rare[i:j] = often[i:j] <= COMMON * np.median(here) if len(here) else True
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.item, self.place, self.rare = self.grams[order], self.item[order], self.place[order], rare[order]
        self.sieve = Sieve(self.grams)
        self.from_ = np.searchsorted(self.grams, self.sieve.members)
        self.upto = np.searchsorted(self.grams, self.sieve.members, "right")
        own = of_item(self.words, np.repeat(np.arange(len(self.counts)), self.counts))
        self.vocabulary = Sieve(own)
        self.times = np.bincount(np.searchsorted(self.vocabulary.members, own), minlength=len(self.vocabulary.members))

    def most(self, h: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words the words [low, high) of h can match of their item at most, in any order."""
        out = np.zeros(len(item), np.int64)
        for i, j in vec.chunks(high - low, CELLS):
            width = high[i:j] - low[i:j]
            row = np.repeat(np.arange(j - i), width)
            at = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low[i:j], width)
            hit, word = self.vocabulary.places(of_item(h[at], item[i:j][row]))
            words = np.unique(row[hit] * len(self.times) + word)
            distinct = np.bincount(words // max(len(self.times), 1), weights=self.times[words % max(len(self.times), 1)], minlength=j - i)
            out[i:j] = np.minimum(np.bincount(row[hit], minlength=j - i), distinct)
        return out


def of_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hashes of words of an item, told apart from the same words of others."""
    return (words ^ (item.astype(np.uint64) * vec.U64(0x9E3779B97F4A7C15))) * vec.U64(0xD6E8FEB86659FD93)


def align(a: np.ndarray, n_a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row of a (its first n_a words) with the same row of b, and where in b it ends. 0 is no word of b."""
    rows, width = b.shape
    above, best, end = np.zeros((rows, width + 1), np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    step = np.arange(width + 1, dtype=np.int32)
    for i in range(a.shape[1]):
        here = np.maximum(above - 1, 0)
        here[:, 1:] = np.maximum(here[:, 1:], above[:, :-1] + np.where(a[:, i : i + 1] == b, 1, -1))
        here = np.maximum.accumulate(here + step, axis=1) - step  # gaps along b
        here[n_a <= i] = 0
        top = here.argmax(axis=1)
        value = here[np.arange(rows), top]
        end = np.where(value > best, top, end)
        best = np.maximum(best, value)
        above = here
    return best, end


def frequencies(shared, n: int):
    """How many documents hold each n-gram of the block: partial counts of a task."""

    def run(batches):
        sieve = shared.value
        count = np.zeros(len(sieve.members), np.int64)
        for batch in batches:
            texts = vec.texts_of(batch.column(1))
            for i, j in vec.chunks(np.fromiter(map(len, texts), np.int64, len(texts)), TASK_BYTES):
                words = words_of(texts[i:j])
                at, found = sieve.places(vec.windows(words.hashes(), n))
                text = words.text_of()
                inside = at + n <= words.first[text[at] + 1] if len(at) else np.zeros(0, bool)
                pairs = np.unique(text[at][inside].astype(np.int64) * len(count) + found[inside])
                count += np.bincount(pairs % max(len(count), 1), minlength=len(count))[: len(count)]
        yield pa.RecordBatch.from_arrays([pa.array(sieve.members.view(np.int64)), pa.array(count)], ["gram", "n"])

    return run


def aligned(shared, least: float):
    def run(batches):
        items = shared.value
        for batch in batches:
            texts, ids = vec.texts_of(batch.column(1)), batch.column(0)
            for i, j in vec.chunks(np.fromiter(map(len, texts), np.int64, len(texts)), TASK_BYTES):
                words = words_of(texts[i:j])
                h, text = words.hashes(), words.text_of()
                at, found = items.sieve.places(vec.windows(h, items.n))
                good = at + items.n <= words.first[text[at] + 1] if len(at) else np.zeros(0, bool)
                at, found = at[good], found[good]
                each = items.upto[found] - items.from_[found]
                hit = np.repeat(at, each)
                seed = np.repeat(items.from_[found] - np.cumsum(each) + each, each) + np.arange(each.sum())
                if not len(hit):
                    continue
                item, size = items.item[seed], items.counts[items.item[seed]]
                owner = text[hit]
                begin = hit - items.place[seed]  # where the item would begin
                order = np.lexsort((begin, item, owner))
                item, size, owner, begin = item[order], size[order], owner[order], begin[order]
                pad = np.ceil((1 - least) * size).astype(np.int64) + 1  # more inserted or lost words leave less than the least score
                new = np.ones(len(item), bool)  # seeds that place the item within half its length are one candidate
                new[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1]) | (begin[1:] - begin[:-1] > pad[1:])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(item)) - 1
                low = np.maximum(begin[first] - pad[first], words.first[owner[first]])
                high = np.minimum(begin[last] + size[last] + pad[last], words.first[owner[first] + 1])
                n_seeds = last - first + 1
                item, owner = item[first], owner[first]
                good = np.logical_or.reduceat(items.rare[seed[order]], first)
                common = np.flatnonzero(~good)
                good[common] = items.most(h, item[common], low[common], high[common]) >= least * items.counts[item[common]] - 1e-9
                yield scored(items, ids, i, words, h, item[good], owner[good], low[good], high[good], n_seeds[good], least)

    return run


def scored(items: Items, ids: pa.Array, base: int, words: vec.Words, h: np.ndarray, item, owner, low, high, n_seeds, least: float) -> pa.RecordBatch:
    size, width = items.counts[item], high - low
    score, end = np.zeros(len(item)), np.zeros(len(item), np.int64)
    order = np.lexsort((size, width))
    at = 0
    while at < len(order):  # candidates of like width together
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * int(width[order[stop]]) <= CELLS and stop - at < 4096:
            stop += 1
        rows = order[at:stop]
        w, m = int(width[rows].max()), int(size[rows].max())
        columns = low[rows, None] + np.arange(w)
        b = np.where(columns < high[rows, None], h[np.minimum(columns, len(h) - 1)], vec.U64(0))
        columns = items.first[item[rows], None] + np.arange(m)
        a = np.where(np.arange(m) < size[rows, None], items.words[np.minimum(columns, len(items.words) - 1)], vec.U64(1))
        best, where = align(a, size[rows], b)
        score[rows] = best / size[rows]
        end[rows] = low[rows] + where
        at = stop
    keep = np.flatnonzero(score >= least)
    keep = keep[np.lexsort((-score[keep], item[keep], owner[keep]))]
    keep = keep[run_starts(owner[keep], item[keep])]  # the best of a document and item
    text = owner[keep]
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(base + text)), pa.array(items.ids[item[keep]], pa.int64()), pa.array(score[keep]), pa.array(n_seeds[keep], pa.int64()), pa.array(size[keep], pa.int64()), pa.array(low[keep] - words.first[text], pa.int64()), pa.array(end[keep] - words.first[text], pa.int64())],
        ["doc_id", "item_id", "score", "n_seeds", "item_words", "from_word", "to_word"],
    )


FOUND = "item_id long, score double, n_seeds long, item_words long, from_word long, to_word long"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.4) -> DataFrame:
    """doc_id, item_id, score, n_seeds (of the best place), item_words, and the words [from_word, to_word) that were aligned or looked at, of each pair with a score of `least` or more.

    docs: doc_id (of any type), text. benchmark: item_id, text.
    """
    spark = docs.sparkSession
    docs, kind = docs.select("doc_id", "text"), dict(docs.dtypes)["doc_id"]
    benchmark = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about BLOCK_BYTES
        items = Items([r["item_id"] for r in rows], [r["text"].encode() for r in rows], n)
        sieve = spark.sparkContext.broadcast(Sieve(items.grams))
        often = docs.mapInArrow(frequencies(sieve, n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        items.seeds(often.column("gram").to_numpy().view(np.uint64), often.column("n").to_numpy())
        found = docs.mapInArrow(aligned(spark.sparkContext.broadcast(items), least), f"doc_id {kind}, {FOUND}")
        out = found if out is None else out.union(found)
    return out


def op1_contamination(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
