"""Language identification by cross-parsing.

For every language a bounded sample of labelled text becomes a suffix automaton, which knows all its substrings. A text
is parsed against each automaton: the longest match from here is a phrase, the next one begins behind it. Few phrases
mean that the language's own text has long pieces of this one; the language with the fewest phrases, normalised by the
logarithm of its sample's length, wins. Texts are parsed in blocks of BLOCK bytes, all blocks of a batch at once.

The sample is `sample_docs` documents of each language with the smallest hashed ids, and of each `passages` passages of
`passage_chars` characters that begin at even distances from the first to the last part of the whole text; shorter texts
count whole. That bounds what the driver holds and what is broadcast (about 70 bytes of table for a byte of sample and
language; labels are taken to be a dimension, and more than `most_langs` of them are an error). Prediction reads whole
texts and nothing but texts.

Defined results: a null text, one without letters, or any text when no language was learned is `und` with score 0.
Equal costs go to the language that sorts first; rows that repeat a text have the same result, and repeated labelled rows
count once each. Texts of any length count whole, in blocks. An empty table learns nothing and gives no rows. Columns of
the input other than text pass through; lang_pred, score and phrases_per_byte must not be among them. Score: 1 - fewest / second fewest phrases, 1 if one language is known.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vec

BLOCK = 4096
TASK_BYTES = 4 << 20
#: Letters lower-cased; other ASCII is space; other bytes stay, Latin capitals in two bytes are lowered in `normal`.
TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def normal(buf: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    out = table[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    after = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    out[after] += 0x20
    return out


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


class Model:
    """Languages, and one table of all automata: row offsets of states, 0 where a match ends."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        texts = [normal(np.frombuffer(samples[x], np.uint8)) if samples[x] else np.zeros(0, np.uint8) for x in self.langs]
        seen = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint8)
        self.classes = np.zeros(256, np.uint8 if len(seen) < 256 else np.uint16)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        machines = [automaton(self.classes[t].tolist()) for t in texts]
        rows = 1 + sum(map(len, machines))  # row 0 stands for no state
        self.table = np.zeros(rows * width, np.int32 if rows * width < 2**31 else np.int64)
        self.start = np.zeros(len(self.langs), self.table.dtype)
        at = 1
        for i, machine in enumerate(machines):
            self.start[i] = at * width
            for s, following in enumerate(machine):
                for c, to in following.items():
                    self.table[(at + s) * width + c] = (at + to) * width
            at += len(machine)
        self.weight = np.array([math.log2(max(len(t), 2)) for t in texts])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(languages, texts) numbers of phrases."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        total = np.zeros((len(self.langs), len(texts)))
        if not sizes.sum():
            return total
        symbols = self.classes[normal(np.frombuffer(b"".join(texts), np.uint8))]
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = (np.cumsum(sizes) - sizes)[owner] + inner * BLOCK
        length = np.minimum(sizes[owner] - inner * BLOCK, BLOCK)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        start = np.repeat(self.start[:, None], len(owner), axis=1)
        state, misses = start.copy(), np.ones(start.shape, np.int32)
        for t, n in enumerate(active.tolist()):
            c = symbols[begin[:n] + t]
            new = self.table[state[:, :n] + c]
            miss = new == 0
            misses[:, :n] += miss
            fresh = self.table[self.start[:, None] + c]
            np.copyto(new, fresh, where=miss)
            np.copyto(new, start[:, :n], where=new == 0)
            state[:, :n] = new
        for i in range(len(self.langs)):
            total[i] = np.bincount(owner, misses[i], len(texts))
        return total


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def passages_of(text: Column, passages: int, chars: int) -> Column:
    """Passages from all over a text, a line each; the whole text where it is no longer than they are."""
    n = F.length(text)
    begins = [F.floor((n - chars) * (i / max(passages - 1, 1))).cast("int") + 1 for i in range(passages)]
    return F.when(n <= passages * chars, text).otherwise(F.concat_ws("\n", *(F.substring(text, b, F.lit(chars)) for b in begins)))


def sample(docs: DataFrame, learn: Column, sample_docs: int, passages: int, passage_chars: int, most_langs: int) -> dict[str, bytes]:
    """The bounded sample: text of each language, documents by hashed id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "digest")
    learned = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = learned.select("doc_id", "lang", F.xxhash64("text").alias("digest"), passages_of(F.col("text"), passages, passage_chars).alias("text")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    found: dict[str, list] = {}
    for r in rows.limit(sample_docs * most_langs + 1).collect():  # sample_docs rows a language at most
        found.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    if len(found) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    return {lang: "\n".join(t for _, t in sorted(x)).encode() for lang, x in found.items()}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and phrases_per_byte (normalised phrases of the winner for a byte of text) from column text alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    names = docs.columns
    at = names.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = vec.texts_of(batch.column(at))
            for i, j in vec.chunks(np.fromiter(map(len, texts), np.int64, len(texts)), TASK_BYTES):
                part = texts[i:j]
                langs, score, rate = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
                if m.langs:
                    cost = m.phrases(part) * m.weight[:, None]
                    best = cost.argmin(axis=0)
                    low = cost.min(axis=0)
                    second = np.partition(cost, 1, axis=0)[1] if len(m.langs) > 1 else np.full(len(part), np.inf)
                    known = np.fromiter(map(has_letter, part), bool, len(part))
                    langs = [m.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score = np.where(known & (second > 0), 1 - low / np.where(second > 0, second, 1), 0.0)
                    rate = low / np.maximum(np.fromiter(map(len, part), np.int64, len(part)), 1)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], [*names, "lang_pred", "score", "phrases_per_byte"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, phrases_per_byte double")


def train(docs: DataFrame, learn: Column, sample_docs: int = 120, passages: int = 4, passage_chars: int = 50, most_langs: int = 500) -> Model:
    """docs: doc_id, text, lang. learn: which rows may be learned from."""
    return Model(sample(docs, learn, sample_docs, passages, passage_chars, most_langs))


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"), fold(5) != 0)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")
