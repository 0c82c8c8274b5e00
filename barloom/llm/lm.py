"""LM scoring with a probabilistic suffix tree, beside a unigram baseline.

The tree's symbols are the bytes of a text's lower-cased words, joined by one space and closed by an end symbol. Counts
of all substrings of `order + 1` bytes are gathered over the whole training corpus and rolled up to every shorter
context. A context of up to `order` bytes is retained if it makes up a share of `p_min` of all positions at least and if
its next-symbol distribution diverges from its parent's (the context without its farthest byte) by `divergence` nats or
more. Distributions are smoothed with the parent's in proportion to the number of different next symbols. Retained
contexts, with what closes them under dropping either end, are the states of an automaton that is always in the
longest suffix of what it has read; texts are scored by it, in blocks that begin with the `order` bytes before them.

There are `order / p_min` retained contexts at most whatever the corpus, which bounds what is collected and broadcast.

The baseline needs the corpus count of every word of every text. Tasks turn about 3 MB of text into one row of hashed
words and (word, text, times) entries; the distinct words of each row are counted and looked up by joins, so a common
word is one row for each 3 MB of text, and texts are never shuffled.

Defined results: a null or empty text is the end token alone. Every row is scored, also one without doc_id (its fold is
null; it is not learned from and held_out is null).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .frames import saved
from .vec import run_starts

TASK_BYTES = 1 << 20
ROW_BYTES = 3 << 20
END = 10
SCORE_BLOCK = 4096
END_WORD = vec.U64(0x7E3D5A1F9C2B4866)
COUNTED = 3 << 19  # distinct substrings a task holds before it passes them on


def stream_of(words: vec.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts joined by a space, each text closed by END; and where each text begins (one more than texts)."""
    kept = np.zeros(len(words.buf) + 1, np.int32)
    np.add.at(kept, words.starts, 1)
    np.add.at(kept, words.ends, -1)
    keep = np.cumsum(kept[:-1]) > 0
    out = words.buf.copy()
    keep[words.ends] = True  # the byte behind each word: a space, or END behind the last
    out[words.ends] = 32
    last = words.offsets[1:] - 1
    some = words.counts > 0
    close = np.where(some, words.ends[np.maximum(words.first[1:] - 1, 0)] if len(words.ends) else last, last)
    keep[close] = True
    out[close] = END
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], place[np.concatenate([[0], close + 1])]


def grams(stream: np.ndarray, order: int) -> np.ndarray:
    """Code of each symbol with up to `order` before it, the nearest in the second lowest byte; none from behind END."""
    n = len(stream)
    padded = np.concatenate([np.zeros(order, np.int64), stream.astype(np.int64)])
    padded[order - 1] = END
    code = padded[order:].copy()
    gone = np.zeros(n, bool)
    for j in range(1, order + 1):
        symbol = padded[order - j : order - j + n]
        code |= np.where(gone, 0, symbol) << (8 * j)
        gone |= (symbol == END) | (symbol == 0)
    return code


def gram_counts(order: int):
    def run(batches):
        codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        held = 0

        def merged():
            all_codes, all_counts = np.concatenate(codes), np.concatenate(counts)
            rows = np.argsort(all_codes)
            first = run_starts(all_codes[rows])
            return all_codes[rows][first], np.add.reduceat(all_counts[rows], first) if len(first) else all_counts

        for batch in batches:
            for _, _, texts in vec.parts(batch.column(0), TASK_BYTES):
                code, n = np.unique(grams(stream_of(vec.Words(texts, lower=True))[0], order), return_counts=True)
                codes.append(code)
                counts.append(n)
                held += len(code)
                if held > COUNTED:
                    code, n = merged()
                    if len(code) > COUNTED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                        code, n = code[:0], n[:0]
                    codes, counts, held = [code], [n], len(code)
        code, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return run


class Tree:
    """The suffix automaton of retained contexts: next state and log10 probability by state and symbol class."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], order: int):
        """rows: of each depth the contexts, next symbols and counts."""
        seen = np.unique(np.concatenate([s for _, s, _ in rows] + [np.array([END])]))
        self.order = order
        self.classes = np.zeros(256, np.int32)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        contexts = [np.unique(c) for c, _, _ in rows]
        if not len(contexts[0]):
            contexts[0] = np.zeros(1, np.int64)
        base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        p = np.zeros((base[-1], width))
        for d, (c, s, n) in enumerate(rows):
            at = np.searchsorted(contexts[d], c)
            counts = np.zeros((len(contexts[d]), width))
            counts[at, self.classes[s]] = n
            if d == 0:
                p[:1] = (counts + 1 / 256) / (counts.sum() + 1)  # all 256 symbols, class 0 is each unseen one
            elif len(contexts[d]):
                parent = base[d - 1] + np.searchsorted(contexts[d - 1], contexts[d] & ((1 << 8 * (d - 1)) - 1))
                kinds = (counts > 0).sum(axis=1, keepdims=True)
                p[base[d] : base[d + 1]] = (counts + kinds * p[parent]) / (counts.sum(axis=1, keepdims=True) + kinds)
        self.log_p = np.log10(p).astype(np.float32).ravel()
        self.next = np.zeros((base[-1], width), np.int32)
        for d, context in enumerate(contexts):
            if not len(context):
                continue
            to = np.zeros((len(context), width), np.int64)
            found = np.zeros((len(context), width), bool)
            new = (context[:, None] << 8) | np.concatenate([[0], seen])[None, :]
            for k in range(min(d + 1, order), 0, -1):
                if not len(contexts[k]):
                    continue
                key = new & ((1 << 8 * k) - 1)
                at = np.minimum(np.searchsorted(contexts[k], key), len(contexts[k]) - 1)
                hit = ~found & (contexts[k][at] == key)
                hit[:, 0] = False
                to[hit] = base[k] + at[hit]
                found |= hit
            self.next[base[d] : base[d + 1]] = to
        self.width = width
        self.next = (self.next * width).ravel()
        self.n_states = int(base[-1])

    def scores(self, stream: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a stream."""
        symbols = self.classes[stream]
        sizes = np.diff(first)
        blocks = -(-sizes // SCORE_BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[:-1][owner] + inner * SCORE_BLOCK
        length = np.minimum(sizes[owner] - inner * SCORE_BLOCK, SCORE_BLOCK)
        rows = np.argsort(-length, kind="stable")
        owner, inner, begin, length = owner[rows], inner[rows], begin[rows], length[rows]
        state = np.full(len(owner), self.next[self.classes[END]], np.int32)
        later = np.flatnonzero(inner)
        if len(later):
            warm = np.zeros(len(later), np.int32)
            for t in range(-self.order, 0):
                warm = self.next[warm + symbols[begin[later] + t]]
            state[later] = warm
        total = np.zeros(len(owner))
        active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
        for t, n in enumerate(active.tolist()):
            at = state[:n] + symbols[begin[:n] + t]
            total[:n] += self.log_p[at]
            state[:n] = self.next[at]
        return np.bincount(owner, total, len(sizes))


def grow(texts: DataFrame, order: int, p_min: float, divergence: float) -> Tree:
    """The tree of column text of all rows."""
    counts = [None] * (order + 1)
    counts[order] = saved(texts.mapInArrow(gram_counts(order), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    for d in range(order - 1, -1, -1):
        counts[d] = counts[d + 1].groupBy(F.col("code").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("code")).agg(F.sum("n").alias("n"))
        counts[d] = saved(counts[d])
    total = counts[0].agg(F.sum("n")).first()[0] or 0
    split = [c.select(F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND(255).alias("symbol"), "n") for c in counts]
    sums = [c.groupBy("context").agg(F.sum("n").alias("all")) for c in split]
    kept: list[DataFrame | None] = [None] * (order + 1)
    for d in range(1, order + 1):
        own = split[d].where(F.col("context") >= 1 << 8 * (d - 1)).join(sums[d].where(F.col("all") >= p_min * total), "context")  # a context that reaches behind the end symbol is none
        own = own.withColumn("parent", F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1))
        up = split[d - 1].join(sums[d - 1], "context").select(F.col("context").alias("parent"), "symbol", (F.col("n") / F.col("all")).alias("q"))
        share = F.col("n") / F.col("all")
        kept[d] = own.join(up, ["parent", "symbol"]).groupBy("context").agg(F.sum(share * F.log(share / F.col("q"))).alias("kl")).where(F.col("kl") >= divergence).select("context")
    for d in range(order, 1, -1):  # closed under dropping the farthest and the nearest byte
        kept[d] = saved(kept[d])
        kept[d - 1] = reduce(DataFrame.union, [kept[d - 1], kept[d].select(F.col("context").bitwiseAND((1 << 8 * (d - 1)) - 1)), kept[d].select(F.shiftright("context", 8))]).distinct()
    rows = []
    for d in range(order + 1):
        chosen = split[d].join(kept[d], "context", "left_semi") if d else split[0]
        got = chosen.select("context", "symbol", "n").toArrow()  # order / p_min contexts at most
        rows.append(tuple(got.column(c).to_numpy() for c in ("context", "symbol", "n")))
    return Tree(rows, order)


ROWS = "row long, ids binary, train binary, sizes binary, scores binary, words array<long>, counts array<long>, entries binary"


def scored_rows(shared):
    """About 3 MB of text a row: scores of the texts, distinct hashed words, and (word, text, times) entries."""
    from pyspark import TaskContext

    def run(batches):
        tree, made = shared.value, 0
        parts: list[tuple] = []
        size = base = 0

        def row():
            ids, train, sizes, scores, h, text, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, text, times = h[order], text[order], times[order]
            first = run_starts(h)
            learned = np.add.reduceat(times * train[text], first) if len(first) else np.zeros(0, np.int64)
            word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h)))).astype(np.int32)
            entries = b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(word, prepend=0), text, times))
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() << 32 | made]), one(ids), one(train), one(sizes), one(scores), vec.lists(h[first].view(np.int64), np.array([0, len(first)]), pa.int64()), vec.lists(learned, np.array([0, len(first)]), pa.int64()), pa.array([entries], pa.binary())],
                [x.split()[0] for x in ROWS.split(", ")],
            )

        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            fold = np.array([-1 if x is None else int(x) for x in batch.column(2).to_pylist()], np.int8)
            for i, j, texts in vec.parts(batch.column(1), TASK_BYTES):
                words = vec.Words(texts, lower=True)
                h = np.concatenate([words.hashes(), np.full(j - i, END_WORD)])
                text = np.concatenate([words.text_of(), np.arange(j - i, dtype=np.int32)])
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                first = run_starts(text, h)
                parts.append((ids[i:j], fold[i:j] == 1, words.counts + 1, tree.scores(*stream_of(words)), h[first], text[first] + base, np.diff(np.append(first, len(h)))))
                base += j - i
                size += len(words.buf)
                if size >= ROW_BYTES:
                    yield row()
                    made += 1
                    parts.clear()
                    size = base = 0
        if parts:
            yield row()

    return run


def base_sums(n_train: int, n_words: int):
    bottom = np.log10(n_train + 0.1 * (n_words + 1))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, _, sizes, scores, entries = (batch.column(c)[i].as_buffer() for c in range(1, 6))
                ids, sizes, scores = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(scores)
                planes = np.frombuffer(entries, np.uint8).reshape(3, 4, -1)
                gap, text, times = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes)
                found = batch.column(6)[i].values
                count = np.zeros(len(found), np.int64)
                count[found.field(0).to_numpy()] = found.field(1).to_numpy()
                c = count[np.cumsum(gap, dtype=np.int64)]
                top = np.bincount(text, times * np.log10(c + 0.1), len(ids))
                known = np.bincount(text, times * (c > 0), len(ids)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == -(2**63)), pa.array(sizes), pa.array(known), pa.array(top - sizes * bottom), pa.array(scores)],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, learn: Column, order: int = 5, p_min: float = 5e-6, divergence: float = 0.02) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text); learn: boolean, which rows to learn from."""
    tree = grow(docs.where(learn).select("text"), order, p_min, divergence)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    rows = saved(docs.select("doc_id", "text", learn.alias("learn")).mapInArrow(scored_rows(shared), ROWS))
    asked = rows.select("row", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("row", "at", "w.words", "w.counts")
    counts = saved(asked.groupBy("words").agg(F.sum("counts").alias("c")))
    n_train, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    told = asked.select("row", "at", "words").join(counts, "words").groupBy("row").agg(F.collect_list(F.struct("at", "c")).alias("found"))
    out = rows.select("row", "ids", "train", "sizes", "scores", "entries").join(told, "row").mapInArrow(base_sums(n_train, n_words), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_train).cast("long"))


def op5_suffix_tree_score(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    found = score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold != 0)
    return found.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
