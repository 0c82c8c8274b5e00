"""Substring dedup with fixed-block anchors.

Reference blocks of `width // 2` words lie end to end in every document and form the index; every rolling window of as
many words probes it. A window of `width` words holds a whole block, so every repeat of `width` words makes a hit in
each document that has it. Hits are then extended: each window of `width` words around a hit is compared with the like
windows of all other documents by a 96-bit hash, and runs of repeated windows are the maximal exact repeats.

Rows of the exchanges are packed blocks of many hashes, dealt by hash bucket. The number of buckets follows the size of
the input. A window that is in many texts of a task is decided there and sent on once or twice, so a common hash makes
no large bucket, and no pair of documents is ever listed.

Defined results: a null or empty text has no words and loses none. Texts shorter than a window stay whole, texts of any
length count whole. Of equal texts the one with the smallest doc_id stays whole; rows that repeat a doc_id, with the same
text or another, never dedupe each other, and each is a row of the result. A row without doc_id stays whole and is not
compared. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .frames import buckets_for, id_and_text
from .vec import run_starts

TASK_BYTES = 2 << 20  # bytes of text hashed at once in a task
BLOCK_BYTES = 16 << 20  # bytes of text behind the packed blocks that a task gives at once
BUCKET_BYTES = 8 << 20  # bytes of text behind a bucket of all blocks


class Packer:
    """Collects hashes of a task's texts and gives packed blocks by bucket.

    settle(columns, doc, place) may say of a bucket's entries which are decided already and which others still need; what is
    decided goes to any bucket, so a hash that is in many texts is a few entries of each block, however many texts it is in.
    """

    def __init__(self, buckets: int, settle=None):
        self.buckets, self.settle = buckets, settle
        self.clear()

    def clear(self) -> None:
        self.size = self.base = 0
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.parts: dict[int, list[tuple]] = {}

    def add(self, h: np.ndarray, extra: list[np.ndarray], at: np.ndarray, ids: np.ndarray, counts: np.ndarray, size: int) -> None:
        """h deals entries to buckets; at is the place of each entry, counted over the batch's texts of `counts` places; ids are two for a text."""
        for b, rows in vec.by_bucket(vec.bucket_of(h, self.buckets), self.buckets):
            self.parts.setdefault(b, []).append((at[rows] + self.base, *(x[rows] for x in extra)))
        self.ids.append(ids)
        self.counts.append(counts)
        self.base += int(counts.sum())
        self.size += size

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            ids, counts = np.concatenate(self.ids), np.concatenate(self.counts)
            first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            out: list[tuple[int, bool, bytes]] = []
            for b, parts in self.parts.items():
                at, *extra = (np.concatenate(x) for x in zip(*parts, strict=True))
                if self.settle:
                    text = np.searchsorted(first, at, side="right") - 1
                    done, send = self.settle(extra, ids[text, 0], at - first[text])
                    if done.any():
                        out.append((int(vec.bucket_of(vec.mix(ids[text[done][:1]].sum(axis=1).view(np.uint64)) + vec.U64(b), self.buckets)[0]), True, vec.pack([], at[done], first, ids)))
                    at, extra = at[send], [x[send] for x in extra]
                if len(at):
                    out.append((b, False, vec.pack(extra, at, first, ids)))
            for b, done, block in out:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([done]), pa.array([block], pa.binary())], ["bucket", "done", "block"])
        self.clear()


PACKED = "bucket int, done boolean, block binary"


class Gathered:
    """All entries of a bucket: columns, ids of the texts, and of each entry the text, its doc_id and the place; and those decided before."""

    def __init__(self, group: pa.Table, kinds: list):
        blocks = list(zip(group.column("done").to_pylist(), group.column("block"), strict=True))
        open_, self.done = ([vec.unpack(memoryview(x.as_buffer()), k) for d, x in blocks if d is done] for done, k in ((False, kinds), (True, [])))
        base = np.cumsum([0, *(len(p[1]) for p in open_)])
        empty = np.zeros(0, np.int32)
        self.columns = [np.concatenate([np.zeros(0, k), *(p[0][i] for p in open_)]) for i, k in enumerate(kinds)]
        self.ids = np.concatenate([np.zeros((0, 2), np.int64), *(p[1] for p in open_)])
        self.text = np.concatenate([empty, *(p[2] + np.int32(x) for p, x in zip(open_, base, strict=False))])
        self.place = np.concatenate([empty, *(p[3] for p in open_)])
        self.doc = self.ids[self.text, 0]

    def with_done(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (two each) and places of the kept entries and of all decided ones."""
        return np.concatenate([self.ids[self.text[keep]], *(p[1][p[2]] for p in self.done)]), np.concatenate([self.place[keep], *(p[3] for p in self.done)])


def flat(ids: np.ndarray, places: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(ids[:, 0], pa.int64()), "digest": pa.array(ids[:, 1], pa.int64()), "place": pa.array(places, pa.int32())})


PLACE, SPAN = "doc_id long, digest long, place int", "doc_id long, digest long, first int, last int"


def spans_of(ids: np.ndarray, places: np.ndarray) -> pa.Table:
    """Runs of consecutive places of each text."""
    order = np.lexsort((places, ids[:, 1], ids[:, 0]))
    ids, places = ids[order], places[order]
    gap = np.ones(len(places), np.int64)
    gap[1:] = np.diff(places)
    first = np.flatnonzero((gap > 1) | np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])[: len(places)])
    last = np.append(first[1:], len(places)) - 1 if len(first) else first
    return pa.table({"doc_id": pa.array(ids[first, 0], pa.int64()), "digest": pa.array(ids[first, 1], pa.int64()), "first": pa.array(places[first], pa.int32()), "last": pa.array(places[last], pa.int32())})


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    """doc_id and digest of each row, the first and third column."""
    return np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)


def known_hit(half: int):
    """Of a block's windows: equal ones in two documents of which one is an indexed block are hits; one such block and a window of another document stand for them."""

    def settle(columns, doc, place):
        key = columns[0]
        done, send = np.zeros(len(key), bool), np.ones(len(key), bool)
        order = np.lexsort((doc, key))
        first = run_starts(key[order])
        if len(first):
            last = np.append(first[1:], len(key)) - 1
            low, high = order[first], order[last]
            aligned = np.minimum.reduceat(np.where(place[order] % half == 0, np.arange(len(key)), len(key)), first)
            good = (last - first >= 3) & (doc[low] != doc[high]) & (aligned < len(key))
            done[order] = np.repeat(good, last - first + 1)
            send = ~done
            block, low, high = order[aligned[good]], low[good], high[good]
            send[block] = True
            send[np.where(doc[low] != doc[block], low, high)] = True
        return done, send

    return settle


def known_repeat(columns, doc, place):
    """Windows that a smaller document of the same block has."""
    h, g = columns
    order = np.lexsort((g, h))
    first = run_starts(h[order], g[order])
    done = np.zeros(len(h), bool)
    if len(first):
        done[order] = doc[order] > np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(h))))
    return done, ~done


def probes(width: int, buckets: int):
    """Every rolling window of half the width, from whole texts."""
    half = width // 2

    def run(batches):
        out = Packer(buckets, known_hit(half))
        for batch in batches:
            ids = ids_of(batch)
            for i, j, texts in vec.parts(batch.column(1), TASK_BYTES):
                words = vec.Words(texts)
                at = words.inside(half)
                h = vec.windows(words.hashes(), half)[at]
                out.add(h, [(h >> vec.U64(32)).astype(np.uint32)], at, ids[i:j], words.counts, len(words.buf))
                if out.size >= BLOCK_BYTES:
                    yield from out.flush()
        yield from out.flush()

    return run


def hits(half: int):
    """Windows that equal an indexed block and are found in two documents at least."""

    def run(group: pa.Table) -> pa.Table:
        found = Gathered(group, [np.uint32])
        key = found.columns[0]
        order = np.argsort(key)
        first = run_starts(key[order])
        if not len(first):
            return flat(*found.with_done(order))
        doc = found.doc[order]
        good = np.logical_or.reduceat(found.place[order] % half == 0, first) & (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
        return flat(*found.with_done(order[np.repeat(good, np.diff(np.append(first, len(key))))]))

    return run


def extended(width: int, buckets: int):
    """All windows of the whole width that hold a hit, dealt by the least hit they hold: equal windows hold the same hits."""
    half = width // 2

    def run(batches):
        out = Packer(buckets, known_repeat)
        for batch in batches:
            ids, found = ids_of(batch), batch.column(3)
            for i, j, texts in vec.parts(batch.column(1), TASK_BYTES):
                words = vec.Words(texts)
                part = found.slice(i, j - i)
                at = part.flatten().to_numpy(zero_copy_only=False) + np.repeat(words.first[:-1], np.diff(part.offsets.to_numpy()))
                hashes = words.hashes()
                inside = words.inside(width)
                hit = np.full(len(words), vec.NEVER)
                hit[at] = vec.mix(vec.windows(hashes, half)[at])
                least = vec.sliding_min(hit, width - half + 1)[inside]
                near, least = inside[least < vec.NEVER], least[least < vec.NEVER]
                h, g = vec.windows(hashes, width)[near], vec.windows(hashes, width, 1)[near]
                out.add(vec.mix(least), [h, (g >> vec.U64(32)).astype(np.uint32)], near, ids[i:j], words.counts, len(words.buf))
                if out.size >= BLOCK_BYTES:
                    yield from out.flush()
        yield from out.flush()

    return run


def repeats(group: pa.Table) -> pa.Table:
    """Runs of windows whose words also start in a document with a smaller id."""
    found = Gathered(group, [np.uint64, np.uint32])
    h, g = found.columns
    order = np.lexsort((g, h))
    first = run_starts(h[order], g[order])
    if len(first):
        least = np.repeat(np.minimum.reduceat(found.doc[order], first), np.diff(np.append(first, len(h))))
        order = order[found.doc[order] > least]
    return spans_of(*found.with_done(order))


def kept(width: int, with_text: bool):
    """What is left of each text, and the spans of removed words."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, starts in zip(vec.texts_of(batch.column(1)), batch.column(3), strict=True):
                words = text.split()
                spans: list[list[int]] = []
                gone = 0
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, starts.values.field(0).to_numpy(), 1)
                    np.add.at(edge, starts.values.field(1).to_numpy() + width, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8)))
                    spans = edges.reshape(-1, 2).tolist()
                    left = b" ".join(compress(words, stay.tolist()))
                else:
                    left = b" ".join(words)
                rows.append((len(words), gone, left.decode("utf-8", "replace") if with_text else None, hashlib.sha256(left).hexdigest(), spans))
            n, gone, left, digest, spans = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"],
            )

    return run


def collected(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each text of a document with all its places or spans; as many as it has words or bytes at most."""
    return df.groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*columns) if columns[1:] else columns[0]).alias("places"))


def known_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text) with an id and a digest, which tells texts apart where an id repeats; and the others with no places. Both joins
    then read one shuffle of the texts, which Spark reuses. Where no id repeats the digest is 0, so that the exchanges need not carry it."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    docs = docs.withColumn("digest", F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text"))
    return docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL").withColumn("places", F.lit(None).cast("array<struct<first:int,last:int>>"))


def substring_dedup(docs: DataFrame, width: int = 50, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null without with_text), kept_sha256, spans ([first, end) word numbers removed) of each document.

    A word goes if a window of `width` words over it also starts in a document with a smaller id.
    """
    if width < 2:
        raise ValueError("width must be 2 words at least")
    docs = id_and_text(docs, doc_id, text)
    buckets = buckets_for(docs, "text", BUCKET_BYTES)
    docs, unknown = known_ids(docs)
    key = ["doc_id", "digest"]
    index = docs.mapInArrow(probes(width, buckets), PACKED)
    found = collected(index.groupBy("bucket").applyInArrow(hits(width // 2), PLACE), "place")
    windows = docs.join(found, key).select("doc_id", "text", "digest", "places").mapInArrow(extended(width, buckets), PACKED)
    starts = collected(windows.groupBy("bucket").applyInArrow(repeats, SPAN), "first", "last")
    rows = docs.join(starts, key, "left").select("doc_id", "text", "digest", "places").union(unknown.select("doc_id", "text", "digest", "places"))
    return rows.mapInArrow(kept(width, with_text), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, spans array<array<int>>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_spans"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) t),
early AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
bad AS (SELECT doc_id, i FROM win JOIN early USING (h) WHERE doc_id > first),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
m AS (SELECT t.doc_id, t.i, word, count(bad.i) OVER (PARTITION BY t.doc_id ORDER BY t.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM t LEFT JOIN bad ON bad.doc_id = t.doc_id AND bad.i = t.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM m),
g AS (SELECT doc_id, count(*) AS n_words, count(CASE WHEN gone THEN 1 END) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(CASE WHEN begins THEN 1 END) AS n_spans FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
