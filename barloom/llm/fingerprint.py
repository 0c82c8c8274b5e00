"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its words (weight: how often the word stands in it). For each of `samples` samples
and each word, gamma variates r, c and a uniform b, all made from a hash of word and sample, give t = floor(ln w / r + b)
and ln a = ln c - r (t - b) - r; the word with the least a, with its t, is the sample. Two documents agree on a sample
with a probability equal to the generalised Jaccard similarity of their weighted sets. A fingerprint is 16 bits of each
sample in hex, so equal texts have equal fingerprints and the share of equal samples estimates the similarity.

Only the distinct (word, weight) pairs of a batch are sampled; documents look their values up.

Defined results: a null or empty text, or one of white space, has the fingerprint "". Two such fingerprints are alike
(1.0), one such and another are not (0.0). Samples of equal rank go to the smaller name, so ties fall alike everywhere. Texts
of any length count whole. Repeated rows are rows of their own with equal fingerprints. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .frames import id_and_text
from .vec import run_starts

TASK_BYTES = 2 << 20
RANGE_BYTES = 32 << 20
_SEEDS = np.random.default_rng(10).integers(1, 2**63, (4096, 5), dtype=np.uint64) | vec.U64(1)


def sampled(texts: list[bytes], samples: int) -> np.ndarray:
    """(texts, samples) array of 16-bit samples; texts without words are zero and to be told apart by the caller."""
    words = vec.Words(texts)
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(words):
        return out
    h, text = words.hashes(), words.text_of()
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    first = run_starts(text, h)
    weight = np.diff(np.append(first, len(h)))
    h, text = h[first], text[first]
    pairs, inverse = np.unique(vec.mix(h) ^ weight.astype(np.uint64) * vec.U64(0x9E3779B97F4A7C15), return_inverse=True)
    one = np.zeros(len(pairs), np.int64)
    one[inverse] = np.arange(len(h))
    term, log_w = h[one], np.log(weight[one])
    at = run_starts(text)
    rows = text[at]
    for k in range(samples):
        u = [((vec.mix(term * _SEEDS[k, i] + vec.U64(i)) >> vec.U64(11)).astype(np.float64) + 0.5) / 2.0**53 for i in range(5)]
        r, log_c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
        t = np.floor(log_w / r + u[4])
        log_a = (log_c - r * (t - u[4]) - r).astype(np.float32)
        bits = log_a.view(np.uint32)
        rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # order of floats as integers
        name = vec.mix(term ^ (t.astype(np.int64).view(np.uint64) + vec.U64(k)) * vec.U64(0xD1342543DE82EF95)) >> vec.U64(32)
        out[rows, k] = (np.minimum.reduceat((rank << vec.U64(32) | name)[inverse], at) & vec.U64(0xFFFF)).astype(np.uint16)
    return out


def hexed(values: np.ndarray, some: np.ndarray) -> list[str]:
    return [v.astype(">u2").tobytes().hex() if s else "" for v, s in zip(values, some.tolist(), strict=True)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    return np.where(a_some & b_some, (a == b).mean(axis=1), (a_some == b_some).astype(float))


def fingerprints(docs: DataFrame, samples: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches):
        for batch in batches:
            texts = vec.texts_of(batch.column(1))
            for i, j in vec.chunks(np.fromiter(map(len, texts), np.int64, len(texts)), TASK_BYTES):
                some = np.array([bool(x.split(None, 1)) for x in texts[i:j]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(hexed(sampled(texts[i:j], samples), some), pa.string())], ["doc_id", "fingerprint"])

    return id_and_text(docs, doc_id, text).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of text replaced by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def robustness(docs: DataFrame, samples: int = 64, partitions: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited form, and how alike it is to that and to the next document's.

    The next document is the one with the next smaller doc_id, after the smallest the largest. Rows without doc_id count
    as the smallest, rows with the same doc_id follow each other by text. Texts are dealt once, by ranges of doc_id that hold
    about as many bytes each, RANGE_BYTES at most but for one document's; the first row of every range is sent to the
    range before it as well.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, doc_id, text)
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = partitions or max(1, min(rows // 8, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // RANGE_BYTES))))
    ends = even_ends(docs.select(key.alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")), n)

    def part_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, ids, side="left")

    tops = docs.select(key.alias("k")).mapInArrow(lambda batches: largest(batches, part_of), "part int, k long").groupBy("part").agg(F.max("k").alias("k")).collect()  # a row for each range
    tops = sorted((r["part"], r["k"]) for r in tops)
    # the row that begins range p follows the last row of the next larger range that has rows; of the largest, of the smallest
    sent = {k: tops[(i + 1) % len(tops)][0] for i, (_, k) in enumerate(tops)}

    def dealt(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63)).to_numpy()
            copies = np.flatnonzero(np.isin(ids, np.fromiter(sent, np.int64, len(sent))))
            rows = batch.take(pa.array(copies))
            names = ["part", "copy", "k", "doc_id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(ids).astype(np.int32)), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), batch.column(0), batch.column(1)], names)
            yield pa.RecordBatch.from_arrays([pa.array([sent[int(ids[i])] for i in copies], pa.int32()), pa.array(np.ones(len(copies), np.int32)), pa.array(ids[copies]), rows.column(0), rows.column(1)], names)

    def follow(batches):
        last = None  # the row whose next one is yet to come
        copied = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text")]
            rows = list(zip(*columns, strict=True))
            for i, j in vec.chunks(np.fromiter((len(x[3] or "") for x in rows), np.int64, len(rows)), TASK_BYTES):
                whole = ([last] if last else []) + rows[i:j]
                pairs = []
                for a, b in zip(whole[:-1], whole[1:], strict=True):
                    if a[1]:
                        continue  # a copy closes its range
                    if a[0] == b[0] and not (b[1] and b[0] == copied):
                        pairs.append((a, b))
                    if b[1]:
                        copied = b[0]
                if pairs:
                    yield compared(pairs, samples)
                last = whole[-1]

    parts = docs.mapInArrow(dealt, "part int, copy int, k long, doc_id long, text string").repartitionById(max(n, 1), F.col("part")).sortWithinPartitions("part", "copy", F.desc("k"), "text")
    return parts.mapInArrow(follow, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def even_ends(sizes: DataFrame, n: int) -> np.ndarray:
    """Up to n - 1 last keys of ranges (k, size) that hold about as many bytes each: fine ranges of equally many rows, put together by their bytes."""
    if n < 2:
        return np.zeros(0, np.int64)
    fine = 8 * n
    cuts = np.unique(np.array(sizes.agg(F.percentile_approx("k", [i / fine for i in range(1, fine)], 10 * fine).alias("b")).first()["b"] or [], np.int64))

    def summed(batches):
        for batch in batches:
            part = np.searchsorted(cuts, batch.column(0).to_numpy(), side="left")
            total = np.bincount(part, batch.column(1).to_numpy(), len(cuts) + 1)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["part", "size"])

    total = np.zeros(len(cuts) + 1)
    for r in sizes.mapInArrow(summed, "part long, size double").groupBy("part").agg(F.sum("size").alias("size")).collect():  # 8 rows for each range
        total[r["part"]] = r["size"]
    upto = np.cumsum(total)[:-1]
    goal = np.floor(upto / max(total.sum(), 1) * n)
    return cuts[np.flatnonzero(np.diff(goal, prepend=0) > 0)]


def largest(batches, part_of):
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if len(ids):
            parts = part_of(ids)
            order = np.lexsort((ids, parts))
            last = np.append(np.flatnonzero(np.diff(parts[order])), len(ids) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(parts[order][last].astype(np.int32)), pa.array(ids[order][last])], ["part", "k"])


def compared(pairs: list[tuple], samples: int) -> pa.RecordBatch:
    texts = [(a[3] or "") for a, _ in pairs]
    new = [edited(x, b[3] or "") for x, (_, b) in zip(texts, pairs, strict=True)]
    following = [(b[3] or "").encode() for _, b in pairs]
    mine, theirs = [x.encode() for x in texts], [x.encode() for x in new]
    known: dict[bytes, int] = {}
    for x in (*mine, *theirs, *following):
        known.setdefault(x, len(known))
    unique = list(known)
    values = np.concatenate([sampled(unique[i:j], samples) for i, j in vec.chunks(np.fromiter(map(len, unique), np.int64, len(unique)), 3 * TASK_BYTES)])
    some = np.array([bool(x.split(None, 1)) for x in unique])
    a, e, f = (np.fromiter((known[x] for x in xs), np.int64, len(xs)) for xs in (mine, theirs, following))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[2] for x, _ in pairs], pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in theirs]),
            pa.array(hexed(values[a], some[a]), pa.string()),
            pa.array(hexed(values[e], some[e]), pa.string()),
            pa.array(likeness(values[a], some[a], values[e], some[e])),
            pa.array(likeness(values[a], some[a], values[f], some[f])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    return robustness(table(spark, sf_dir, "documents"))
