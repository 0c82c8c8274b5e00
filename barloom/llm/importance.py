"""Importance resampling towards a target distribution, by hashed counts of runs of words.

A text's features are all runs of 1 to 3 consecutive words; a feature's bucket is the checksum of its bytes modulo BUCKETS.
First pass: every partition counts its features into one vector with np.bincount, and treeReduce adds the vectors up, so the
driver gets a few vectors of fixed length. A bucket's gain is the logarithm of how much more frequent it is in the target
than in the documents. Second pass: the gains are broadcast (80 kB at any size) and np.bincount adds up those of each text. Noise
of a hash of the id makes the largest scores a sample without replacement in proportion to the weights.

Ranks: a bound below which no drawn score lies comes from an approximate quantile and is checked by a count; what is above it,
little more than what is drawn, is sorted in ranges, and a row's rank is its place in its range behind the rows of the ranges
before. Ranges are cut by score, id and place, so equal scores or ids are no hot key.

Checksums of all runs are made without a Python step for each word: a checksum of a run continues that of the run without its last
word, so all words of a batch are fed byte by byte at once. Texts are worked on in pieces of about PIECE bytes that
end between words; runs that cross the cut belong to the piece before.

Defined results: a null or empty text has no features and weight 0. Every row is a document; rows with the same id have the same
noise, equal scores go by id (nulls last), and rows equal in both are one as good as the other. A null id has the noise of an
empty id. An empty table gives no rows; without target texts all its counts are 0. Texts count whole, of any length; columns but those
named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .frames import saved, table, vector_sum

BUCKETS = 10_000
RUNS = 3
PIECE = 4 << 20
#: A longer word is fed by zlib, byte by byte of all words up to it.
LONG = 64
SORTED_ROWS = 1_000_000
_POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


TABLE = _table()
#: Bytes of words once A-Z are lower-cased: digits, letters, and all of characters beyond ASCII.
IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def feed(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Checksum registers after the bytes of a word each; order: the words by falling size."""
    out = state.copy()
    s, z = starts[order], sizes[order]
    r = out[order]
    long = int(np.searchsorted(-z, -LONG, side="left"))  # words of over LONG bytes come first
    for i in range(long):
        r[i] = zlib.crc32(buf[s[i] : s[i] + z[i]], int(r[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    r_, s_, z_ = r[long:], s[long:], z[long:]
    for j in range(int(z_[0]) if len(z_) else 0):
        m = int(np.searchsorted(-z_, -j, side="left"))  # words of over j bytes
        x = r_[:m]
        r_[:m] = TABLE[(x ^ buf[s_[:m] + j]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    out[order] = r
    return out


def buckets(texts: list[bytes], n_buckets: int = BUCKETS, runs: int = RUNS, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of the texts, the text that each is of, and the number of words of each text.

    own: how many bytes of a text its features must begin in; words from there on only end runs that begin before, and do not count.
    """
    buf = vec.LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    word = IS_WORD[buf]
    before = np.concatenate([[False], word[:-1]])
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    counted = starts < (offsets[:-1] + own)[text] if own is not None else np.ones(len(starts), bool)
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    found, of = [], []
    r = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for n in range(min(runs, len(starts))):  # r: registers before the last word of runs of n + 1 words that end at each word
        r = feed(r, buf, starts, sizes, order)
        whole = np.zeros(len(starts), bool)
        whole[n:] = (text[n:] == text[: len(text) - n]) & counted[: len(text) - n]
        found.append(((r[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(n_buckets)).astype(np.int32))
        of.append(text[whole])
        spaced = TABLE[(r ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (r >> np.uint32(8))
        r = np.roll(spaced, 1)
    none = np.zeros(0, np.int64)
    return np.concatenate(found) if found else none, np.concatenate(of) if of else none, np.bincount(text[counted], minlength=len(texts))


def pieces(text: bytes, most: int = PIECE, runs: int = RUNS) -> Iterator[tuple[bytes, int]]:
    """Pieces of a text, and how many bytes of each its features begin in; the rest are the words that end them."""
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut < len(text) and _joins(text, cut):
            cut += 1
        end = cut
        for _ in range(runs - 1):
            while end < len(text) and not _is_word(text[end]):
                end += 1
            while end < len(text) and _is_word(text[end]):
                end += 1
        yield text[at:end], cut - at
        at = cut
    yield text[at:], len(text) - at


def _is_word(byte: int) -> bool:
    return bool(IS_WORD[byte]) or 0x41 <= byte <= 0x5A


def _joins(text: bytes, cut: int) -> bool:
    return _is_word(text[cut - 1]) and _is_word(text[cut])


def _groups(column: pa.Array, runs: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts or pieces of them, the row that each is of, and the bytes that its features begin in."""
    for i, _, texts in vec.parts(column, PIECE):
        if len(texts) > 1:
            yield texts, np.arange(i, i + len(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
        else:
            for piece, own in pieces(texts[0], PIECE, runs):
                yield [piece], np.array([i]), np.array([own])


def counted(texts: DataFrame, n_buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """How often each bucket's features stand in a column text, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for group, _, own in _groups(batch.column(0), runs):
                sums += np.bincount(buckets(group, n_buckets, runs, own)[0], minlength=n_buckets)
        yield pa.record_batch({"sums": pa.array([sums.tobytes()], pa.binary())})

    return vector_sum(texts.select("text").mapInArrow(count, "sums binary"), n_buckets)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(how much more frequent a bucket is in the target)), each count raised by one."""
    n, total, goal = len(source), float(source.sum()), float(target.sum())
    ratio = ((target + 1.0) * (total + n)) / ((source + 1.0) * (goal + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features and weight of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            rows = batch.num_rows
            words, features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for group, row, own in _groups(batch.column("text"), runs):
                found, of, n_words = buckets(group, len(gain), runs, own)
                words[row] += n_words
                features[row] += np.bincount(of, minlength=len(group))
                weight[row] += np.bincount(of, weights=gain[found], minlength=len(group)).astype(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(weight)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, draw: int, candidates: int | None = None, each: int = SORTED_ROWS) -> DataFrame:
    """Adds rank to scored (doc_id, score, may; saved): 1, 2, ... of the `draw` largest scores of rows that may be drawn, NULL else.

    candidates: how many rows may be drawn, for the bound below which no row need be sorted.
    """
    spark, none = scored.sparkSession, F.lit(None).cast("long")
    if not draw:
        return scored.drop("may").withColumn("rank", none)
    share = max(0.0, 1 - draw / (candidates or draw) - 0.002)
    bound = scored.where("may").agg(F.percentile_approx("score", share, 10_000)).first()[0]
    above = F.col("may") & (F.col("score") >= F.lit(bound))
    n = scored.where(above).count()
    if n < draw:
        above, n = F.col("may"), candidates
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    near = scored.where(above).withColumn("place", F.monotonically_increasing_id())
    cut = saved(near.repartitionByRange(-(-n // each), *order, "place").sortWithinPartitions(*order, "place").drop("place", "may"))
    cut = cut.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = dict(cut.groupBy("range").count().collect())  # a row for each range of a million
    ahead, offsets = 0, []
    for r in range(max(sizes, default=0) + 1):
        offsets.append((r, ahead))
        ahead += sizes.get(r, 0)
    offsets = spark.createDataFrame(offsets, "range int, ahead long")
    placed = cut.join(F.broadcast(offsets), "range").withColumn("rank", F.col("ahead") + F.col("at") + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("range", "at", "ahead")
    rest = scored.where(~F.coalesce(above, F.lit(False))).drop("may").withColumn("rank", none)
    return placed.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, n_buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of all docs (doc_id, text); rank is 1, 2, ... of the rows that are drawn.

    Of the documents with at least `least_words` words floor(percent of a hundred) are drawn. target: texts (text) that the draw should be like.
    """
    gain = gains(counted(docs, n_buckets, runs), counted(target, n_buckets, runs))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = saved(weighed(docs, gain, runs).withColumn("score", F.col("weight") + noise).withColumn("may", F.col("n_words") >= least_words))
    candidates = scored.where("may").count()
    return ranked(scored, percent * candidates // 100, candidates)


def op13_importance(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum has no function there: its table is made by rule, and each distinct feature's bytes are folded.
OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS b, range AS v, 0 AS i FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM steps WHERE i = 8),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS MATERIALIZED (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS MATERIALIZED (
  SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
         list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM split),
hexes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM runs)),
bytes AS (SELECT f, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS bs FROM hexes),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes, crc),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM runs JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM counts),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (ss::DOUBLE + 10000)) / ((s + 1.0::DOUBLE) * (tt::DOUBLE + 10000)))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT doc_id, sum(gain) AS weight FROM runs JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT s.doc_id, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || s.doc_id), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296))) AS BIGINT) AS score, len(w) >= 20 AS may
  FROM split s LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS r, count(*) FILTER (may) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND r <= (5 * n) // 100 THEN r END AS rank FROM placed
"""
