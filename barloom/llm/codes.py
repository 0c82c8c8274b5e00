"""Vector code compression: product codebooks by the filtering form of Lloyd's algorithm.

Vectors are cut into parts, and each part position has a codebook. Every partition packs its vectors into chunks of CHUNK and
builds a kd-tree over each part position of a chunk, once: points in the tree's order, and for every node its bounding box, the sum of its
points and their number. A round sends the codebooks (a few hundred numbers at any size) down the trees: an entry leaves a
node if another one is nearer to all of its box, and a node with one entry left is assigned whole by its cached sum and count;
only leaves that are still undecided compare points. All trees of a chunk are walked level by level at once. Each
task returns one vector of sums and counts, and these are added up in a tree.

All arithmetic is in whole numbers, so results do not depend on the order of anything: ties go to the lower index, exactly.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of another
length than that of the row that comes first (smallest id, nulls last; then the smaller vector). Components count up to +-2**26 after scaling
and are cut off there, so that all sums fit. Lengths that the parts do not divide make the first parts longer by one. With fewer rows
than entries the codebooks are shorter. Repeated rows count each; rows with the same id are ordered by their vectors where the first
entries are taken. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import saved, table, vector_sum

CHUNK = 8192
LEAF = 32
SCALE = 4096
MOST = 1 << 26
NEVER = np.int64(2**63 - 1)


@dataclass(frozen=True)
class Shape:
    """How vectors of a length are cut: parts of `width` numbers, the last of which are 0 in shorter parts."""

    length: int
    parts: int

    @property
    def bounds(self) -> list[tuple[int, int]]:
        small, more = divmod(self.length, self.parts)
        ends = np.cumsum([small + (i < more) for i in range(self.parts)]).tolist()
        return list(zip([0, *ends], ends, strict=False))

    @property
    def width(self) -> int:
        return max(1, -(-self.length // self.parts))

    def cut(self, whole: np.ndarray) -> np.ndarray:
        """(rows, length) -> (parts, rows, width)."""
        out = np.zeros((self.parts, len(whole), self.width), np.int64)
        for p, (a, b) in enumerate(self.bounds):
            out[p, :, : b - a] = whole[:, a:b]
        return out


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), cut off at MOST."""
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def usable(vector: Column) -> Column:
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, number), F.lit(False))


class Forest:
    """kd-trees over the part positions of a chunk, all of the same balanced form.

    points: (parts, leaves * leaf, width) in tree order, order: the chunk's row of each (rows from n on only fill up);
    low, high, sums: (parts, nodes, width) and counts: (nodes,), level after level from the root.
    """

    def __init__(self, n: int, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, counts: np.ndarray):
        self.n, self.points, self.order, self.low, self.high, self.sums, self.counts = n, points, order, low, high, sums, counts
        self.depth = (counts.shape[1] + 1).bit_length() - 2

    @classmethod
    def build(cls, cut: np.ndarray) -> Forest:
        parts, n, width = cut.shape
        depth = max(0, (n // LEAF).bit_length() - 1)
        size = -(-n // (1 << depth)) << depth
        order = np.broadcast_to(np.minimum(np.arange(size), n - 1), (parts, size))
        points = np.take_along_axis(cut, order[:, :, None], 1)
        order = np.broadcast_to(np.arange(size), (parts, size))
        for level in range(depth):
            nodes = points.reshape(parts << level, size >> level, width)
            axis = (nodes.max(1) - nodes.min(1)).argmax(1)
            by = np.argsort(np.take_along_axis(nodes, axis[:, None, None], 2)[:, :, 0], axis=1, kind="stable")
            points = np.take_along_axis(nodes, by[:, :, None], 1).reshape(parts, size, width)
            order = np.take_along_axis(order.reshape(parts << level, size >> level), by, 1).reshape(parts, size)
        leaves = points.reshape(parts, 1 << depth, -1, width)
        real = (order < n).reshape(parts, 1 << depth, -1)
        low, high = [leaves.min(2)], [leaves.max(2)]
        sums, counts = [(leaves * real[..., None]).sum(2)], [real.sum(2)]
        for _ in range(depth):
            pair = lambda x: x.reshape(parts, x.shape[1] // 2, 2, *x.shape[2:])
            low.insert(0, pair(low[0]).min(2))
            high.insert(0, pair(high[0]).max(2))
            sums.insert(0, pair(sums[0]).sum(2))
            counts.insert(0, pair(counts[0]).sum(2))
        return cls(n, points, order, *(np.concatenate(x, 1) for x in (low, high, sums, counts)))

    def pack(self) -> bytes:
        """Numbers in the fewest bytes that hold them."""
        arrays = (self.points, self.order, self.low, self.high, self.sums, self.counts)
        small = [a.astype(np.result_type(np.min_scalar_type(a.min()), np.min_scalar_type(a.max()))) for a in arrays]
        head = [self.n, *self.points.shape, self.counts.shape[1], *(int(a.dtype.str[2:]) * (1 if a.dtype.kind == "i" else -1) for a in small)]
        return np.array(head, np.int64).tobytes() + b"".join(a.tobytes() for a in small)

    @classmethod
    def unpack(cls, block: bytes) -> Forest:
        n, parts, size, width, nodes, *kinds = np.frombuffer(block, np.int64, 11).tolist()
        at, arrays = 88, []
        for kind, shape in zip(kinds, ((parts, size, width), (parts, size), *[(parts, nodes, width)] * 3, (parts, nodes)), strict=True):
            dtype, number = np.dtype(f"{'i' if kind > 0 else 'u'}{abs(kind)}"), int(np.prod(shape))
            arrays.append(np.frombuffer(block, dtype, number, at).reshape(shape).astype(np.int64))
            at += dtype.itemsize * number
        return cls(n, *arrays)

    def owners(self, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Subtrees and their one entry: (level, part, node in the level, entry); at last undecided leaves with level -1: (part, leaf, candidates).

        books: (parts, entries, width).
        """
        parts, entries = books.shape[:2]
        part, node, may = np.arange(parts), np.zeros(parts, np.int64), np.ones((parts, entries), bool)
        for level in range(self.depth + 1):
            at = (1 << level) - 1 + node
            low, high, own = self.low[part, at][:, None, :], self.high[part, at][:, None, :], books[part]
            middle = np.where(may, ((low + high - 2 * own) ** 2).sum(2), NEVER)
            best = middle.argmin(1)
            nearest = own[np.arange(len(part)), best][:, None, :]
            corner = np.where(own > nearest, high, low)  # of the box, furthest to the entry's side
            there, here = ((corner - own) ** 2).sum(2), ((corner - nearest) ** 2).sum(2)
            may = may & ~((there > here) | ((there == here) & (best[:, None] < np.arange(entries))))
            one = may.sum(1) == 1
            yield level, part[one], node[one], best[one]
            part, node, may = part[~one], node[~one], may[~one]
            if level == self.depth:
                yield -1, part, node, may
            else:
                part, node, may = np.repeat(part, 2), (2 * node[:, None] + np.arange(2)).ravel(), np.repeat(may, 2, 0)

    def nearest(self, books: np.ndarray, part: np.ndarray, leaf: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Entry of each point of undecided leaves, among the candidates."""
        points = self.points.reshape(len(self.points), 1 << self.depth, -1, self.points.shape[2])[part, leaf]
        best, entry = np.full(points.shape[:2], NEVER), np.zeros(points.shape[:2], np.int64)
        for k in range(books.shape[1]):
            d = np.where(may[:, k, None], ((points - books[part, k][:, None, :]) ** 2).sum(2), NEVER)
            entry = np.where(d < best, k, entry)
            best = np.minimum(best, d)
        return entry

    def totals(self, books: np.ndarray) -> np.ndarray:
        """(parts, entries, width + 1): sum of the points nearest to each entry, and their number."""
        parts, entries, width = books.shape
        out = np.zeros((parts * entries, width + 1), np.int64)
        for level, part, node, found in self.owners(books):
            if level >= 0:
                at = (1 << level) - 1 + node
                slot, rows, number = part * entries + found, self.sums[part, at], self.counts[part, at]
            else:
                entry = self.nearest(books, part, node, found)
                slot = (part[:, None] * entries + entry).ravel()
                number = (self.order.reshape(parts, 1 << self.depth, -1)[part, node] < self.n).ravel().astype(np.int64)
                rows = self.points.reshape(parts, 1 << self.depth, -1, width)[part, node].reshape(-1, width) * number[:, None]
            np.add.at(out, slot, np.concatenate([rows, number[:, None]], 1))
        return out.reshape(parts, entries, width + 1)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entries, and the squared distances of each row added up."""
        parts, size, _ = self.points.shape
        entry = np.zeros((parts, size), np.int64)
        for level, part, node, found in self.owners(books):
            if level >= 0:
                entry.reshape(parts, 1 << level, -1)[part, node] = found[:, None]
            else:
                entry.reshape(parts, 1 << self.depth, -1)[part, node] = self.nearest(books, part, node, found)
        far = ((self.points - np.take_along_axis(books, entry[:, :, None], 1)) ** 2).sum(2)
        code, error = np.zeros((size, parts), np.int64), np.zeros(size, np.int64)
        for p in range(parts):
            code[self.order[p], p] = entry[p]
            error[self.order[p]] += far[p]
        return code[: self.n], error[: self.n]


def forests(vectors: DataFrame, shape: Shape, carry: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """Rows of up to CHUNK vectors: their columns `carry` as arrays, and their trees (forest)."""
    kinds = dict(vectors.dtypes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: pa.Table) -> pa.RecordBatch:
            values = held.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            forest = Forest.build(shape.cut(whole(values.reshape(held.num_rows, shape.length))))
            lists = {c: pa.ListArray.from_arrays(pa.array([0, held.num_rows], pa.int32()), held.column(c).combine_chunks()) for c in carry}
            return pa.record_batch({**lists, "forest": pa.array([forest.pack()], pa.binary())})

        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= CHUNK:
                yield packed(held.slice(0, CHUNK))
                held = held.slice(CHUNK)
        if held is not None and held.num_rows:
            yield packed(held)

    fields = [f"`{c}` array<{kinds[c]}>" for c in carry]
    return vectors.select(*carry, "vector").mapInArrow(build, ", ".join([*fields, "forest binary"]))


def improved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: each entry the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = books.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for block in batch.column(0):
                sums += Forest.unpack(block.as_buffer()).totals(books)
        yield pa.record_batch({"sums": pa.array([sums.tobytes()], pa.binary())})

    sums = vector_sum(trees.select("forest").mapInArrow(walk, "sums binary"), parts * entries * (width + 1)).reshape(parts, entries, width + 1)
    return np.where(sums[:, :, -1:] > 0, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books)


def encoded(trees: DataFrame, books: np.ndarray, carry: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The columns `carry`, code (two hex digits a part) and error of every vector."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("forest")):
                code, error = Forest.unpack(block.as_buffer()).codes(books)
                digits = np.frombuffer(code.astype(np.uint8).tobytes().hex().encode(), f"S{2 * len(books)}")
                own = {c: batch.column(c).slice(i, 1).flatten() for c in carry}
                yield pa.record_batch({**own, "code": pa.array(digits.astype(str), pa.string()), "error": pa.array(error)})

    kinds = {c: t[len("array<") : -1] for c, t in trees.dtypes if t.startswith("array<")}
    return trees.mapInArrow(walk, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "code string", "error long"]))


def flat(books: np.ndarray, shape: Shape) -> list[int]:
    """All components by part, entry and place within the part."""
    return [x for p, (a, b) in enumerate(shape.bounds) for entry in books[p] for x in entry[: b - a].tolist()]


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray, Shape]:
    """(vec_id, label, code, error of every kept vector; codebooks (parts, entries, width); how vectors are cut). Up to 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    kept = vectors.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("length")).first()
    shape = Shape(first[0] if first else 0, parts)
    kept = kept.where(F.size("vector") == shape.length)
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    books = shape.cut(whole(np.array([r[0] for r in seeds], np.float64).reshape(len(seeds), shape.length)))
    trees = saved(forests(kept, shape))
    for _ in range(rounds if seeds else 0):
        books = improved(trees, books)
    return encoded(trees, books), books, shape


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books, shape = compress(table(spark, sf_dir, "embeddings"))
    coded = saved(coded)
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, flat(books, shape))).encode()).hexdigest()
    return coded.join(sums, F.expr("label <=> l")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    def assigned(i: int) -> str:
        return f"""
near{i} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(x, [d, e]) AS x, arg_min(e, [d, e]) AS e, min(d) AS d
  FROM (SELECT vec_id, p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM cut JOIN book{i} USING (p)) GROUP BY vec_id, p)"""

    def moved(i: int) -> str:
        return f"""
book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c
    FROM (SELECT p, e, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS pos FROM near{i}) GROUP BY p, e, pos) GROUP BY p, e) m USING (p, e))"""

    steps = [f(i) for i in range(rounds) for f in (assigned, moved)] + [assigned(rounds)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, p, v[len(v) // {parts} * p + 1:len(v) // {parts} * (p + 1)] AS x FROM kept, (SELECT range AS p FROM range({parts}))),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < {entries}),{",".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


OP11_SQL = _sql()
