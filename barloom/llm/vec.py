"""Numpy helpers that run inside Spark tasks: words, rolling hashes and packed exchanges.

A batch of texts is one byte buffer, texts parted by a line feed. All hashes are 64 bit and made without Python loops
over words. Words are runs of bytes other than space and 0x09-0x0D, as in every contract of this subpackage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
NEVER = np.uint64(2**64 - 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PRIMES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Random value of each byte, so that equal-length strings do not collide by structure.
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        p = _PRIMES[which]
        up, down = np.full(n, p, np.uint64), np.full(n, pow(p, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[which] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of values[i] * P**i, one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(max(len(values), 1), which)[0][: len(values)], out=out[1:], dtype=np.uint64)
    return out


def windows(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive 64-bit values; empty if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pre = prefix(values, which)
    return mix((pre[k:] - pre[:n]) * powers(n, which)[1])


class Words:
    """The words of a batch of texts: byte spans, hashes, and which text each word is in."""

    def __init__(self, texts: list[bytes], lower: bool = False, change: Callable[[np.ndarray], np.ndarray] | None = None):
        self.n_texts = len(texts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if change is not None:
            buf = change(buf)
        elif lower:
            buf = LOWER[buf]
        self.buf = buf
        blank = SPACE[buf]
        before = np.concatenate([[True], blank[:-1]])
        self.starts = np.flatnonzero(~blank & before)
        self.ends = np.flatnonzero(blank & ~before)
        self.first = np.searchsorted(self.starts, self.offsets)  # first word of each text, and the end
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts, dtype=np.int32), self.counts)

    def hashes(self) -> np.ndarray:
        pre = prefix(_BYTES[self.buf])
        raw = (pre[self.ends] - pre[self.starts]) * powers(max(len(self.buf), 1))[1][self.starts]
        return mix(raw + (self.ends - self.starts).astype(np.uint64) * U64(0x9E3779B97F4A7C15))

    def inside(self, k: int) -> np.ndarray:
        """Starts of windows of k words that lie within one text (word numbers of the batch)."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        left = np.repeat(self.first[1:], self.counts)[:n]
        at = np.arange(n)
        return at[at + k <= left]


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row is a range of its own."""
    at = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def parts(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of about `most` bytes with their texts, made one range at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for i, j in chunks(sizes, most):
        yield i, j, texts_of(column.slice(i, j - i))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List array of values parted at bounds (one more than there are lists)."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys; the keys are sorted."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def pack(columns: Iterable[np.ndarray], at: np.ndarray, first: np.ndarray, ids: np.ndarray) -> bytes:
    """One packed block: columns of entries, their rising places, and the two ids of each text that has entries.

    first: where each text begins, and the end. Places are kept as gaps within their text and ids as steps, low and high
    bytes apart, so that the shuffle's own compression removes the zeros.
    """
    text = np.searchsorted(first, at, side="right") - 1
    new = run_starts(text)
    used = text[new]
    gap = np.diff(at, prepend=0)
    gap[new] = at[new] - first[used]
    gap = gap.astype(np.uint32)
    planes = [(gap >> np.uint32(8 * i)).astype(np.uint8) for i in range(4)]
    head = np.array([len(at), len(used)], np.int64)
    step = np.diff(ids[used], axis=0, prepend=np.zeros((1, 2), np.int64))  # ids mostly rise by little
    counts = np.diff(np.append(new, len(at))).astype(np.int32)
    bytes_of = lambda x, size: np.ascontiguousarray(x).view(np.uint8).reshape(-1, size).T.tobytes()  # noqa: E731  like bytes together
    return b"".join([head.tobytes(), bytes_of(step, 16), bytes_of(counts, 4), *(p.tobytes() for p in planes), *(c.tobytes() for c in columns)])


def unpack(block: bytes, kinds: Iterable[np.dtype]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns, the ids of the texts (two each), and the text number and the place within the text of each entry."""
    n, m = np.frombuffer(block, np.int64, 2)
    at = 16
    whole = lambda size, kind: np.ascontiguousarray(np.frombuffer(block, np.uint8, size * m, at).reshape(size, m).T).view(kind)
    ids = np.cumsum(whole(16, np.int64), axis=0)
    at += 16 * m
    counts = whole(4, np.int32).ravel()
    at += 4 * m
    gap = np.zeros(n, np.int64)
    for i in range(4):
        gap |= np.frombuffer(block, np.uint8, n, at).astype(np.int64) << (8 * i)
        at += n
    columns = []
    for kind in kinds:
        columns.append(np.frombuffer(block, kind, n, at))
        at += n * np.dtype(kind).itemsize
    place = np.cumsum(gap)
    new = np.cumsum(counts, dtype=np.int64) - counts
    place -= np.repeat(place[new] - gap[new], counts)
    return columns, ids, np.repeat(np.arange(m, dtype=np.int32), counts), place.astype(np.int32)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket from the low half of a hash; the high half stays free to tell entries of a bucket apart."""
    return ((h & U64(0xFFFFFFFF)) * U64(buckets) >> U64(32)).astype(np.int32)


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has entries, with their numbers in rising order."""
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            yield b, order[bounds[b] : bounds[b + 1]]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values: the lower of a running least from the left and one from the right, by pieces of w."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    full = np.full(-(-len(v) // w) * w, np.iinfo(v.dtype).max, v.dtype)
    full[: len(v)] = v
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
