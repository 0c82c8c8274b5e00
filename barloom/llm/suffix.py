"""Suffix-array dedup of bytes.

Documents meet in shards: in every `width`-byte string the least 32-byte substring by hash is its anchor, so equal
strings have equal anchors. Anchors that occur twice send what surrounds them, up to `width - 1` bytes on either side,
to the shard of their hash. A shard folds equal surroundings, orders the suffixes of the others by induced sorting with
queues on disk, and strings whose suffixes have `width` bytes in common with a neighbour's are repeats.

Induced sorting within a shard: suffixes that are smaller than both neighbours in the text (S*) are ordered first, by
the names of the pieces between them and then, recursively, by names of pairs of names; the order of all others follows
from theirs, in one pass up and one pass down over queues that are prioritised by first byte. The queues of induced
suffixes are written to the task's temporary files whenever they hold more than QUEUE_BYTES.

Where this differs from induced sorting that is external throughout: only the queues spill. A shard's bytes, its S* names
and the order itself are arrays in memory, about 40 bytes for a byte of text, and common prefixes are compared once the
order is known instead of being carried with the queues. What makes shards larger than memory unnecessary is that they
are split before: they hold the surroundings of some anchors, about SHARD_BYTES of text, equal surroundings of a task are
one entry however many there are, and anchors that stand in more than `crowd` places are dealt once more by the bytes
around them, in ranges of STARTS windows that share `width - STARTS + 1` bytes.

Defined results: a null or empty text has no bytes and loses none. Texts shorter than `width` stay whole, longer ones of
any length count whole. Repeats within one document count, overlapping ones too; every occurrence goes, the first as
well. Rows that repeat a text are repeats of each other, whether or not they share an id, and each is a row of the
result. A row without doc_id stays whole and is not compared. An empty table gives no rows. Other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .frames import id_and_text, saved
from .substring import BLOCK_BYTES, PACKED, SPAN, Gathered, Packer, collected, flat, ids_of, known_ids
from .vec import run_starts

GRAM = 32
TASK_BYTES = 1 << 20  # bytes of text worked on at once in a task
BODY_BYTES = 8 << 20  # bytes of surroundings that a task folds at once
QUEUE_BYTES = 128 << 20
SHARD_BYTES = 4 << 20  # bytes of text behind a shard
STARTS = 24
MANY_ANCHORS = 1_000_000  # anchors with crowds at most; 8 bytes each are sent to all tasks
SEPARATOR, FIRST_BYTE = 1, 2


class Queues:
    """First-in first-out queues of suffix places, one for each first symbol; beyond `most` bytes they go to disk."""

    def __init__(self, most: int = QUEUE_BYTES):
        self.most, self.held = most, 0
        self.parts: dict[int, list] = {}

    def put(self, symbol: int, places: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append(places)
        self.held += places.nbytes
        if self.held > self.most:
            for parts in self.parts.values():
                for i, p in enumerate(parts):
                    if isinstance(p, np.ndarray) and p.nbytes:
                        parts[i] = tempfile.TemporaryFile()
                        p.tofile(parts[i])
            self.held = 0

    def take(self, symbol: int) -> np.ndarray:
        out = []
        for p in self.parts.pop(symbol, []):
            if isinstance(p, np.ndarray):
                out.append(p)
                self.held = max(0, self.held - p.nbytes)
            else:
                p.seek(0)
                out.append(np.fromfile(p, np.int32))
                p.close()
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def deal(self, places: np.ndarray, symbols: np.ndarray) -> None:
        """Appends places by their symbols, in order."""
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = run_starts(symbols)
        for i, j in zip(first, np.append(first[1:], len(symbols)), strict=True):
            self.put(int(symbols[i]), places[order[i:j]])


def star_order(t: np.ndarray, is_s: np.ndarray, star: np.ndarray, depth: int) -> np.ndarray:
    """Order of the S* suffixes by `depth` symbols at least: names of the pieces between them, then names of pairs of names.

    Of equal symbols the one of an L suffix comes first, so no piece is the beginning of another.
    """
    m = len(star)
    ends = np.append(star[1:] + 1, len(t))  # pieces include the first symbol of the next
    padded = np.append(t.astype(np.uint64) * vec.U64(2) + is_s, vec.U64(0))
    name = np.zeros(m, np.int64)
    todo, at = np.arange(m), 0
    while len(todo):  # four symbols of 16 bits at a time; pieces that have ended or are told apart stay
        key = np.zeros(len(todo), np.uint64)
        for i in range(4):
            place = star[todo] + at + i
            key = (key << vec.U64(16)) | np.where(place < ends[todo], padded[np.minimum(place, len(t))], 0).astype(np.uint64)
        order = np.lexsort((key, name[todo]))
        new = np.zeros(len(todo), bool)
        first = run_starts(name[todo][order], key[order])
        new[first] = True
        # a name is the number of pieces that are smaller; groups keep their place
        group = run_starts(name[todo][order])
        base = np.repeat(name[todo][order][group], np.diff(np.append(group, len(todo))))
        within = np.arange(len(todo)) - np.repeat(group, np.diff(np.append(group, len(todo))))
        start = np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))
        name[todo[order]] = base + within[start]
        sizes = np.repeat(np.diff(np.append(first, len(todo))), np.diff(np.append(first, len(todo))))
        at += 4
        open_ = todo[order][(sizes > 1)]
        todo = np.sort(open_[star[open_] + at < ends[open_]]) if at < depth + 8 else np.zeros(0, np.int64)
    step = 1
    order = np.argsort(name, kind="stable")
    while step < depth and len(run_starts(name[order])) < m:
        after = np.zeros(m, np.int64)
        after[: m - step] = name[step:] + 1
        order = np.lexsort((after, name)) if m >= 1 << 31 else np.argsort(name.astype(np.uint64) << vec.U64(32) | after.astype(np.uint64), kind="stable")
        first = run_starts(name[order], after[order])
        fresh = np.zeros(m, np.int64)
        fresh[order] = np.repeat(first, np.diff(np.append(first, m)))
        name = fresh
        step *= 2
    return order


def suffix_order(t: np.ndarray, depth: int, most: int = QUEUE_BYTES) -> np.ndarray:
    """Places of t in the order of their suffixes, told apart by `depth` symbols at least.

    t is uint16; its last symbol is 0 and stands there only.
    """
    n = len(t)
    up = np.sign(np.diff(t.astype(np.int32)))
    told = np.flatnonzero(up)
    is_s = np.zeros(n, bool)
    if len(told):
        is_s[: told[-1] + 1] = up[told[np.searchsorted(told, np.arange(told[-1] + 1))]] > 0
    is_s[-1] = True
    star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    star = star[star_order(t, is_s, star, depth)].astype(np.int32)
    symbols = np.unique(t).tolist()
    stars, queues, larger = {}, Queues(most), Queues(most)
    first = np.searchsorted(t[star], symbols, "left")
    for c, i, j in zip(symbols, first, np.append(first[1:], len(star)), strict=True):
        stars[c] = star[i:j]

    def induce(q: Queues, items: np.ndarray, small: bool) -> None:
        before = items[items > 0] - 1
        before = before[is_s[before] == small]
        if len(before):
            q.deal(before, t[before])

    for c in symbols:  # L suffixes, upwards
        while len(items := queues.take(c)):
            larger.put(c, items)
            induce(queues, items, False)
        induce(queues, stars[c], False)
    parts: list[np.ndarray] = []
    for c in reversed(symbols):  # S suffixes, downwards
        if c == 0:
            parts.append(np.array([n - 1], np.int32))
            continue
        while len(items := queues.take(c)):
            parts.append(items)
            induce(queues, items, True)
        items = larger.take(c)[::-1]
        parts.append(items)
        induce(queues, items, True)
    # the last place is an S* suffix that nothing induces; what it precedes was induced from `larger`
    return np.concatenate(parts)[::-1]


def repeated_places(bodies: list[bytes], n_windows: np.ndarray, width: int) -> list[np.ndarray]:
    """For each body, True at the window starts whose `width` bytes also stand in another place of the bodies."""
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    t = np.frombuffer(b"\0".join(bodies) + b"\0\0", np.uint8).astype(np.uint16) + FIRST_BYTE
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    t[first[1:] - 1] = SEPARATOR
    t[-1] = 0
    order = suffix_order(t, width)
    start = np.zeros(len(t), bool)
    edge = np.zeros(len(t) + 1, np.int32)
    np.add.at(edge, first[:-1], 1)
    np.add.at(edge, first[:-1] + n_windows, -1)
    start = np.cumsum(edge[:-1]) > 0
    order = order[start[order]]
    words = np.lib.stride_tricks.sliding_window_view(t, 4)
    alike = np.arange(len(order) - 1)
    a, b = order[:-1], order[1:]
    for at in range(0, width, 4):  # common prefix with the next suffix, four bytes at a time
        k = min(at, width - 4)
        same = (words[a[alike] + k] == words[b[alike] + k]).all(axis=1)
        alike = alike[same]
        if not len(alike):
            break
    hit = np.zeros(len(t), bool)
    hit[a[alike]] = hit[b[alike]] = True
    return [hit[f : f + n] for f, n in zip(first[:-1].tolist(), n_windows.tolist(), strict=True)]


def anchors_of(texts: list[bytes], width: int):
    """Of a batch: bytes, the starts of all windows within a text, the anchor of each, hashes of the 32-byte substrings."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    gram = min(GRAM, width)
    h = vec.windows(vec._BYTES[buf], gram)
    w = width - gram + 1
    n = len(h) - w + 1
    if n <= 0:
        return buf, offsets, np.zeros(0, np.int64), np.zeros(0, np.int64), h
    v = (h >> vec.U64(32) << vec.U64(32)) | np.arange(len(h), dtype=np.uint64)
    least = vec.sliding_min(v, w)
    at = np.arange(n)
    good = at + width <= np.repeat(offsets[1:] - 1, sizes + 1)[:n]
    return buf, offsets, at[good], (least[good] & vec.U64(0xFFFFFFFF)).astype(np.int64), h


def known_twice(columns, doc, place):
    """Anchors that a block holds twice: all are settled, one stands for them with their number."""
    key, times = columns
    done, send = np.zeros(len(key), bool), np.ones(len(key), bool)
    order = np.argsort(key, kind="stable")
    first = run_starts(key[order])
    if len(first):
        sizes = np.diff(np.append(first, len(key)))
        done[order] = np.repeat(sizes > 1, sizes)
        send = ~done
        send[order[first]] = True
        times[order[first]] = sizes
    return done, send


def anchor_blocks(width: int, buckets: int):
    def run(batches):
        out = Packer(buckets, known_twice)
        for batch in batches:
            ids = ids_of(batch)
            for i, j, texts in vec.parts(batch.column(1), TASK_BYTES):
                buf, offsets, _, anchor, h = anchors_of(texts, width)
                at = anchor[run_starts(anchor)]
                key = vec.mix(h[at])
                text = np.searchsorted(offsets, at, "right") - 1
                out.add(key, [key, np.ones(len(key), np.uint32)], at - text, ids[i:j], np.diff(offsets) - 1, len(buf))
                if out.size >= BLOCK_BYTES:
                    yield from out.flush()
        yield from out.flush()

    return run


FOUND = "doc_id long, digest long, place int, crowd long"


def twice(crowd: int):
    """Places of anchors that occur twice at least; and, without a place, anchors that occur more than `crowd` times."""

    def run(group: pa.Table) -> pa.Table:
        found = Gathered(group, [np.uint64, np.uint32])
        key, times = found.columns
        order = np.argsort(key)
        first = run_starts(key[order])
        sizes = np.diff(np.append(first, len(key)))
        places = flat(*found.with_done(order[np.repeat(sizes > 1, sizes)]))
        many = np.zeros(0, np.uint64)
        if len(first):
            many = key[order][first][np.add.reduceat(times[order].astype(np.int64), first) > crowd]
        places = places.append_column("crowd", pa.nulls(len(places), pa.int64()))
        none = pa.nulls(len(many), pa.int64())
        return pa.concat_tables([places, pa.table([none, none, none.cast(pa.int32()), pa.array(many.view(np.int64))], names=places.column_names)])

    return run


AROUND = "bucket int, key long, doc_id long, digest long, start int, n int, times int, body binary"


def surroundings(width: int, buckets: int, crowds: np.ndarray):
    """For each repeated anchor the bytes of all windows that have it; of equal ones of a task one, and the others' spans."""

    def dealt(parts: list[tuple]):
        key, ids, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
        bodies = pa.concat_arrays([p[3] for p in parts]).dictionary_encode()
        code, body = bodies.indices.to_numpy(), bodies.dictionary
        size = pc.binary_length(body).to_numpy() - width + 1
        times = np.bincount(code, minlength=len(body))
        again = times[code] > 1
        one = np.zeros(len(body), np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]
        rows = np.concatenate([np.sort(one), np.flatnonzero(again)])
        told = np.arange(len(rows)) >= len(one)
        bucket = np.where(told, vec.bucket_of(vec.mix(vec.mix(ids[rows, 0].view(np.uint64)) ^ ids[rows, 1].view(np.uint64)), buckets), vec.bucket_of(key[rows], buckets))
        sent = body.take(pa.array(code[rows], mask=told))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket.astype(np.int32)), pa.array(key[rows].view(np.int64)), pa.array(ids[rows, 0]), pa.array(ids[rows, 1]), pa.array(start[rows].astype(np.int32)), pa.array(size[code[rows]].astype(np.int32)), pa.array(times[code[rows]].astype(np.int32)), sent],
            [x.split()[0] for x in AROUND.split(", ")],
        )

    def run(batches):
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            ids, found = ids_of(batch), batch.column(3)
            for i, j, texts in vec.parts(batch.column(1), TASK_BYTES):
                buf, offsets, at, anchor, h = anchors_of(texts, width)
                part = found.slice(i, j - i)
                hit = np.zeros(len(buf) + 1, bool)
                hit[part.flatten().to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], np.diff(part.offsets.to_numpy()))] = True
                keep = hit[anchor]
                at, anchor = at[keep], anchor[keep]
                if not len(at):
                    continue
                key = vec.mix(h[anchor])
                # windows of a crowd are parted by how far before the anchor they begin, in ranges
                range_ = np.where(np.isin(key, crowds), (anchor - at) // STARTS + 1, 0) if len(crowds) else np.zeros(len(at), np.int64)
                first = run_starts(anchor, range_)
                start, last = at[first], at[np.append(first[1:], len(at)) - 1]
                key, range_, anchor = key[first], range_[first], anchor[first]
                some = np.flatnonzero(range_)
                if len(some):  # all windows of the range hold these bytes; equal windows are in equal ranges
                    core = vec.windows(vec._BYTES[buf], width - STARTS + 1)[anchor[some] - (range_[some] - 1) * STARTS]
                    key[some] = vec.mix(key[some] ^ vec.mix(core + range_[some].astype(np.uint64)))
                text = np.searchsorted(offsets, start, "right") - 1
                whole = buf.tobytes()
                bodies = pa.array([whole[a:e] for a, e in zip(start.tolist(), (last + width).tolist(), strict=True)], pa.binary())
                parts.append((key, ids[i:j][text], start - offsets[text], bodies))
                held += bodies.nbytes
                if held > BODY_BYTES:
                    yield dealt(parts)
                    parts, held = [], 0
        if parts:
            yield dealt(parts)

    return run


def shard(width: int):
    """Spans of repeated window starts, as first and last place, by document."""

    def run(group: pa.Table) -> pa.Table:
        told = group.column("body").is_null()
        known, group = group.filter(told), group.filter(pc.invert(told))
        body = group.column("body").combine_chunks().dictionary_encode()
        code = body.indices.to_numpy()
        bodies = body.dictionary.to_pylist()
        count = np.bincount(code, group.column("times").to_numpy(), minlength=len(bodies)).astype(np.int64)
        key = np.zeros(len(bodies), np.int64)
        key[code] = group.column("key").to_numpy()
        n_windows = np.fromiter(map(len, bodies), np.int64, len(bodies)) - width + 1
        order = np.argsort(key, kind="stable")
        first = run_starts(key[order])
        sizes = np.diff(np.append(first, len(key)))
        many = np.zeros(len(key), bool)
        many[order] = np.repeat(sizes > 1, sizes)
        spans: list[np.ndarray] = [np.array([[0, n - 1]]) if c > 1 else np.zeros((0, 2), np.int64) for n, c in zip(n_windows.tolist(), count.tolist(), strict=True)]
        chosen = np.flatnonzero(many)
        if len(chosen):
            found = repeated_places([bodies[i] for i in chosen.tolist()], n_windows[chosen], width)
            for i, hit in zip(chosen.tolist(), found, strict=True):
                if count[i] == 1 and hit.any():
                    spans[i] = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2) - [0, 1]
        n_spans = np.fromiter(map(len, spans), np.int64, len(spans))
        flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
        at = np.concatenate([[0], np.cumsum(n_spans)])
        each = n_spans[code]
        row = np.repeat(np.arange(len(code)), each)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        got = flat[at[code][row] + inner] + group.column("start").to_numpy()[row][:, None]
        start, n = known.column("start").to_numpy(), known.column("n").to_numpy()
        both = lambda name: np.concatenate([group.column(name).to_numpy()[row], known.column(name).to_numpy()])
        return pa.table({"doc_id": pa.array(both("doc_id"), pa.int64()), "digest": pa.array(both("digest"), pa.int64()), "first": pa.array(np.concatenate([got[:, 0], start]), pa.int32()), "last": pa.array(np.concatenate([got[:, 1], start + n - 1]), pa.int32())})

    return run


def remaining(width: int, with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(vec.texts_of(batch.column(1)), batch.column(3), strict=True):
                runs, left = np.zeros((0, 2), np.int64), text
                if spans.is_valid:
                    edge = np.zeros(len(text) + 1, np.int32)
                    np.add.at(edge, spans.values.field(0).to_numpy(), 1)
                    np.add.at(edge, spans.values.field(1).to_numpy() + width, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    runs = np.flatnonzero(np.diff(np.concatenate([[True], stay, [True]]).astype(np.int8))).reshape(-1, 2)
                    left = np.frombuffer(text, np.uint8)[stay].tobytes()
                rows.append((len(text), len(text) - len(left), len(runs), left if with_text else None, hashlib.sha256(left).hexdigest(), runs.tolist()))
            n, gone, n_spans, left, digest, spans = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(left, pa.binary()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"],
            )

    return run


def suffix_dedup(docs: DataFrame, width: int = 200, crowd: int = 2000, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes left; null without with_text), kept_sha256, spans ([first, end) bytes removed) of each row.

    A byte goes if a string of `width` bytes over it also starts anywhere else.
    """
    if width < 8:
        raise ValueError("width must be 8 bytes at least")
    docs = id_and_text(docs, doc_id, text)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // SHARD_BYTES))
    docs, unknown = known_ids(docs)
    key = ["doc_id", "digest"]
    places = saved(docs.mapInArrow(anchor_blocks(width, buckets), PACKED).groupBy("bucket").applyInArrow(twice(max(crowd, int(total) // 80 // MANY_ANCHORS)), FOUND))
    # a text has an anchor for each 80 bytes or more, so these are MANY_ANCHORS at most
    crowds = places.where("crowd IS NOT NULL").select("crowd").toArrow().column(0).to_numpy().view(np.uint64) if width > GRAM + STARTS else np.zeros(0, np.uint64)
    found = collected(places.where("crowd IS NULL"), "place")
    around = docs.join(found, key).select("doc_id", "text", "digest", "places").mapInArrow(surroundings(width, buckets, crowds), AROUND)
    spans = collected(around.groupBy("bucket").applyInArrow(shard(width), SPAN), "first", "last")
    rows = docs.join(spans, key, "left").select("doc_id", "text", "digest", "places").union(unknown.select("doc_id", "text", "digest", "places"))
    return rows.mapInArrow(remaining(width, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<array<int>>")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
