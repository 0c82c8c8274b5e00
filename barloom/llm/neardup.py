"""MinHash near-dedup by a chosen-path set similarity join.

Every document is the set of its distinct `shingle`-word shingles; documents with equal sets are one node of the graph
of links. The others go down independent trees: at each branching a document takes the path named by the least hash of
its set under the tree's next hash function, so two documents stay together with a probability equal to their
similarity. Sorted by their paths, the documents of every tree node are neighbours, so one range sort is all branchings
of all trees at once and a node of any size is spread over tasks by its deeper branchings. Each document is compared
with the `leaf` that follow it and share the first branching, which compares all pairs of all nodes of up to `leaf`
documents exhaustively. Paths go on through the other trees' hashes until all `trees * OWN` are used.

The trees repeat until a link of similarity s whose nodes are small after `deep` branchings is missed in all of them
with a probability of 1 - recall at most: trees = log(1 - recall) / log(1 - s ** deep). Ends of the sort's partitions
cut off at most `leaf` comparisons for each tree; they lie elsewhere in every tree.

Comparisons are of sketches, whose estimate may be SLACK standard deviations below the threshold. A document's best
estimate in each tree is confirmed first, on full sets, and gives components. Documents with more near ones are sorted
once more with their component and the BOTTOM least hashes of their set (all of it, where it is smaller), and only pairs
of different components go on, to be confirmed on full sets: links within a component change nothing. Groups of copies
are so joined by few links, and large groups that are alike but not linked cost comparisons in memory but no rows.

Components come from rounds of hooking to the smallest neighbour (large-star and small-star by turns).

Defined results: a document with fewer words than a shingle is its whole word sequence, as one shingle; without words
or text it is an empty set, linked with nothing. A row without doc_id is in no component: component_id is null, kept is
true. Every row is a document: rows that share a doc_id but not their text are in the components of their texts. Equal
rows have equal results. An empty table gives no rows. Whole texts count, whatever their length; columns other than
doc_id and text are ignored, but for those named in `carry`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .frames import id_and_text, swept
from .vec import run_starts

TASK_BYTES = 2 << 20
OWN = 10  # branchings by a tree's own hash functions
WIDE = 2  # of which the first ones count with 32 bits, all others with 8
LINK_ROWS = 50_000  # links in a task
SLACK = 4.5
BOTTOM = 256
PART_ROWS = 500_000  # rows of the sort in a task; they pass through in batches


def coefficients(k: int) -> np.ndarray:
    return np.random.default_rng(8).integers(1, 2**63, (k, 2), dtype=np.uint64) | vec.U64(1)


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts on end, and where each text's begin (one more than texts)."""
    words = vec.Words(texts, lower=True)
    hashes, text = words.hashes(), words.text_of()
    at = words.inside(shingle)
    h, owner = vec.windows(hashes, shingle)[at], text[at]
    few_h, few_owner = [h], [owner]
    for i in np.flatnonzero((words.counts < shingle) & (words.counts > 0)).tolist():  # the whole sequence is one shingle
        few = hashes[words.first[i] : words.first[i + 1]]
        few_h.append(vec.windows(few, len(few)))
        few_owner.append(np.array([i], np.int32))
    h, owner = np.concatenate(few_h), np.concatenate(few_owner)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = run_starts(owner, h)
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def names_of(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set; none for an empty one."""
    n = np.diff(first)
    some = np.flatnonzero(n)
    sums = np.zeros((len(n), 2), np.uint64)
    if len(some):
        at = first[:-1][some]
        sums[some, 0] = np.add.reduceat(vec.mix(h), at)
        sums[some, 1] = np.add.reduceat(vec.mix(h ^ vec.U64(0x5851F42D4C957F2D)), at)
    return [s.tobytes() if k else None for s, k in zip(sums, n.tolist(), strict=True)]


def sketches(shingle: int, k: int, carried: int):
    """Carried columns, then size, name and k minwise hashes of 32 bits of each set; no name and hashes for an empty one."""
    ab = coefficients(k)

    def run(batches):
        for batch in batches:
            for i, j, texts in vec.parts(batch.column(1), TASK_BYTES):
                h, first = shingle_sets(texts, shingle)
                n = np.diff(first)
                some = np.flatnonzero(n)
                least = np.zeros((len(some), k), np.uint32)
                for c in range(k if len(some) else 0):
                    least[:, c] = np.minimum.reduceat((h * ab[c, 0] + ab[c, 1]) >> vec.U64(32), first[:-1][some])
                sketch: list[bytes | None] = [None] * (j - i)
                for row, s in zip(some.tolist(), least, strict=True):
                    sketch[row] = s.tobytes()
                kept = [batch.column(0), *batch.columns[2 : 2 + carried]]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in kept), pa.array(n, pa.int64()), pa.array(names_of(h, first), pa.binary()), pa.array(sketch, pa.binary())],
                    [*(batch.schema.names[x] for x in (0, *range(2, 2 + carried))), "n_shingles", "name", "sketch"],
                )

    return run


def full_sets(shingle: int):
    def run(batches):
        for batch in batches:
            for _, _, texts in vec.parts(batch.column(0), TASK_BYTES):
                h, first = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(names_of(h, first), pa.binary()), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["name", "members"])

    return run


def confirm(percent: int):
    """Pairs with 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def paths(trees: int):
    """A row for each tree: its own hashes first, then the other trees'; other columns are carried along, `low` by its upper 32 bits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(-1, trees * OWN)
            low = tokens.astype(np.uint8)
            names, rest = batch.schema.names[1:], list(batch.columns[1:])
            if "low" in names:
                at = names.index("low")
                rest[at] = pa.array([(np.frombuffer(x.as_buffer(), np.uint64) >> vec.U64(32)).astype(np.uint32).tobytes() for x in rest[at]], pa.binary())
            for t in range(trees):
                i, j = t * OWN, (t + 1) * OWN
                key = np.concatenate([tokens[:, i : i + WIDE].copy().view(np.uint8), low[:, i + WIDE : j], low[:, j:], low[:, :i]], axis=1)
                whole, step = key.tobytes(), key.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), t, np.int32)), pa.array([whole[x : x + step] for x in range(0, len(whole), step)], pa.binary()), *rest],
                    ["tree", "path", *names],
                )

    return run


def followed(batches, leaf: int, agreeing: int):
    """For batches of sorted rows (tree, path, ...): the rows with `leaf` from before, and near pairs (i, j, agreeing hashes) with j in the batch."""
    before = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks().to_batches()
        if not rows:
            continue
        rows = rows[0]
        old = 0 if before is None else before.num_rows
        m = rows.num_rows
        tree = rows.column(0).to_numpy()
        path = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint8).reshape(m, -1)
        own = np.ascontiguousarray(path[:, : 4 * WIDE]).view(np.uint32)
        rest = np.ascontiguousarray(path[:, 4 * WIDE :])
        first = run_starts(tree, own[:, 0])
        end = np.repeat(np.append(first[1:], m), np.diff(np.append(first, m)))
        left, right, score = [], [], []
        at = np.arange(m)
        for step in range(1, leaf + 1):
            at = at[at + step < end[at]]
            if not len(at):
                break
            new = at[at + step >= old]
            for x, y in vec.chunks(np.full(len(new), rest.shape[1]), 8 << 20):
                i = new[x:y]
                same = (own[i] == own[i + step]).sum(axis=1) + (rest[i] == rest[i + step]).sum(axis=1)
                near = np.flatnonzero(same >= agreeing)
                left.append(i[near])
                right.append(i[near] + step)
                score.append(same[near])
        none = [np.zeros(0, np.int64)]
        yield rows, *(np.concatenate(none + x) for x in (left, right, score))
        before = rows.slice(max(0, m - leaf))


def best(leaf: int, agreeing: int):
    """Each row's nearest of those it is compared with; and whether the ends have more that are near."""

    def run(batches):
        for rows, i, j, score in followed(batches, leaf, agreeing):
            if not len(i):
                continue
            ends, others, scores = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([score, score])
            order = np.lexsort((others, -scores, ends))
            first = order[run_starts(ends[order])]
            more = np.bincount(ends, minlength=rows.num_rows) > 1
            a, b = np.minimum(ends[first], others[first]), np.maximum(ends[first], others[first])
            node = rows.column(2)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b)), pa.array(more[a]), pa.array(more[b])], ["x", "y", "mx", "my"])

    return run


def bridges(leaf: int, agreeing: int, percent: int):
    """Near pairs of different components whose bottom hashes allow for a link."""

    def run(batches):
        for rows, i, j, _ in followed(batches, leaf, agreeing):
            if len(i):
                root, size = rows.column(3).to_numpy(), rows.column(4).to_numpy()
                far = (root[i] != root[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
                i, j = i[far], j[far]
            if not len(i):
                continue
            low = [np.frombuffer(x, np.uint32) for x in rows.column(5).to_pylist()]
            keep = np.zeros(len(i), bool)
            for at, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                both = np.concatenate([low[x], low[y]])
                both.sort()
                twice = both[1:] == both[:-1]
                if size[x] <= BOTTOM and size[y] <= BOTTOM:
                    common = int(twice.sum())
                    keep[at] = 100 * common >= percent * (size[x] + size[y] - common)
                else:  # the BOTTOM least of the union
                    upto = min(BOTTOM, len(both) - int(twice.sum()))
                    distinct = np.cumsum(np.concatenate([[True], ~twice]))
                    common = int((twice & (distinct[1:] <= upto)).sum())
                    s = percent / 100
                    keep[at] = common >= upto * (s - SLACK * math.sqrt(s * (1 - s) / upto))
            node = rows.column(2)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(i[keep])), node.take(pa.array(j[keep]))], ["x", "y"])

    return run


def sorted_rows(df: DataFrame, trees: int, kinds: str, n_rows: int) -> DataFrame:
    """A row of df (sketch, node, ...) for each tree, in the order of the paths."""
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(n_rows // 4096, max(wide, n_rows // PART_ROWS)))
    order = ["tree", "path", "node"]
    return df.mapInArrow(paths(trees), f"tree int, path binary, {kinds}").repartitionByRange(parts, *order).sortWithinPartitions(*order)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm."""
    of_a, of_b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"m{x}")) for x in "ab")
    return swept(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "ma", "mb").mapInArrow(confirm(percent), "a long, b long"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id reachable over links (a, b), for every id that has one. links: saved rows.

    Large-star and small-star by turns: every node's larger, then its smaller, neighbours are hooked to the least one.
    Ends when a round changes nothing; the number of rounds grows with the logarithm of the longest path.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select("v", "u")) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hooked = both.join(least, "u")
        out = hooked.where("v > u" if large else "v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()

    parts = max(4, links.count() // LINK_ROWS)  # few links need few tasks, and each task's exchange files
    edges, before = links.select("a", "b").coalesce(parts), None
    for _ in range(rounds):
        edges = swept(star(star(edges, True).coalesce(parts), False).coalesce(parts))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) after more links: these join components, so only their roots are worked on."""
    of = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    ends = swept(ends.where("ra != rb"))
    above = components(swept(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())).select(F.col("id").alias("root"), F.col("root").alias("least"))
    moved = roots.join(above, "root", "left").select("id", F.coalesce("least", "root").alias("root"))
    return moved.union(above.select(F.col("root").alias("id"), F.col("least").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, recall: float = 0.9999, deep: int = 3, leaf: int = 256, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `carry`, n_shingles, component_id, kept, component of each row: links are pairs with 100 * intersection >= percent * union.

    component tells components apart, also those whose smallest doc_id is the same; it is null for a row that can have no link.
    """
    if not 0 < percent <= 100 or not 0 < recall < 1:
        raise ValueError("percent is 1 to 100, recall between 0 and 1")
    similarity = percent / 100
    trees = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**deep))) if percent < 100 else 1
    k = trees * OWN
    agreeing = math.floor(k * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / k)))
    kinds = dict(docs.dtypes)
    plain = id_and_text(docs, doc_id, text, carry)
    seen = swept(plain.mapInArrow(sketches(shingle, k, len(carry)), ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in carry), "n_shingles long, name binary, sketch binary"])))
    some = seen.where("doc_id IS NOT NULL AND name IS NOT NULL")
    reps = some.groupBy("name").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"))
    reps = swept(reps.select("sketch", F.monotonically_increasing_id().alias("node"), "name", "first"))
    found = sorted_rows(reps.select("sketch", "node"), trees, "node long", reps.count() * trees).mapInArrow(best(leaf, agreeing), "x long, y long, mx boolean, my boolean")
    forth = F.col("x") < F.col("y")
    one_way = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(forth, F.col("mx")).otherwise(F.col("my")).alias("ma"), F.when(forth, F.col("my")).otherwise(F.col("mx")).alias("mb"))
    pairs = swept(one_way.groupBy("a", "b").agg(F.bool_or("ma").alias("ma"), F.bool_or("mb").alias("mb")))
    ends = pairs.select(F.col("a").alias("node"), F.col("ma").alias("more")).union(pairs.select("b", "mb")).groupBy("node").agg(F.bool_or("more").alias("more"))
    ends = swept(ends.join(reps, "node"))
    texts = plain.join(ends.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.select("text").mapInArrow(full_sets(shingle), "name binary, members binary").groupBy("name").agg(F.first("members").alias("members"))
    sets = swept(sets.join(ends.select("node", "name"), "name").select("node", "members"))
    roots = components(confirmed(pairs.select("a", "b"), sets, percent))
    crowd = ends.where("more").select("sketch", "node").join(sets.select("node", (F.octet_length("members") / 8).cast("long").alias("n"), F.substring("members", 1, 8 * BOTTOM).alias("low")), "node")
    crowd = swept(crowd.join(roots, F.col("node") == F.col("id"), "left").select("sketch", "node", F.coalesce("root", "node").alias("root"), "n", "low"))
    n_crowd = crowd.count()
    if n_crowd:
        met = sorted_rows(crowd, trees, "node long, root long, n long, low binary", n_crowd * trees).mapInArrow(bridges(leaf, agreeing, percent), "x long, y long")
        more = swept(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            roots = swept(joined(roots, confirmed(more, sets, percent)))
    rooted = reps.select("node", "name", "first").join(roots, F.col("node") == F.col("id"), "left").select("name", "first", F.coalesce("root", "node").alias("component"))
    classes = rooted.join(rooted.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("name", "component_id", "component")
    linked = some.select("doc_id", *carry, "n_shingles", "name").join(classes, "name").select("doc_id", *carry, "n_shingles", "component_id", "component")
    alone = seen.where("doc_id IS NULL OR name IS NULL").select("doc_id", *carry, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.union(alone).select("doc_id", *carry, "n_shingles", "component_id", kept, "component")


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from .frames import table

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("component")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(least, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
