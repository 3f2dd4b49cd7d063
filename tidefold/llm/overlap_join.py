"""Similarity join on sets of shingles by T-occurrence search, after DivideSkip.

A set of n shingles that is similar to another shares T = ceil(similarity * n) of them at least. So its inverted lists
are divided: the T - 2 longest are set aside, and whoever shares T shingles is met in two of the others, the short
lists, or more often. The short lists are merged: postings meet by shingle, and pairs are counted over the lists; a pair
met fewer than twice is discarded. Survivors are decided by probing: the shingles of one, those of its long lists too,
are looked up by binary search among the sorted shingles of the other.

Which lists are long is an estimate from a bounded sample; it only decides an order, in which no link can be missed.

Documents with one set are one class. Lists with one class are dropped once, those that are left are a small part. Their
classes carry a sketch: for each of 1024 buckets, whether an odd number of the set's shingles falls there. Two sketches
differ in no more bits than the sets do in shingles, so who differs in too many is not similar: no link is lost, and
of near copies below the similarity few are left to be probed.

Linear rounds come first: within each short list, in another order each round, rows are compared with the NEAR before
them of other components, each class keeps the partner with the nearest sketch, and links are decided at once, so large
groups of near copies grow together. The last round is whole: all rows of each list that are still in different
components are compared, and the pairs that sizes and sketches allow are counted and decided. So no link between
components is lost, and none within one is needed.

Shuffles: short lists (a fifth of the shingles) once, texts once, to hash those of classes with lists left; then lists
that are left, and the shingles of pairs. Shingles are made where the texts have met, and are written from there. A list is one key; it is sorted and streamed in the linear rounds, and held by
one task, as numbers, in the last: there its rows outside of the largest component are compared with all of its rows.
Pairs that differ in little more than the limit, or sets far larger than the sketch, still leave a candidate each.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing, not with
each other. Fewer words than a shingle: the whole sequence is one. Repeated rows are linked and each get a row. A null
id takes part, but is no component's id unless all are null. Empty table: empty result. Other columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, ship, sweep, written
from .components import components
from .simhash import common_shingles, shared, shingle_codes
from .sketches import SKETCH, differing, parities

#: Short lists in which a pair must meet.
MEET = 2
#: Linear rounds before the whole one, and rows of a list that each row is compared with in them.
LINEAR_ROUNDS, NEAR = 3, 32
#: Pairs whose sketches are compared at once.
AT_ONCE = 1 << 15
#: Nodes of pairs that are broadcast; more are joined by a shuffle.
ASKED = 1 << 20


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any similar one."""
    return -(-percent * n // 100)


def short_lists(codes: np.ndarray, percent: int, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles whose lists are merged: all but the needed - MEET most frequent ones."""
    tokens = codes[:, 0]
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        order = np.lexsort((tokens, np.where(common[at] == tokens, often[at], 0)))
    else:
        order = np.argsort(tokens)
    return tokens[order[: len(tokens) - needed(len(tokens), percent) + MEET]].view(np.int64)


def set_codes(codes: np.ndarray) -> tuple[int, int]:
    """Two numbers that equal sets share: sums of independent hashes."""
    if not len(codes):
        return 0, 0
    x, y = codes.sum(axis=0, dtype=np.uint64).view(np.int64)
    return int(x), int(y)


def allowed(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes in sum that differ in so many shingles can be similar."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def probed(x: np.ndarray, y: np.ndarray) -> int:
    """How many of x's shingles binary search finds in y, which is sorted."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def scan(docs: DataFrame, shingle: int, percent: int, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, h1, h2, size, short, sketch); sets too small to be similar to others have no short lists and sketch"""
    least = smallest(percent)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for t in part.column(1).cast(pa.binary()):
                    codes = shingle_codes(t.as_py() or b"", shingle)
                    more = (short_lists(codes, percent, common, often), parities(codes)) if len(codes) >= least else ([], None)
                    rows.append((*set_codes(codes), len(codes), *more))
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                lists = pa.array([r[3] for r in rows], pa.list_(pa.int64()))
                sketches = pa.array([r[4] for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, lists, sketches], names=["doc_id", "h1", "h2", "size", "short", "sketch"])

    numbers = [T.StructField(c, T.LongType()) for c in ("h1", "h2", "size")]
    more = [T.StructField("short", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return docs.mapInArrow(of, T.StructType([docs.schema["doc_id"], *numbers, *more]))


def smallest(percent: int) -> int:
    """The size from which a set can be similar to a different one, and meets it in MEET lists."""
    n = MEET
    while 100 * n < percent * (n + 1):
        n += 1
    return n


NAMES = ("token", "size", "node", "root", "sketch")


def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES[:-1]]
    return [*numbers, np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)]


def adjacent(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows NAMES come sorted; each is compared with the NEAR before it, if of the same list and another component.
    (node, other, apart): the one of those that sizes and sketches allow whose sketch is nearest for its size."""
    last: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = columns(batch) if last is None else [np.concatenate(x) for x in zip(last, columns(batch))]
        first = 0 if last is None else len(last[0])
        token, size, node, root, sketch = rows
        best, other = np.full(len(token), 1 << 30), np.zeros(len(token), np.int64)
        at = np.arange(first, len(token))
        for k in range(1, NEAR + 1):
            at = at[at >= k]
            at = at[token[at] == token[at - k]]  # sorted: who differs k places away differs further away
            if not len(at):
                break
            x, y = size[at], size[at - k]
            rows_k = at[(root[at] != root[at - k]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))]
            for lo in range(0, len(rows_k), AT_ONCE):
                i = rows_k[lo : lo + AT_ONCE]
                apart, sizes = differing(sketch[i], sketch[i - k]), size[i] + size[i - k]
                ratio = np.where(allowed(apart, sizes, percent), 100_000 * apart // sizes, 1 << 30)
                i, ratio = (z[ratio < best[i]] for z in (i, ratio))
                best[i], other[i] = ratio, node[i - k]
        hit = np.flatnonzero(best < 1 << 30)
        yield pa.RecordBatch.from_arrays([pa.array(z[hit]) for z in (node, other, best)], names=["node", "other", "apart"])
        last = [z[-NEAR:] for z in rows]


def met(size: np.ndarray, node: np.ndarray, root: np.ndarray, percent: int, cells: int = 1 << 20, sketch: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list, sorted by size, of different components. The largest component's rows are met only from outside.
    With sketches only the pairs that these allow."""
    groups, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    if len(groups) == 1:
        return
    inside = which == counts.argmax()
    outside = np.flatnonzero(~inside)
    begins = np.searchsorted(100 * size, percent * size[outside], "left")
    ends = np.searchsorted(percent * size, 100 * size[outside], "right")
    lo = 0
    while lo < len(outside):
        hi = min(len(outside), lo + max(1, cells // len(node)))
        rows, others = outside[lo:hi], np.arange(begins[lo], ends[hi - 1])
        x, y = rows[:, None], others[None, :]
        ok = (y >= begins[lo:hi, None]) & (y < ends[lo:hi, None]) & (root[x] != root[y]) & (inside[y] | (y > x))
        i, j = np.nonzero(ok)
        i, j = rows[i], others[j]
        if sketch is not None:
            parts = [slice(k, k + AT_ONCE) for k in range(0, len(i), AT_ONCE)]
            near = [allowed(differing(sketch[i[p]], sketch[j[p]]), size[i[p]] + size[j[p]], percent) for p in parts]
            i, j = (z[np.concatenate(near)] if near else z for z in (i, j))
        yield node[i], node[j]
        lo = hi


def whole(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """All pairs of met() over the lists of rows NAMES, which come sorted by list and size."""
    def of(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token = rows[0]
        cuts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        ends = np.append(cuts[1:], len(token))
        mixed = np.minimum.reduceat(rows[3], cuts) != np.maximum.reduceat(rows[3], cuts)
        for lo, hi in zip(cuts[mixed].tolist(), ends[mixed].tolist()):
            yield from met(*(x[lo:hi] for x in rows[1:4]), percent, sketch=rows[4][lo:hi])

    def gathered(found: Iterator) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for x, y in found:
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            n += len(x)
            if n > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = columns(batch)
        first = int(np.searchsorted(new[0], new[0][-1]))  # the last list may go on in the next batch
        if first or (held and held[0][0][0] != new[0][0]):
            yield from gathered(of([np.concatenate(x) for x in zip(*held, [x[:first] for x in new])]))
            held = []
        held.append([x[first:] for x in new])
    if held:
        yield from gathered(of([np.concatenate(x) for x in zip(*held)]))


def similar_sets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b) whose sorted shingles x and y, as bytes, are similar."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            p, q = sorted((np.frombuffer(codes.as_buffer(), np.uint64) for codes in (x, y)), key=len)
            both = probed(p, q) if 100 * len(p) >= percent * len(q) else 0
            ok.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def sorted_shingles(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """docs (doc_id, text), nodes (node, h1, h2, doc_id) -> (node, x): a set's sorted shingles, as bytes.

    All texts under one id meet in one task, where the first with the set is taken. If Spark splits such a task, each
    part may give the same row; pairs then come repeatedly, which changes no component."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:  # of several texts under one id, those with this set
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found, got = [], []
                for node, h1, h2, text in zip(*(part.column(c).to_pylist() for c in ("node", "h1", "h2")), part.column("text").cast(pa.binary())):
                    if node in done:
                        continue
                    codes = shingle_codes(text.as_py(), shingle)
                    if set_codes(codes) == (h1, h2):
                        done.add(node)
                        found.append(node)
                        got.append(np.sort(codes[:, 0]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(got, pa.binary())], names=["node", "x"])

    ids = nodes.select("node", "h1", "h2", F.col("doc_id").alias("id")).hint("shuffle_hash")  # texts need no sorting
    found = docs.where(F.col("text").isNotNull()).join(ids, docs["doc_id"].eqNullSafe(ids["id"])).select("node", "h1", "h2", "text")
    return found.mapInArrow(own, "node long, x binary")


def asked_sets(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Those of shingles (node, x) that pairs (a, b) need: no others are shuffled, while the nodes are few enough to be broadcast."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return shingles.join(F.broadcast(asked) if 2 * pairs.count() <= ASKED else asked, "node", "left_semi")


def overlap_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of 100 * shared >= percent * union, a row for each row of docs."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    common, often = common_shingles(chosen, shingle)
    prints = written(scan(chosen, shingle, percent, common, often), "scanned-sets")
    spark, scanned = docs.sparkSession, prints
    same = [F.first(c).alias(c) for c in ("size", "short", "sketch")]  # equal sets have them alike
    classes = prints.where("size > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), *same)
    full = written(classes.withColumn("node", F.monotonically_increasing_id()), "shingle-sets")
    prints = written(scanned.select("doc_id", "h1", "h2", "size"), "scanned-sets")
    delete(spark, [scanned.scratch_path])  # its lists are in full, once for copies
    sets = written(full.select("node", "h1", "h2", "doc_id"), "shingle-sets")
    postings = full.select(F.explode("short").alias("token"), "node").repartition("token").sortWithinPartitions("token")
    postings = written(postings.mapInArrow(shared, "token long, node long"), "shared-postings")
    nodes = written(full.drop("short").join(postings.select("node").distinct(), "node", "left_semi"), "shared-sets")
    delete(spark, [full.scratch_path])
    sweep(spark, collect=True)

    shingles = written(sorted_shingles(chosen, nodes, shingle), "sorted-shingles")
    sweep(spark, collect=True)  # the shuffled texts go

    def decided(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of nodes whose sets are similar."""
        sweep(spark, collect=True)  # the lists that the pairs are from go, and the last round's sets
        some = asked_sets(pairs, shingles)
        both = pairs.join(some.withColumnRenamed("node", "a"), "a").join(some.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lambda b: similar_sets(b, percent), "a long, b long")

    def lists(roots: DataFrame | None, *order: Column | str) -> DataFrame:
        """Postings NAMES, each list whole and sorted in this order."""
        rows = nodes.select("size", "node", "sketch")
        rooted = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        dealt = postings.join(rooted, "node").select(*NAMES).repartition("token")
        return dealt.sortWithinPartitions("token", *order, "node")

    def joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
        known = links if roots is None else links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
        return written(components(known), "roots")

    roots = None
    for k in range(LINEAR_ROUNDS):
        order = ["size"] if k == 0 else [F.substring("sketch", 1 + 8 * k, 8)]
        near = lists(roots, *order).mapInArrow(lambda b: adjacent(b, percent), "node long, other long, apart long")
        best = near.groupBy("node").agg(F.min(F.struct("apart", "other")).alias("m")).select("node", "m.other")
        pairs = written(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "adjacent-candidates")
        links = written(decided(pairs), "adjacent-links")
        if links.isEmpty():
            break
        roots = joined(links, roots)
    met_often = lists(roots, "size").mapInArrow(lambda b: whole(b, percent), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("n"))
    more = written(met_often.where(F.col("n") >= MEET).select("a", "b"), "list-pairs")
    roots = joined(decided(more), roots)
    rooted = sets.select("h1", "h2", "node", F.col("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(rooted.join(least, "root").select("h1", "h2", "component_id"), "component-ids")
    have = prints.where("size > 0").select("doc_id", "h1", "h2", "size").join(ids, ["h1", "h2"])
    none = prints.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return have.select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(none)
