"""SimHash near-duplicates, found with pivot distance tables.

Documents with one fingerprint form a class; everything below works on distinct fingerprints. For each of them the
Hamming distances to reference fingerprints are computed once. Two sorts of references are used:

* block references, the all-zero fingerprint and one for each of 32 two-bit blocks. The distance to a block reference
  minus the distance to zero tells how many bits the block has, and over all blocks these coordinates differ by no
  more in sum than the fingerprints do. Of four groups of eight coordinates, two at least must agree fully when at
  most two bits differ: pairs of groups are the keys on which candidates meet.
* scattered references, from a hash. A pair whose distances to one of them differ by more than max_bits cannot be
  near, whatever the key; the largest coordinate difference discards nearly all candidates.

Survivors are verified on the fingerprints themselves. A key that more than ``full`` fingerprints share is not
compared pair by pair: its members go through an exact linear way, in which everyone names the 65 fingerprints at
most one bit away, and two members name a common one just if at most two bits part them.

Shuffles: fingerprints and keys, never texts. Defined results: null and empty texts have fingerprint zero, linked
like any other. Repeated rows each get a row. A null doc_id takes part, but is no component's id unless all are null.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, ship, sweep, written
from .components import components
from .sketches import close_sketches, growing_parities

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER, LOWER)
GROUPS, BLOCKS, BLOCK_BITS = 4, 8, 2
SCATTERED = 16
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 14
#: Nodes whose texts are asked for that are broadcast; more are joined by a shuffle.
ASKED = 1 << 20


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits, each 1 if set in over half of the shingles' hashes."""
    words = text.translate(LOWERED).split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        part = hashes[k : k + AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = part.column(1).cast(pa.binary())
                got = pa.array([fingerprint(t.as_py() or b"", shingle) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), got], names=["doc_id", "fp"])

    return chosen.mapInArrow(of, T.StructType([chosen.schema["doc_id"], T.StructField("fp", T.LongType())]))


def scattered() -> list[int]:
    return [xxhash.xxh64_intdigest(f"pivot {k}".encode(), 0) for k in range(SCATTERED)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference)).cast("long")))


def distance_table(fps: DataFrame) -> DataFrame:
    """fps (fp) with the distances to scattered references, eight to a long, and keys: what each pair of groups has."""
    zero = distance(F.col("fp"), 0)
    groups = []
    for g in range(GROUPS):
        code = F.lit(0).cast("long")
        for b in range(BLOCKS):
            mask = ((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * (g * BLOCKS + b))
            bits = (zero + BLOCK_BITS - distance(F.col("fp"), mask)) / 2
            code = code * (BLOCK_BITS + 1) + bits.cast("long")
        groups.append(code)
    packed = []
    for k in range(0, SCATTERED, 8):
        code = F.lit(0).cast("long")
        for ref in scattered()[k : k + 8]:
            code = F.shiftleft(code, 8).bitwiseOR(distance(F.col("fp"), ref).cast("long"))
        packed.append(code.alias(f"far{k // 8}"))
    table = fps.select("fp", *packed, *[c.alias(f"g{i}") for i, c in enumerate(groups)])
    width = (BLOCK_BITS + 1) ** BLOCKS
    keys = [
        F.col(f"g{i}") * width + F.col(f"g{j}") + width * width * n for n, (i, j) in enumerate(combinations(range(GROUPS), 2))
    ]
    return table.select("fp", "far0", "far1", F.explode(F.array(*keys)).alias("key"))


def near_by_distances(max_bits: int) -> Column:
    """The largest difference of two rows' distances to the scattered references is max_bits at most."""
    ok = F.lit(True)
    for k in range(SCATTERED):
        name, shift = f"far{k // 8}", 8 * (7 - k % 8)
        x, y = (F.shiftright(F.col(f"{side}.{name}"), shift).bitwiseAND(F.lit(255)) for side in ("x", "y"))
        ok = ok & (F.abs(x - y) <= max_bits)
    return ok


def links(fps: DataFrame, max_bits: int = 2, full: int = 128) -> DataFrame:
    """(a, b): links whose components are those of all fingerprints at most max_bits apart."""
    if max_bits != 2:
        raise ValueError("four groups of blocks, and balls of one bit, are made for two bits")
    table = written(distance_table(fps), "pivot-distances")
    sizes = table.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(table.join(sizes, "key"), "pivot-shared")
    pairs = shared.where(F.col("n") <= full)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    found = (
        pairs.alias("x")
        .join(pairs.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near_by_distances(max_bits) & near)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    crowded = shared.where(F.col("n") > full).select("fp").distinct()
    steps = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)).cast("long") for k in range(64)])
    named = crowded.select("fp", F.explode(F.transform(steps, lambda s: F.col("fp").bitwiseXOR(s))).alias("point"))
    meets = named.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    around = named.join(meets, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return found.unionByName(around)


def simhash_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2, full: int = 128
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs."""
    prints = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), max_bits, full)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", fingerprint_text(), "component_id")


def fingerprint_text() -> Column:
    return F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")


def shingle_set(text: bytes, shingle: int) -> set[bytes]:
    words = text.translate(LOWERED).split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def shingle_codes(text: bytes, shingle: int) -> np.ndarray:
    """A 128-bit hash of each distinct shingle, as two numbers."""
    raw = b"".join(map(xxhash.xxh3_128_digest, shingle_set(text, shingle)))
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def long_fingerprint(codes: np.ndarray) -> tuple[int, int]:
    """128 bits in two halves, over the distinct shingles."""
    if not len(codes):
        return 0, 0
    counts = np.zeros(128, np.int64)
    for k in range(0, len(codes), AT_ONCE):
        counts += np.unpackbits(codes[k : k + AT_ONCE].view(np.uint8), axis=1).sum(0, np.int64)
    low, high = np.packbits(2 * counts > len(codes)).view(np.int64)
    return int(low), int(high)


def set_code(codes: np.ndarray) -> int:
    """The same for equal sets of shingles: the hashes' sum."""
    return int(codes[:, 1].sum(dtype=np.uint64).view(np.int64)) if len(codes) else 0


def prefix(codes: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles, rarest first, of which two sets of this similarity must share one: all but similarity * n, and one.

    Any order that all documents share is exact; common (sorted) and often only keep frequent shingles out of it."""
    tokens = codes[:, 0]
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        order = np.lexsort((tokens, np.where(common[at] == tokens, often[at], 0)))
    else:
        order = np.argsort(tokens)
    return tokens[order[: len(tokens) - ceil(similarity * len(tokens) - 1e-9) + 1]].view(np.int64)


def sampled_references(tables: int, bits: int) -> list[tuple[int, int]]:
    """Masks of so many bits, in turn of either half; a table compares fingerprints by their distances to the mask's
    single-bit references."""
    rng = np.random.default_rng(11)
    masks = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]
    return [(m, 0) if k % 2 else (0, m) for k, m in enumerate(masks)]


def neighbours(batches: Iterator[pa.RecordBatch], max_bits: int, near: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, high) come sorted; each is paired with the last one before it that is close enough, at most near
    places away and with the same key. Every row gives one pair at most, so a crowded place stays linear."""
    tail = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "high")]
        key, fp, high = (np.concatenate(x) for x in zip(tail, new))
        first = len(tail[0])
        rows = np.arange(first, len(key))
        found_a, found_b = [], []
        for k in range(1, near + 1):
            rows = rows[rows >= k]
            same = key[rows] == key[rows - k]
            rows = rows[same]  # sorted by key: who differs k places away differs further away
            if not len(rows):
                break
            other = rows - k
            apart = sum(np.bitwise_count((x[rows] ^ x[other]).view(np.uint64)).astype(int) for x in (fp, high))
            hit = (apart <= max_bits) & (fp[rows] != fp[other])
            found_a.append(fp[other[hit]])
            found_b.append(fp[rows[hit]])
            rows = rows[~hit]
        tail = [x[-near:] for x in (key, fp, high)]
        if found_a:
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def wide_candidates(classes: DataFrame, max_bits: int, tables: int, bits: int, near: int) -> DataFrame:
    """classes (fp, high) -> (a, b): pairs up to max_bits of 128 apart that agree on the references of some table and
    are neighbours there in the order of the other bits, which differs from table to table."""
    masks = F.array(*[F.struct(F.lit(_signed(x)).cast("long").alias("x"), F.lit(_signed(y)).cast("long").alias("y")) for x, y in sampled_references(tables, bits)])

    def place(m, k):
        turn = (k * 11) % 64
        return F.struct(
            F.xxhash64(k, F.col("fp").bitwiseAND(m["x"]), F.col("high").bitwiseAND(m["y"])).alias("key"),
            F.call_function("shiftleft", "fp", turn).bitwiseOR(F.call_function("shiftrightunsigned", "fp", F.lit(64) - turn)).alias("order"),
        )

    keyed = classes.select("fp", "high", F.inline(F.transform(masks, place)))
    dealt = keyed.repartition("key").sortWithinPartitions("key", "order", "fp")
    return dealt.select("key", "fp", "high").mapInArrow(lambda b: neighbours(b, max_bits, near), "a long, b long").distinct()


def similar(batches: Iterator[pa.RecordBatch], shingle: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x, y in zip(batch.column("x").cast(pa.binary()).to_pylist(), batch.column("y").cast(pa.binary()).to_pylist()):
            p, q = shingle_set(x, shingle), shingle_set(y, shingle)
            out.append(len(p & q) >= least * len(p | q))
        yield batch.select(["a", "b"]).filter(pa.array(out, pa.bool_()))


def common_shingles(docs: DataFrame, shingle: int, sample: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more of a sample of docs (doc_id, text) have, and how many have them. Only an order is made of them."""
    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < ceil(1_000_000 * sample / max(total, 1)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_codes(t.as_py() or b"", shingle)[:, 0].view(np.int64))], names=["h"])

    counts = some.select("text").mapInArrow(of, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    rows = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    common = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(common)
    return common[order], rows.column("n").to_numpy()[order]


def met(root: np.ndarray, node: np.ndarray, size: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the rows of one shingle, of different roots, that sizes and places allow to be similar if it is their first
    common one. The largest group is not compared with itself: rows outside of it are compared with all."""
    order = np.argsort(size, kind="stable")
    root, node, size, left = root[order], node[order], size[order], (size - at)[order]
    groups, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    outside = np.flatnonzero(which != counts.argmax())
    begins = np.searchsorted(size, size[outside] * similarity - 1e-6, "left")
    ends = np.searchsorted(size, size[outside] / similarity + 1e-6, "right")
    inside = which == counts.argmax()
    lo = 0
    while lo < len(outside):
        hi = lo + max(1, (1 << 21) // len(node))
        rows = outside[lo:hi]
        first, last = begins[lo], ends[min(hi, len(outside)) - 1]
        others = np.arange(first, last)
        x, y = rows[:, None], others[None, :]
        ok = (y >= begins[lo:hi, None]) & (y < ends[lo:hi, None]) & (root[x] != root[y]) & (inside[y] | (y > x))
        ok &= np.minimum(left[x], left[y]) >= similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6
        i, j = np.nonzero(ok)
        if len(i):
            yield node[rows[i]], node[others[j]]
        lo = hi


def meetings(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (token, root, node, size, at) come sorted by token; the rows of one may go over several batches."""
    names = ["token", "root", "node", "size", "at"]

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, root = rows[:2]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        ends = np.append(starts[1:], len(token))
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        found_a, found_b, size = [], [], 0
        for lo, hi in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            for a, b in met(*(x[lo:hi] for x in rows[1:]), similarity):
                found_a.append(np.minimum(a, b))
                found_b.append(np.maximum(a, b))
                size += len(a)
                if size > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_a, found_b)], names=["a", "b"])
                    found_a, found_b, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_a, found_b)], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(new[0]):
            continue
        first = int(np.searchsorted(new[0], new[0][-1]))  # where the last token begins
        if first or (held and held[0][0][0] != new[0][0]):
            yield from pairs([np.concatenate(x) for x in zip(*held, [x[:first] for x in new])])
            held = []
        held.append([x[first:] for x in new])
    if held:
        yield from pairs([np.concatenate(x) for x in zip(*held)])


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, node), sorted by token, those whose token another row has too."""
    last, repeated = None, False  # the row before this batch, not yet given out, and whether one before it has its token
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
        token = rows.column("token").to_numpy()
        same = token[1:] == token[:-1]
        ok = np.append(same, False) | np.append(repeated, same)
        yield from rows.slice(0, len(token) - 1).filter(pa.array(ok[:-1])).to_batches()
        last, repeated = rows.slice(len(token) - 1).to_batches()[0], bool(ok[-1])
    if repeated:
        yield last


def shared_postings(sets: DataFrame) -> DataFrame:
    """sets (node, prefix) -> (token, node, at): the shingles of prefixes that several nodes have, and their places."""
    rows = sets.select("node", F.posexplode("prefix").alias("at", "token")).select("token", "node", "at")
    dealt = rows.repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(shared, "token long, node long, at int")


def sharing(postings: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """postings (token, node, at), sets (node, size), roots (node, root) -> (a, b): nodes of different roots that share a
    posting and can be similar by size and place. No pair of this similarity and of different roots is missing."""
    rooted = sets.select("node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = postings.join(rooted, "node").repartition("token").sortWithinPartitions("token")
    return dealt.select("token", "root", "node", "size", "at").mapInArrow(lambda b: meetings(b, similarity), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    max_bits: int = 28,
    tables: int = 40,
    bits: int = 13,
    near: int = 32,
) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of documents whose sets of shingles have this Jaccard similarity.

    Rows with one set of shingles are one node. Candidates come in two rounds. Sketches of both sets discard nearly all
    that are not similar, and texts verify every pair that is left, so texts are shuffled for little more than links. The
    first round draws large groups together in linear time: fingerprints up to two of 64 bits apart, found as above, and, as a
    similarity near 0.8 parts fingerprints by ten bits and more, which distances to pivots cannot tell from chance,
    fingerprints with a second half that are neighbours in tables of sampled single-bit references. The second round is
    exact: sets of that similarity share one of the rarest shingles of each, and all those that do, that sizes and
    places allow to be similar and that are not yet in one group are compared. Shingles of one node alone are dropped
    before. Shuffles that are over are deleted at once, as a driver with a large heap would long keep them."""
    spark = docs.sparkSession
    ship(spark)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long = T.LongType()
    common, often = common_shingles(chosen, shingle)
    sweep(spark, collect=True)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                codes = [shingle_codes(t.as_py() or b"", shingle) for t in part.column(1).cast(pa.binary())]
                got = [(*long_fingerprint(c), set_code(c), len(c)) for c in codes]
                numbers = [pa.array([g[k] for g in got], pa.int64()) for k in range(4)]
                rare = pa.array([prefix(c, similarity, common, often) if len(c) else [] for c in codes], pa.list_(pa.int64()))
                sketches = pa.array([growing_parities(c) for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, rare, sketches], names=["doc_id", "fp", "high", "node", "size", "prefix", "sketch"])

    fields = [T.StructField(c, long) for c in ("fp", "high", "node", "size")]
    more = [T.StructField("prefix", T.ArrayType(long)), T.StructField("sketch", T.BinaryType())]
    schema = T.StructType([chosen.schema["doc_id"], *fields, *more])
    prints = written(chosen.mapInArrow(of, schema), "fingerprints")
    first = F.min(F.struct("doc_id", "fp", "high", "size", "prefix", "sketch")).alias("first")
    full = written(prints.groupBy("node").agg(first).select("node", "first.*"), "shingle-sets")
    whole, prints = prints, written(prints.select("doc_id", "fp", "node"), "fingerprints")
    delete(spark, [whole.scratch_path])  # its shingles are in full, once for copies
    sweep(spark, collect=True)
    postings = written(shared_postings(full), "shared-postings")
    sets = written(full.drop("prefix"), "shingle-sets")
    delete(spark, [full.scratch_path])
    sweep(spark, collect=True)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b) of nodes whose texts are similar."""
        sweep(spark, collect=True)  # what the pairs were made from goes
        sides = [sets.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), F.col("sketch").alias(x)) for c, x in (("a", "x"), ("b", "y"))]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb", "x", "y")
        close = written(both.mapInArrow(lambda b: close_sketches(b, similarity), "a long, b long"), "close-candidates")
        sweep(spark, collect=True)
        asked = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = sets.select("node", F.col("doc_id").alias("id")).join(asked, "node", "left_semi")
        ids = F.broadcast(ids) if 2 * close.count() <= ASKED else ids  # then no other texts are shuffled
        source = chosen.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("x"))
        found = source.join(ids, source["doc_id"].eqNullSafe(ids["id"])).select("node", "x")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # of several texts under one id, those with these shingles
                texts = batch.column("x").cast(pa.binary()).to_pylist()
                ok = [set_code(shingle_codes(t, shingle)) == node for t, node in zip(texts, batch.column("node").to_pylist())]
                yield batch.select(["node", "x"]).filter(pa.array(ok, pa.bool_()))

        texts = written(found.mapInArrow(own, "node long, x string").groupBy("node").agg(F.min("x").alias("x")), "candidate-texts")
        both = close.join(texts.withColumnRenamed("node", "a"), "a").join(texts.select(F.col("node").alias("b"), F.col("x").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(lambda b: similar(b, shingle, similarity), "a long, b long")

    # Of the nodes with one fingerprint the first stands for all; it is a candidate with each of the others.
    classes = sets.groupBy("fp").agg(F.min(F.struct("node", "high")).alias("first")).select("fp", "first.node", "first.high")
    classes = written(classes, "fingerprint-classes")
    near_fps = links(classes.select("fp")).unionByName(wide_candidates(classes.select("fp", "high"), max_bits, tables, bits, near)).distinct()
    node_of = classes.select(F.col("fp").alias("a"), F.col("node").alias("x"))
    found = near_fps.join(node_of, "a").join(node_of.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").select("x", "y")
    same = sets.select("fp", F.col("node").alias("y")).join(classes.select("fp", F.col("node").alias("x")), "fp").where("x <> y")
    pairs = written(found.unionByName(same.select("x", "y")).select(F.col("x").alias("a"), F.col("y").alias("b")), "near-candidates")
    roots = written(components(verified(pairs)), "first-round")
    more = written(sharing(postings, sets, roots, similarity), "sharing-candidates")
    every = verified(more).unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
    roots = components(every)
    rooted = sets.select("node", F.col("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(least, "root").select("node", "component_id")
    return prints.join(ids, "node").select("doc_id", fingerprint_text(), "component_id")
