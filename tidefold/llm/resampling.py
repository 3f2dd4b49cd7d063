"""Importance resampling: documents are drawn that look like a target collection, by hashed n-gram features.

Separators of a text collapse to single spaces, and one overlapped regex scan starts a match at every word: its groups
are the spans of the one, two and three words from there on, whose CRC-32 names a bucket. Scanned once, a document keeps
its buckets as a sorted list of differences, about a byte for each feature; counts of the corpus and of the target, a
number for each bucket, make gains, and a second pass over the lists sums them. Documents are then drawn without
replacement by the largest of weight plus Gumbel noise, which a hash of the id gives.

Scale: the scan and both sums are map-side; a task sends one row for each bucket. The ranking is a range-partitioned
sort of those rows alone that can be drawn. The driver holds two numbers for each bucket.

Defined results: null texts and texts without words have no features, weight 0 and a score, and are never drawn (with a
positive min_words). Repeated rows each count and each get a row; of equal scores the smaller id goes first, of equal
ids as well any. A null id hashes as an empty one and sorts first. An empty target gives every bucket the gain of zero
counts; an empty table an empty result. Columns other than the id and the text are not looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from operator import methodcaller
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.operators.exports import with_ordered_index

from .common import ship, written

BUCKETS = 10_000
#: Bytes that words consist of; all others separate. A-Z become a-z first.
WORD = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b in WORD else 32 for b in range(256))
SPANS = methodcaller("group", 1, 2, 3)


def scanner(words: int = 3):
    """A pattern that matches at the space before each word; its groups are the runs of words to 1 words from there on.

    Quantifiers are possessive, so a run ends at a boundary only, and a run cut short by the text's end repeats the one
    before it."""
    import regex

    run = rb"([^ ]++)"
    for _ in range(words - 1):
        run = rb"(" + run + rb"(?: [^ ]++)?+)"
    return regex.compile(rb" " + run + rb"(?![^ ])")


def features(text: bytes, pattern) -> tuple[int, np.ndarray]:
    """How many words a text has, and the CRC-32 of every run of 1 to 3 of them."""
    spaced = b" " + b" ".join(text.translate(SPACED).split())
    found = map(crc32, chain.from_iterable(map(SPANS, pattern.finditer(spaced, overlapped=True))))
    codes = np.fromiter(found, np.uint32)
    words = len(codes) // 3
    keep = np.ones(len(codes), bool)
    if words:
        keep[-3] = False  # three words from the last one on
        keep[-2] = False
        if words > 1:
            keep[-6] = False  # three words from the last but one
    return words, codes[keep]


def scan(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, steps): steps are the differences of the sorted buckets, two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit in two bytes")
    ship(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = scanner()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                words, counts, steps = [], [], []
                for t in part.column(1).cast(pa.binary()):
                    n, codes = features(t.as_py() or b"", pattern)
                    words.append(n)
                    counts.append(len(codes))
                    steps.append(np.diff(np.sort((codes % buckets).astype(np.uint16)), prepend=np.uint16(0)).tobytes())
                numbers = [pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(steps, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers], names=["doc_id", "n_words", "n_features", "steps"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    numbers = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType())]
    return chosen.mapInArrow(of, T.StructType([chosen.schema["doc_id"], *numbers, T.StructField("steps", T.BinaryType())]))


def bucket_counts(scanned: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket; a task sends a row for each bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for steps in batch.column(0):
                total += np.bincount(np.cumsum(np.frombuffer(steps.as_py(), np.uint16), dtype=np.int64), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    rows = scanned.select("steps").mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """For each bucket 1000 times the logarithm of how much more often, with one added, the target has it; floors."""
    k = len(corpus)
    all_corpus, all_target = float(sum(corpus) + k), float(sum(target) + k)
    return [math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus, target)]


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel number from a hash of seed and id; floor."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(scanned: DataFrame, gain: list[int]) -> DataFrame:
    """scanned with weight, the sum of its features' gains, instead of steps."""
    values = np.array(gain, np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [np.frombuffer(s.as_py(), np.uint16) for s in batch.column("steps")]
            weight = [int(values[np.cumsum(s, dtype=np.int64)].sum()) for s in steps]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return scanned.mapInArrow(of, T.StructType([*scanned.schema.fields[:3], T.StructField("weight", T.LongType())]))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): rank 1, 2, 3 ... of the drawn rows, null of the others.

    Drawn are percent of the rows with min_words words or more, rounded down."""
    scanned = written(scan(docs, doc_id, text, buckets), "features")
    own = bucket_counts(scanned, buckets)
    wanted = bucket_counts(scan(target.withColumn(target_text, F.col(target_text)), target_text, target_text, buckets), buckets)
    scored = weighed(scanned, gains(own, wanted)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("_last", -F.col("score")), "scored")
    can = F.col("n_words") >= min_words
    most = scored.where(can).count() * percent // 100
    ranked = with_ordered_index(scored.where(can), ["_last", "doc_id"], "_place", 1)
    out = ranked.withColumn("rank", F.when(F.col("_place") <= most, F.col("_place").cast("long")))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return out.select(*columns).unionByName(scored.where(~can).withColumn("rank", F.lit(None).cast("long")).select(*columns))
