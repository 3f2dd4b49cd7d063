"""Language identification with bit-sliced Bloom filters over letter n-grams.

One table holds the filters of all languages: a slot is a bit mask with one bit for each language, so k lookups and a
bitwise AND give all languages that contain an n-gram. The bits are counted per language over a text's n-grams; a
count is corrected for the false positives that the language's own fill of the table predicts, and the largest
corrected share decides. The score is that share among all languages' shares.

Learning: n-grams are counted over a bounded sample of labelled rows (``fit_rows`` per language, chosen by a hash of
the row), in Spark; each language keeps its ``grams`` most frequent ones. Prediction reads only the text, all of it,
in parts of which each brings the n-grams that reach into it from the one before.

Defined results: texts that are null or have no letters are ``und`` with score 0; so is everything if nothing can be
learned. Texts with no known n-gram get the first language in alphabetical order, score 0. Repeated rows each get the
same result; empty tables give empty results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

SIZES = (3, 4)
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
HASHES = 4
#: Characters that are looked at together.
AT_ONCE = 1 << 18

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: 2 a letter, 1 a mark, which may be part of a word, 0 anything else."""
    if not _kinds:
        _kinds.append(np.array(["ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)], np.uint8))
    return _kinds[0]


def codes_of(text: str) -> Iterator[np.ndarray]:
    """Code points in lower case, in parts; every run of other characters is one 0, with one at both ends."""
    yield np.zeros(1, np.uint64)
    last = 0
    for lo in range(0, len(text), AT_ONCE):
        codes = np.frombuffer(text[lo : lo + AT_ONCE].lower().encode("utf-32-le", "replace"), "<u4")
        codes = np.where(kinds()[codes], codes, 0).astype(np.uint64)
        codes = codes[(codes != 0) | (np.append(last, codes[:-1]) != 0)]
        if len(codes):
            last = codes[-1]
            yield codes
    if last:
        yield np.zeros(1, np.uint64)


def has_letter(codes: np.ndarray) -> bool:
    return bool((kinds()[codes.astype(np.int64)] == 2).any())


def grams_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams: letters of one word, with a 0 for its beginning or end."""
    end = len(codes) - n + 1
    if end < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, inner = np.full(end, n, np.uint64), np.ones(end, bool)
        for k in range(n):
            part = codes[k : k + end]
            h = (h ^ part) * np.uint64(MIX[k])
            h ^= h >> np.uint64(29)
            if 0 < k < n - 1:
                inner &= part != 0
    return h[inner]


def text_grams(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """(hashes of n-grams, whether there are letters) of a text's parts; what lies across two parts comes with the second."""
    before = np.zeros(0, np.uint64)
    for codes in codes_of(text):
        joined = {n: np.concatenate([before[len(before) - min(n - 1, len(before)) :], codes]) for n in SIZES}
        yield np.concatenate([grams_of(joined[n], n) for n in SIZES]), has_letter(codes)
        before = joined[max(SIZES)][-max(SIZES) + 1 :]


def places(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        step = (grams * np.uint64(MIX[1])) | np.uint64(1)
        return [((grams + np.uint64(k) * step) >> np.uint64(17)) & np.uint64(slots - 1) for k in range(HASHES)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # slots x planes of 64 languages
    false_positive: np.ndarray  # per language


def build(languages: list[str], grams: list[tuple[int, str]], slots: int) -> Model:
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    number = {name: k for k, name in enumerate(languages)}
    codes = np.array([g & (1 << 64) - 1 for g, _ in grams], np.uint64)
    of = np.array([number[x] for _, x in grams], np.int64)
    for k in range(len(languages)):
        for at in places(codes[of == k], slots):
            table[at, k // 64] |= np.uint64(1 << k % 64)
    fill = [np.count_nonzero(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / slots for k in range(len(languages))]
    return Model(languages, table, np.array(fill) ** HASHES)


def predict(text: str | None, model: Model) -> tuple[str, float]:
    count, hits, lettered = 0, np.zeros(len(model.languages)), False
    for grams, letters in text_grams(text or ""):
        lettered = lettered or letters
        count += len(grams)
        if not len(grams):
            continue
        masks = None
        for at in places(grams, len(model.table)):
            masks = model.table[at] if masks is None else masks & model.table[at]
        for k in range(len(hits)):
            hits[k] += np.count_nonzero(masks[:, k // 64] & np.uint64(1 << k % 64))
    if not lettered or not model.languages:
        return "und", 0.0
    share = np.maximum(hits - count * model.false_positive, 0) / (1 - np.minimum(model.false_positive, 0.999)) / max(count, 1)
    best = int(share.argmax())
    return model.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): summed within a batch."""
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).extend(grams for grams, _ in text_grams(text or ""))
        for lang, found in by_lang.items():
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
            )


def fit(labelled: DataFrame, doc_id: str, text: str, lang: str, fit_rows: int, grams: int, slots: int) -> Model:
    rows = labelled.select(F.col(doc_id).alias("row"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, fit_rows / n))])
    # By row and text, so that a text in very many rows is no larger part of the sample than of the table.
    sampled = rows.where(F.pmod(F.xxhash64("row", "text"), F.lit(1_000_000)) < F.element_at(rate, F.col("lang")) * 1_000_000)
    counts = sampled.select("lang", "text").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The most frequent n-grams of each language: first within parts of it, then of those.
    part = W.partitionBy("lang", "part").orderBy(F.desc("n"), "gram")
    first = counts.withColumn("part", F.pmod("gram", F.lit(64))).withColumn("k", F.row_number().over(part)).where(F.col("k") <= grams)
    whole = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = first.withColumn("k", F.row_number().over(whole)).where(F.col("k") <= grams).select("gram", "lang").collect()
    return build(sorted(sizes), [tuple(r) for r in kept], slots)  # grams * languages rows


def identify(
    docs: DataFrame,
    held_out: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    fit_rows: int = 5000,
    grams: int = 2000,
    slots: int = 1 << 20,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs. Rows that are held out teach nothing."""
    ship(docs.sparkSession)
    model = fit(docs.where(~held_out), doc_id, text, lang, fit_rows, grams, slots)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [predict(t.as_py(), sent.value) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    schema = T.StructType([
        chosen.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])
    return chosen.mapInArrow(of, schema)
