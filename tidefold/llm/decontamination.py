"""Benchmark decontamination by latent semantic retrieval.

Items of the benchmark give the vocabulary. Documents become sequences of term ids (one pass over the text, written to
the shared folder); passages of them form a TF-IDF matrix A over that vocabulary. A randomised SVD finds its leading
right singular vectors from one distributed product: each task adds up its part of (A'A)W for a random matrix W, the
parts are summed by term, and the driver finishes on matrices of vocabulary times rank (the single-pass method for
positive semidefinite A'A). The items are rows of the same collection, with as much weight as all passages.

Search: windows of three or more lengths slide over each document, so that every item fits one of them; windows are
projected by running sums and compared with the items by cosine. Words in many passages have no weight there, so a
second, exact way adds every window that holds as many of an item's rarest words as one that passes must; if all words
of an item are without weight, its cosine is 0. Candidates are verified on the sequences: the
longest common subsequence of item and window must hold ``min_lcs`` of the item's words in order, and
``min_answer`` of its last sentence, the answer. Paraphrases that keep most words are found, chance overlaps are not.

Bounds: texts are read once, with the vocabulary of all items, which is broadcast; items are then taken in blocks of at
most ``block_items``, each a search through the compact sequences. What else is broadcast or collected depends on a
block's vocabulary and the rank, never on the documents. No text is shuffled.

Defined results: null and empty texts have no words and no hits; items without words are never found. Repeated rows
with one doc_id give one row per item. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Marks that most words have at an end, and what is no letter or digit.
EDGES, MARKS = ".,;:!?\"'()", r"[^\pL\pN]+"
PASSAGE = 64
#: Term occurrences projected at once.
AT_ONCE = 16_384


def terms_of(chunks: pa.Array) -> pa.Array:
    """Chunks between white space in lower case, without all that is no letter or digit."""
    low = pc.utf8_trim(pc.utf8_lower(chunks), characters=EDGES)
    odd = pc.invert(pc.utf8_is_alnum(low))
    return pc.replace_with_mask(low, odd, pc.replace_substring_regex(low.filter(odd), pattern=MARKS, replacement=""))


@dataclass
class Items:
    ids: list
    terms: dict[str, int]
    words: list[np.ndarray]
    answers: list[np.ndarray]


def items_of(rows: list[tuple]) -> Items:
    terms: dict[str, int] = {}

    def coded(text: str) -> np.ndarray:
        found = [w for w in terms_of(pc.ascii_split_whitespace(pa.array([text])).flatten()).to_pylist() if w]
        return np.array([terms.setdefault(w, len(terms)) for w in found], np.int32)

    ids, words, answers = [], [], []
    for item_id, text in rows:
        if len(code := coded(text or "")):
            sentences = [s for s in map(coded, SENTENCE.split(text)) if len(s)]
            ids.append(item_id)
            words.append(code)
            answers.append(sentences[-1])
    return Items(ids, terms, words, answers)


def encode(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    """(doc_id, seq): the ids of a text's words, -1 for those that no item has, as 32-bit numbers."""
    known = pa.array(terms, pa.string())
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            words = pc.ascii_split_whitespace(pc.fill_null(part.column(1), ""))
            chunks = words.flatten().dictionary_encode()
            spelled = terms_of(chunks.dictionary)
            codes = pc.fill_null(pc.index_in(spelled, value_set=known), -1).to_numpy().astype(np.int32)
            codes[pc.equal(pc.binary_length(spelled), 0).to_numpy(zero_copy_only=False)] = -2
            seq = codes[chunks.indices.to_numpy()]
            offsets = np.asarray(words.offsets)
            ends = np.append(0, np.cumsum(seq > -2))[offsets - offsets[0]]
            buffers = [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(seq[seq > -2].tobytes())]
            rows = pa.Array.from_buffers(pa.binary(), len(part), buffers)
            yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["doc_id", "seq"])


def in_block(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sequences with the ids of a block: own has them by the ids of all items, and -1 at the end for all other words."""
    for batch in batches:
        rows = [own[seq].tobytes() for seq in sequences([batch])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "seq"])


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(batch.schema.names.index("seq")):
            yield np.frombuffer(x.as_py(), np.int32)


def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passage, term) of the vocabulary's occurrences, about AT_ONCE at a time, passages numbered from 0."""
    held_p, held_t, size, base = [], [], 0, 0
    for seq in sequences(batches):
        for lo in range(0, len(seq), PASSAGE * 256):
            at = np.flatnonzero(seq[lo : lo + PASSAGE * 256] >= 0)
            held_p.append(base + at // PASSAGE)
            held_t.append(seq[lo + at])
            base += ceil(min(len(seq) - lo, PASSAGE * 256) / PASSAGE)
            size += len(at)
            if size >= AT_ONCE:
                yield np.concatenate(held_p), np.concatenate(held_t)
                held_p, held_t, size, base = [], [], 0, 0
    if size:
        yield np.concatenate(held_p), np.concatenate(held_t)


def term_counts(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """Per term: passages that have it, and the sum of its squared counts in passages; last row (-1): all passages."""
    df, squares, count = np.zeros(terms, np.int64), np.zeros(terms, np.int64), 0

    def counted(stream):
        nonlocal count
        for batch in stream:
            for x in batch.column(1):
                count += ceil(len(x.as_py()) / 4 / PASSAGE)
            yield batch

    for p, t in passages(counted(batches)):
        pairs, tf = np.unique(p * terms + t, return_counts=True)
        df += np.bincount(pairs % terms, minlength=terms)
        squares += np.bincount(pairs % terms, weights=tf.astype(float) ** 2, minlength=terms).astype(np.int64)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], count)), pa.array(np.append(squares[at], 0))],
        names=["term", "df", "squares"],
    )


def grouped_sum(table: np.ndarray, codes: np.ndarray, groups: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """groups is sorted: the sums of table[codes] over each group. Groups are added up side by side, place by place; where
    only few go on, one after the other."""
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    counts = np.diff(np.append(starts, len(groups)))
    order = np.argsort(-counts, kind="stable")
    first, many = starts[order], -counts[order]
    sums = table[codes[first]]
    place = 1
    while (going := np.searchsorted(many, -place)) > few:
        sums[:going] += table[codes[first[:going] + place]]
        place += 1
    for k in range(going):
        sums[k] += table[codes[first[k] + place : first[k] - many[k]]].sum(axis=0)
    out = np.empty_like(sums)
    out[order] = sums
    return groups[starts], out


def sketch_part(batches: Iterator[pa.RecordBatch], weights: np.ndarray, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """This task's part of (A'A)W."""
    scaled = random_matrix(len(weights), width, seed) * weights[:, None]
    total = np.zeros((len(weights), width), np.float32)
    for p, t in passages(batches):
        keep = weights[t] > 0
        p, t = p[keep], t[keep]
        if not len(t):
            continue
        at, rows = grouped_sum(scaled, t, p)
        back = rows[np.searchsorted(at, p)] * weights[t][:, None]
        order = np.argsort(t, kind="stable")
        at, rows = grouped_sum(back, order, t[order])
        total[at] += rows
    at = np.flatnonzero(total.any(axis=1))
    for lo in range(0, len(at), 1000):
        part = at[lo : lo + 1000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array([total[k].tobytes() for k in part], pa.binary())], names=["term", "row"]
        )


def summed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sums rows by term; a task holds its share of the vocabulary."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for t, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total.setdefault(t, np.zeros(width))
            total[t] += np.frombuffer(row, np.float32)
    rows = [total[t].astype(np.float32).tobytes() for t in total]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], names=["term", "row"])


def random_matrix(rows: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((rows, width), dtype=np.float32)


def leading_vectors(product: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Eigenvectors of a positive semidefinite G from product = G @ test."""
    shift = 1e-6 * max(np.linalg.norm(product), 1e-12)
    shifted = product + shift * test
    inner = test.T @ shifted
    half = np.linalg.cholesky((inner + inner.T) / 2 + shift * np.eye(len(inner)))
    return np.linalg.svd(np.linalg.solve(half, shifted.T).T, full_matrices=False)[0][:, :rank]


def weighted_rows(items: Items, weights: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(items.ids), len(weights)), np.float32)
    for k, words in enumerate(items.words):
        np.add.at(rows[k], words, weights[words])
    return rows


@dataclass
class Latent:
    """What a task needs for the search: term vectors, items' unit vectors and sequences."""

    terms: np.ndarray  # rank numbers for each term, already weighted
    weights: np.ndarray
    items: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    mass: np.ndarray  # squared norm of each item
    df: np.ndarray  # passages that have a term


def bit_masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    return masks


def lcs(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the size words that have these masks."""
    row = full = (1 << size) - 1
    for w in text:
        if w in masks and (hit := row & masks[w]):
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def window_sizes(items: Items) -> dict[int, list[int]]:
    """Window length -> the items that fit it, wherever they lie: a window moves on by a quarter of its length."""
    sizes: dict[int, list[int]] = {}
    for k, words in enumerate(items.words):
        size = 12
        while len(words) > size * 3 // 4:
            size *= 2
        sizes.setdefault(size, []).append(k)
    return sizes


def candidates(seq: np.ndarray, latent: Latent, sizes: dict[int, list[int]], min_cosine: float) -> Iterator[tuple[int, int, int, float]]:
    """(item, start, end, cosine) of windows near an item. A window without a part of the smallest item's mass is passed over."""
    rare = np.flatnonzero((seq >= 0) & (latent.weights[np.maximum(seq, 0)] > 0))
    if not len(rare):
        return
    codes = seq[rare]
    squares = latent.weights[codes].astype(float) ** 2
    for size, own in sizes.items():
        # A window is four steps long; sums are made for steps first.
        step = size // 4
        steps = len(seq) // step + 4
        at = rare // step
        mass = np.cumsum(np.append(0.0, np.bincount(at, squares, steps)))
        own = np.array(own)
        held = np.flatnonzero(mass[4:] - mass[:-4] >= 0.3 * latent.mass[own].min())
        used = np.zeros(steps, bool)
        for k in range(4):
            used[held + k] = True
        keep = used[at]
        if not keep.any():
            continue
        found, sums = grouped_sum(latent.terms, codes[keep], at[keep])
        sums = np.vstack([sums, np.zeros((1, sums.shape[1]), np.float32)])
        row_of = np.full(steps, len(found))
        row_of[found] = np.arange(len(found))
        items = np.ascontiguousarray(latent.items[own].T)
        for k in range(0, len(held), 1024):
            windows = held[k : k + 1024]
            vectors = sum(sums[row_of[windows + j]] for j in range(4))
            norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-9)
            cosines = vectors @ items
            for row, col in zip(*np.nonzero(cosines >= min_cosine * norms[:, None])):
                start = int(windows[row]) * step
                yield int(own[col]), start, start + size, float(cosines[row, col] / norms[row])


@dataclass
class Rare:
    """The rarest words of items, term by term: entries starts[t] to starts[t + 1] are those of term t."""

    starts: np.ndarray
    item: np.ndarray
    times: np.ndarray  # how often the item's rare words have the term
    least: np.ndarray  # of each item: so many of its rare words are in every window that may pass


def rare_words(latent: Latent, own: list[int], min_lcs: float) -> Rare:
    """A window that holds min_lcs of an item's words lacks few: of any words, more than these few, it holds the rest."""
    entries, least = [], np.zeros(len(latent.words), np.int64)
    for k in own:
        words = latent.words[k]
        need = max(1, ceil(min_lcs * len(words) - 1e-9))
        least[k] = max(1, ceil(need / 3))
        order = np.lexsort((words, latent.df[words]))
        terms, times = np.unique(words[order[: len(words) - need + least[k]]], return_counts=True)
        entries += [(t, k, n) for t, n in zip(terms.tolist(), times.tolist())]
    term, item, times = np.array(sorted(entries), np.int64).reshape(-1, 3).T
    return Rare(np.searchsorted(term, np.arange(len(latent.df) + 1)), item, times, least)


def holding(seq: np.ndarray, size: int, rare: Rare) -> Iterator[tuple[int, int, int]]:
    """(item, start, end) of all windows that hold as many of an item's rare words as a window that passes must."""
    step, entries = size // 4, len(rare.item)
    at = np.flatnonzero(seq >= 0)
    codes = seq[at]
    many = rare.starts[codes + 1] - rare.starts[codes]
    at, codes, many = at[many > 0], codes[many > 0], many[many > 0]
    if not len(at):
        return
    offsets = np.cumsum(many) - many
    entry = np.arange(many.sum()) + np.repeat(rare.starts[codes] - offsets, many)
    held, counts = np.unique(np.repeat(at // step, many) * entries + entry, return_counts=True)
    steps, entry = held // entries, held % entries
    # An item is asked for in windows only where their four steps have enough of its words, repeated ones counted.
    items = len(rare.least)
    pair, place = np.unique(steps * items + rare.item[entry], return_inverse=True)
    sums = np.bincount(place, np.minimum(counts, rare.times[entry])).astype(np.int64)
    moved = np.concatenate([pair - k * items for k in range(4)])
    windows, place = np.unique(moved, return_inverse=True)
    enough = np.bincount(place, np.tile(sums, 4)) >= rare.least[windows % items]
    for w in windows[enough & (windows >= 0)].tolist():
        yield w % items, w // items * step, w // items * step + size


def cosine_of(latent: Latent, item: int, text: np.ndarray) -> float:
    vector = latent.terms[text[text >= 0]].sum(0)
    return float(vector @ latent.items[item] / max(np.linalg.norm(vector), 1e-9))


def search(
    batches: Iterator[pa.RecordBatch], latent: Latent, sizes: dict[int, list[int]], min_cosine: float, min_lcs: float, min_answer: float
) -> Iterator[pa.RecordBatch]:
    """Documents are searched together, parted by gaps that no window spans; a very long one has its own turn."""
    names = ["doc_id", "item", "cosine", "lcs", "answer"]
    gap = np.full(max(sizes), -1, np.int32)
    rare = {size: rare_words(latent, own, min_lcs) for size, own in sizes.items()}
    asked = [(bit_masks(w), len(w), bit_masks(a), len(a)) for w, a in zip(latent.words, latent.answers)]
    for batch in batches:
        seqs = list(sequences([batch]))
        out: list[list] = [[] for _ in names]
        row = 0
        while row < len(seqs):
            parts, begins, total = [], [], 0
            while row < len(seqs) and (not parts or total + len(seqs[row]) < AT_ONCE * 4):
                parts += [seqs[row], gap]
                begins.append(total)
                total += len(seqs[row]) + len(gap)
                row += 1
            joined = np.concatenate(parts)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            near = {(item, start, end): cosine for item, start, end, cosine in candidates(joined, latent, sizes, min_cosine)}
            for size, own in rare.items():
                near.update((x, None) for x in holding(joined, size, own) if x not in near)
            for (item, start, end), cosine in near.items():
                words, size, answer, answer_size = asked[item]
                doc = bisect_left(begins, end) - 1
                text = joined[start:end].tolist()
                share = lcs(words, size, text) / size
                if share >= min_lcs and (said := lcs(answer, answer_size, text) / answer_size) >= min_answer:
                    cosine = cosine_of(latent, item, joined[start:end]) if cosine is None else cosine
                    best[doc, item] = max(best.get((doc, item), (0.0, 0.0, 0.0)), (share, said, cosine))
            for (doc, item), (share, said, cosine) in best.items():
                for column, value in zip(out, (row - len(begins) + doc, item, cosine, share, said)):
                    column.append(value)
        docs = batch.column(0).take(pa.array(out[0], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [docs, pa.array(out[1], pa.int32()), *(pa.array(x, pa.float64()) for x in out[2:])], names=names
        )


def fit(encoded: DataFrame, items: Items, own: np.ndarray, rank: int, stop: float, seed: int) -> Latent:
    """The latent space of all passages and items; stop: terms in a larger share of passages have no weight."""
    terms = len(items.terms)
    counted = encoded.mapInArrow(lambda b: term_counts(in_block(b, own), terms), "term int, df long, squares long")
    rows = counted.groupBy("term").agg(F.sum("df"), F.sum("squares")).collect()  # a row per term of the vocabulary
    df, squares = np.zeros(terms + 1), np.zeros(terms + 1)
    for t, n, s in rows:
        df[t], squares[t] = n, s
    total, df, squares = df[-1], df[:-1], squares[:-1]
    weights = np.log((2.0 + total) / (1.0 + df)).astype(np.float32)
    if (df > max(stop * total, 50)).sum() < terms:
        weights[df > max(stop * total, 50)] = 0
    rank = min(rank, terms)
    width = min(rank + 16, terms)
    parts = encoded.mapInArrow(lambda b: sketch_part(in_block(b, own), weights, width, seed), "term int, row binary")
    parts = parts.repartition("term").mapInArrow(lambda b: summed(b, width), "term int, row binary")
    test = random_matrix(terms, width, seed).astype(float)
    product = np.zeros((terms, width))
    for t, row in parts.collect():  # vocabulary times width
        product[t] = np.frombuffer(row, np.float32)
    asked = weighted_rows(items, weights).astype(float)
    energy = (asked**2).sum()
    boost = max((weights.astype(float) ** 2 * squares).sum(), energy) / energy if energy else 1.0
    vectors = leading_vectors(product + boost * asked.T @ (asked @ test), test, rank).astype(np.float32)
    projected = asked.astype(np.float32) @ vectors
    norms = np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-9)
    return Latent(vectors * weights[:, None], weights, projected / norms, items.words, items.answers, (asked**2).sum(1), df)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rank: int = 128,
    stop: float = 0.01,
    min_cosine: float = 0.5,
    min_lcs: float = 0.7,
    min_answer: float = 0.6,
    block_items: int = 2000,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): documents that hold an item, one row per pair."""
    ship(docs.sparkSession)
    asked = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_field, item_field = chosen.schema["doc_id"], asked.schema["item_id"]
    found = asked.limit(block_items + 1).collect()
    n = 0 if len(found) <= block_items else ceil(1.2 * asked.count() / block_items)

    def blocks() -> Iterator[Items]:
        for k in range(max(n, 1)):
            rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n else found
            if (items := items_of(sorted(map(tuple, rows), key=repr))).ids:
                yield items

    # The vocabulary of all blocks, so that the texts are read once.
    terms: dict[str, int] = {}
    for items in blocks():
        for word in items.terms:
            terms.setdefault(word, len(terms))
    long_schema = T.StructType([id_field, T.StructField("seq", T.BinaryType())])
    sent_terms = docs.sparkSession.sparkContext.broadcast(list(terms))
    encoded = written(chosen.mapInArrow(lambda b: encode(b, sent_terms.value), long_schema), "term-sequences") if terms else None
    parts = []
    for items in blocks() if terms else ():
        own = np.full(len(terms) + 1, -1, np.int32)
        own[[terms[word] for word in items.terms]] = list(items.terms.values())
        latent, sizes = fit(encoded, items, own, rank, stop, seed), window_sizes(items)
        schema = T.StructType([id_field, T.StructField("item", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs", "answer"))])
        sent = docs.sparkSession.sparkContext.broadcast((own, latent, sizes))
        hits = encoded.mapInArrow(lambda b, s=sent: search(in_block(b, s.value[0]), *s.value[1:], min_cosine, min_lcs, min_answer), schema)
        names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), T.StructType([T.StructField("item", T.IntegerType()), item_field]))
        parts.append(hits.join(F.broadcast(names), "item"))
    if not parts:
        schema = T.StructType([id_field, item_field, *(T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs", "answer"))])
        return docs.sparkSession.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))
