import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm.decontamination import bit_masks, contaminated, grouped_sum, lcs, leading_vectors, random_matrix


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a = np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 70))])
        b = np.array([rng.randint(-1, 6) for _ in range(rng.randint(0, 90))], int)
        assert lcs(bit_masks(a), len(a), b.tolist()) == lcs_table(a.tolist(), b.tolist())


def test_leading_vectors_span_those_of_an_exact_svd():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((300, 8)) @ rng.standard_normal((8, 50)) + 1e-3 * rng.standard_normal((300, 50))
    test = random_matrix(50, 16, 1).astype(float)
    got = leading_vectors(a.T @ a @ test, test, 8)
    exact = np.linalg.svd(a)[2][:8].T
    assert np.linalg.svd(got.T @ exact)[1].min() > 0.999


def test_grouped_sums():
    rng = np.random.default_rng(3)
    table = rng.standard_normal((40, 5))
    for sizes in ([1], [3, 1, 200, 2], [1] * 50, rng.integers(1, 60, 90).tolist()):
        groups, codes = np.repeat(np.arange(len(sizes)) * 3, sizes), rng.integers(0, 40, sum(sizes))
        at, got = grouped_sum(table, codes, groups)
        assert at.tolist() == [3 * k for k in range(len(sizes))]
        assert np.allclose(got, [table[codes[groups == g]].sum(0) for g in at])


ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string, item_id string, seq int"


def words(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ru", "te", "so", "pa", "ne"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("block", [2000, 7])
def test_planted_items_and_paraphrases(spark, block):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(15, 50)).capitalize() + ". " + words(rng, 4) + ".") for i in range(25)] + [(90, None), (91, " ... ")]
    docs, want = [], set()
    for d in range(120):
        parts = [words(rng, rng.choice([0, 5, 80, 400]))]
        if d % 3 == 0:
            item, text = items[rng.randrange(25)]
            w = text.split()
            if d % 2:  # a paraphrase: every eighth word another, upper case, marks
                w = [x.upper() + "!!" if k % 8 else "other" for k, x in enumerate(w)]
            parts += [" ".join(w), words(rng, 60)]
            want.add((d, item))
        docs.append((d, "\n".join(parts), "x", 1))
    docs += [(500, None, None, 1), (501, "", None, 1), docs[0]]
    hits = contaminated(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_items=block)
    assert sorted((r.doc_id, r.item_id) for r in hits.collect()) == sorted(want)


def test_frequent_items(spark):
    rng = random.Random(9)
    item = words(rng, 30).capitalize() + ". " + words(rng, 4) + "."
    docs = [(d, words(rng, 80) + (" " + item + " " + words(rng, 20) if d % 3 == 0 else ""), "x", 1) for d in range(300)]
    others = [(2, "zuvo zuvi zavu zevo. zova zuve."), (3, "zuvo.")]
    hits = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item), *others], ITEMS))
    assert sorted((r.doc_id, r.item_id) for r in hits.collect()) == [(d, 1) for d in range(0, 300, 3)]


@pytest.mark.parametrize("share", [1, 50, 300])
def test_an_item_in_all_some_or_one_of_the_documents(spark, share):
    """However widely an item leaked, every document with it is found, and an item of common words too."""
    rng = random.Random(share)
    item, common = words(rng, 40) + ". " + words(rng, 5) + ".", " ".join(["lo", "mi", "te", "so"] * 6) + ". pa ne."
    docs = [(d, words(rng, 300) + (" " + item if d % share == 0 else "") + " " + (common if d == 7 else "") + " " + words(rng, 90), "x", 1) for d in range(300)]
    hits = contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item), (2, common)], ITEMS))
    got = {(r.doc_id, r.item_id) for r in hits.collect()}
    assert {d for d, i in got if i == 1} == set(range(0, 300, share)) and (7, 2) in got


def test_paraphrases_at_two_sizes_against_all_pairs(spark):
    """All pairs of item and document: those whose best stretch of document has 0.7 of the item's words in order."""
    for n, seed in ((40, 1), (400, 2)):
        rng = random.Random(seed)
        items = [(i, words(rng, 25) + ". " + words(rng, 5) + ".") for i in range(20)]
        docs, want = [], set()
        for d in range(n):
            item = rng.randrange(20)
            kept = [w for w in items[item][1].split() if rng.random() < rng.choice([0.5, 0.75, 0.95])]
            docs.append((d, " ".join([words(rng, 100), *kept, words(rng, 60)]), "x", 1))
        coded = lambda t: re.findall(r"[^\W_]+", t.lower())
        for d, text, _, _ in docs:
            doc = coded(text)
            for i, asked in items:
                w, answer = coded(asked), coded(asked.split(". ")[1])
                spans = [doc[k : k + len(w)] for k in range(0, len(doc), 5)]
                if any(lcs_table(w, x) >= 0.7 * len(w) and lcs_table(answer, x) >= 0.6 * len(answer) for x in spans):
                    want.add((d, i))
        got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
        assert len(want) > n // 4 and want <= got and len(got - want) < 0.05 * n


def test_short_items_against_brute_force(spark):
    rng = random.Random(12)
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n - 1)) + f". end{n}.") for n in range(2, 15)]
    docs = [(n, " ".join([words(rng, 200), text, words(rng, 100 + n)]), "x", 1) for n, text in items]
    filler = [(100, " ".join(sorted({w for _, t in items for w in t.split()}, key=lambda w: rng.random())), "x", 1)]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs + filler, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert {x for x in got if x[0] < 100} == {(n, n) for n, _ in items}


def test_given_documents_against_all_five_grams(spark, sf_small):
    docs, bench = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    for r in docs.collect():
        have = set(zip(*(norm(r.text)[k:] for k in range(5))))
        for item, w in items:
            grams = list(zip(*(w[k:] for k in range(5))))
            if sum(g in have for g in grams) >= 0.8 * len(grams):
                want.add((r.doc_id, item))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == want and want


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b c d e f g. h i")], ITEMS)
    assert contaminated(docs, items).collect() == []
    assert contaminated(docs, one).collect() == []
    assert contaminated(one.select(F.col("item_id").alias("doc_id"), "text"), items).collect() == []
