import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefold.llm import overlap_join
from tidefold.llm.overlap_join import NEAR, SKETCH, adjacent, allowed, asked_sets, differing, met, needed, overlap_components, parities, probed, shared, set_codes, short_lists, similar_sets, smallest, sorted_shingles, whole
from tidefold.llm.simhash import shingle_codes


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """rows (doc_id, text): every pair that shares a shingle is compared."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where.get(g, [])}:
            both = len(s & sets[j])
            if 100 * both >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
        for g in s:
            where.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(df, rows):
    got = sorted(map(tuple, overlap_components(df).collect()), key=repr)
    assert got == brute(rows)


def test_bounds():
    assert [needed(n, 80) for n in (1, 4, 5, 6, 10, 100)] == [1, 4, 4, 5, 8, 80]
    assert smallest(80) == 4
    rng = random.Random(1)
    for n in range(4, 60):  # any two sets at 0.8 or more meet in two short lists
        words = [str(rng.random()) for _ in range(n + 4)]
        other = words[:]
        other[rng.randrange(len(other))] += "x" if n > 45 else ""
        common = np.sort(shingle_codes(" ".join(words).encode(), 5)[:, 0])[::3]
        p, q = (shingle_codes(" ".join(w).encode(), 5) for w in (words, other))
        a, b = (set(short_lists(c, 80, common, np.arange(len(common)) + 2).tolist()) for c in (p, q))
        both = probed(p[:, 0], np.sort(q[:, 0]))
        if 100 * both >= 80 * (2 * n - both):
            assert len(a & b) >= 2


def test_met_loses_no_pair():
    rng = np.random.default_rng(2)
    for cells in (7, 1 << 20):
        size = np.sort(rng.integers(4, 30, 60))
        node, root = rng.permutation(60), rng.integers(0, 5, 60)
        got = [tuple(sorted(p)) for a, b in met(size, node, root, 80, cells) for p in zip(a.tolist(), b.tolist())]
        want = {tuple(sorted((int(node[i]), int(node[j])))) for i in range(60) for j in range(i) if root[i] != root[j] and 100 * size[j] >= 80 * size[i]}
        assert len(got) == len(set(got)) and set(got) == want


def test_given_documents(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_groups_chains_and_edge_cases(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(150):  # near copies, some on either side of 0.8
        words = base[:]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(80)] = f"v{rng.randrange(999)}"
        rows.append((i, " ".join(words)))
    for i in range(40):  # a chain: each is similar to the next one only
        rows.append((1000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 60))))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "a b c d e f g h"), (2006, "a b c d e f g h i"), (2007, "b " * 3000)]
    rows += [(2008, " ".join(f"l{k}" for k in range(20_000))), (2009, " ".join(f"l{k}" for k in range(2_000, 20_000)))]
    rows += [(5, "another text under a known id, of some length indeed")] * 2 + [(None, rows[0][1]), (None, "nobody knows the id of this one at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "size": F.lit(1), "component_id": F.lit(2)})
    check(df.repartition(7), rows)
    assert overlap_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("texts", [["a b c d e"] * 3, [None, ""], ["x"]])
def test_few_rows(spark, texts):
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_pairs_are_decided_by_their_sorted_shingles():
    sets = [(range(10), range(10)), (range(10), range(1, 11)), (range(10), range(2, 12)), (range(4), range(5)), (range(3), range(50))]
    x, y = (pa.array([np.array(p[k], np.uint64).tobytes() for p in sets], pa.binary()) for k in (0, 1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), x, y], names=["a", "b", "x", "y"])
    assert [b.column("a").to_pylist() for b in similar_sets(iter([batch]), 80)] == [[0, 1, 3]]


def near_copies(changes, n=300):
    """Codes of variants of one text with so many words changed, and rows of one list of them."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    codes = []
    for i in range(n):
        words = base[:]
        for k in range(changes):
            words[10 * k + rng.randrange(5)] = f"v{i}-{k}"
        codes.append(shingle_codes(" ".join(words).encode(), 5))
    sizes, nodes = pa.array([len(c) for c in codes]), pa.array(range(n))
    rows = [pa.array([7] * n), sizes, nodes, nodes, pa.array([parities(c) for c in codes])]
    return codes, pa.RecordBatch.from_arrays(rows, names=["token", "size", "node", "root", "sketch"])


def test_sketches_lose_no_similar_sets():
    rng = random.Random(5)
    for n in (4, 30, 400, 4000):
        words = [str(rng.random()) for _ in range(n)]
        for percent in (50, 80):
            for cut in range(0, n, max(1, n // 20)):
                p, q = (shingle_codes(" ".join(w).encode(), 5) for w in (words, words[cut:]))
                both = len(np.intersect1d(p[:, 0], q[:, 0]))
                x, y = (np.frombuffer(parities(c), np.uint64).reshape(1, SKETCH // 64) for c in (p, q))
                assert differing(x, y)[0] <= len(p) + len(q) - 2 * both
                if 100 * both >= percent * (len(p) + len(q) - both):
                    assert allowed(differing(x, y), len(p) + len(q), percent).all()


def test_near_copies_below_the_similarity_leave_no_pairs():
    _, far = near_copies(6)
    assert sum(b.num_rows for b in whole(iter([far]), 80)) == 0  # 44,850 pairs meet
    codes, near = near_copies(2, 60)
    got = {p for b in whole(iter([near.slice(0, 25), near.slice(25)]), 80) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
    assert got >= {(i, j) for j in range(60) for i in range(j) if 9 * len(np.intersect1d(codes[i][:, 0], codes[j][:, 0])) >= 4 * (len(codes[i]) + len(codes[j]))}
    assert len(got) == 60 * 59 // 2


def test_linear_rounds_give_one_partner_a_row():
    _, rows = near_copies(2)
    found = [list(zip(*(b.column(c).to_pylist() for c in ("node", "other")))) for b in adjacent((rows.slice(k, 70) for k in range(0, 300, 70)), 80)]
    pairs = [p for part in found for p in part]
    assert [a for a, _ in pairs] == list(range(1, 300)) and all(0 < a - b <= NEAR for a, b in pairs)


@pytest.mark.parametrize("step", [1, 2, 3, 20])
def test_lists_of_one_row_are_dropped(step):
    token = [1, 1, 2, 3, 3, 3, 4, 5, 6, 6]
    rows = pa.RecordBatch.from_arrays([pa.array(token), pa.array(range(10))], names=["token", "node"])
    got = [n for b in shared(rows.slice(k, step) for k in range(0, 10, step)) for n in b.column("node").to_pylist()]
    assert got == [0, 1, 3, 4, 5, 8, 9]


def test_shingles_are_not_shuffled_and_repeated_ids_give_one_row(spark):
    texts = [" ".join(f"w{i}{j}" for j in range(9)) for i in range(3)]
    rows = [(1, texts[0])] * 40 + [(1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0]), (2, None), (3, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    codes = [shingle_codes(t.encode(), 5) for t in texts]
    nodes = spark.createDataFrame([(10 + k, *set_codes(c), d) for k, (c, d) in enumerate(zip(codes, (1, 1, None)))], "node long, h1 long, h2 long, doc_id long")
    out = sorted_shingles(docs, nodes, 5)
    assert sorted(map(tuple, out.collect())) == [(10 + k, np.sort(c[:, 0]).tobytes()) for k, c in enumerate(codes)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_only_the_sets_of_pairs_are_shuffled(spark, monkeypatch):
    shingles = spark.range(1000).select(F.col("id").alias("node"), F.col("id").cast("string").cast("binary").alias("x"))
    pairs = spark.createDataFrame([(1, 5), (5, 9), (1, 9)], "a long, b long")
    for asked in (6, 5):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(overlap_join, "ASKED", asked)
        some = asked_sets(pairs, shingles)
        assert sorted(r.node for r in some.collect()) == [1, 5, 9]
    monkeypatch.setattr(overlap_join, "ASKED", 6)
    plan = asked_sets(pairs, shingles)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Range" in plan
