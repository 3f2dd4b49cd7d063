import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidefold.llm.simhash import shared_postings, shingle_codes, shingle_set
from tidefold.llm.sketches import SKETCH, close_sketches, folded, growing_parities, parities


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)).encode()


def test_halves_of_a_sketch_make_that_of_half_the_buckets():
    rng = random.Random(1)
    for n in (0, 1, 5, 511, 516, 517, 3000):
        codes = shingle_codes(text(rng, n), 5)
        sketch = growing_parities(codes)
        assert 8 * len(sketch) >= max(SKETCH, 2 * len(codes))
        assert folded(sketch, SKETCH // 8).tobytes() == parities(codes)


def test_sketches_lose_no_similar_pair_and_discard_others():
    rng = random.Random(2)
    pairs, alike = [], []
    for n in (6, 30, 200, 515, 900, 4000):
        for part in (0.0, 0.005, 0.01, 0.02, 0.03, 0.2, 1.0):
            x = text(rng, n).split()
            y = [w if rng.random() >= part else b"other" + str(k).encode() for k, w in enumerate(x)] + x[: rng.choice([0, n // 8])]
            p, q = (shingle_set(b" ".join(z), 5) for z in (x, y))
            alike.append(len(p & q) / len(p | q))
            pairs.append([shingle_codes(b" ".join(z), 5) for z in (x, y)])
    pairs.append([np.zeros((0, 2), np.uint64)] * 2)
    k = pa.array(range(len(pairs)))
    sizes = [pa.array([len(p[i]) for p in pairs]) for i in (0, 1)]
    sketches = [pa.array([growing_parities(p[i]) for p in pairs], pa.binary()) for i in (0, 1)]
    batch = pa.RecordBatch.from_arrays([k, k, *sizes, *sketches], names=["a", "b", "sa", "sb", "x", "y"])
    left = {a for out in close_sketches(iter([batch, batch.slice(0, 0)]), 0.8) for a in out.column("a").to_pylist()}
    must = {i for i, j in enumerate(alike) if j >= 0.8}
    assert len(must) > 10 and must <= left
    assert not {i for i, j in enumerate(alike) if j < 0.7} & left


def test_postings_of_one_node_go(spark):
    rng = random.Random(3)
    sets = [(node, rng.sample(range(300), rng.randint(0, 12))) for node in range(60)]
    df = spark.createDataFrame(sets, "node long, prefix array<long>").repartition(3)
    every = [(token, node, at) for node, prefix in sets for at, token in enumerate(prefix)]
    often = {token for token, *_ in every if sum(token == t for t, *_ in every) > 1}
    got = shared_postings(df).select("token", "node", F.col("at").cast("long")).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in every if r[0] in often)
