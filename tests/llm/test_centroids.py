import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidefold.llm.centroids import cluster, nearest


def brute(rows, dims, k=8, rounds=10):
    """rows (vec_id, vector), plain loops over all distances."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, w) in zip(kept, got) if w == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    inertia = [sum(d for d, j in got if j == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, j, d, inertia[j], sum(inertia), sha[j]) for (i, _), (d, j) in zip(kept, got)], key=repr)


@pytest.mark.parametrize("k,dims", [(1, 3), (2, 1), (8, 64), (17, 5)])
def test_nearest_equals_all_distances(k, dims):
    rng = np.random.default_rng(k)
    for spread in (2, 10, 100_000):  # small values make ties
        v, c = rng.integers(-spread, spread, (500, dims)), rng.integers(-spread, spread, (k, dims))
        all_distances = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        who, best = nearest(v, c)
        assert (who == all_distances.argmin(axis=1)).all() and (best == all_distances.min(axis=1)).all()
    assert len(nearest(v[:0], c)[0]) == 0


def test_given_vectors(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, cluster(df.repartition(3)).collect()), key=repr) == brute(rows, 64)


def test_edge_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 0.2, 4)]) for i in range(60)]
    rows += [(7, [1.0, 2.0, 3.0, 4.0])] * 3 + [(None, [0.0, -0.5, 0.0005, -0.0005])]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, 3.0]), (103, [1.0, None, 2.0, 3.0]), (104, [1.0, 2.0, float("nan"), 3.0]), (105, [1.0, 2.0, float("-inf"), 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cluster": F.lit("x"), "v": F.lit(1), "distance": F.lit(None)})
    out = cluster(df, dims=4, rounds=5)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows, 4, rounds=5)
    few = df.where("vec_id < 3")
    assert sorted(map(tuple, cluster(few, dims=4).collect()), key=repr) == brute(rows[:3], 4)
    assert cluster(df.limit(0), dims=4).collect() == []
    same = [(i, [1.0] * 4) for i in range(20)]
    assert sorted(map(tuple, cluster(spark.createDataFrame(same, "vec_id long, embedding array<float>"), dims=4).collect()), key=repr) == brute(same, 4)


def test_components_beyond_the_limit_fail(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(PySparkException, match="beyond"):
        cluster(df, dims=4).collect()
