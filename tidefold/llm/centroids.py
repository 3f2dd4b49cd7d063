"""Centroid clustering in whole numbers; the nearest centroid is found by the threshold algorithm.

Each dimension has its own list of centroids, sorted by value. From a vector's value the lists are walked outward, all
dimensions in step; who is met for the first time gets its exact distance. No centroid that was not met yet can be
nearer than the sum of squared distances to the frontiers, so a vector is done once that sum strictly exceeds its best
exact distance (strictly, as a smaller number wins ties).

Vectors are written once as whole numbers. A round is one pass with sums in each task: k rows for each dimension and
task are shuffled, and the driver gets k rows for each dimension and nothing that grows with the vectors. Sums are exact.

Defined results: rows whose vector is null, has another length, or has a null or non-finite component are left out.
Repeated rows each count and each get a row; of equal ids the smaller vector comes first among the starting centroids,
and a null id hashes as an empty one. Fewer than k vectors make as many centroids; an empty table gives an empty result.
A component beyond 2^17 in size fails the job, as its squared distances need not fit 64 bits. Other columns are not
looked at. Texts play no part."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, small_table, written

SCALE = 1024
#: Whole components stay within this, so that a sum of 64 squared differences fits 64 bits.
LIMIT = 1 << 27
ROWS = 4096


def whole_vectors(df: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """(vec_id, v): v has floor(1024 * x) for each component x."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    too_large = F.exists(scaled, lambda x: F.abs(x) > LIMIT)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component is beyond {LIMIT // SCALE}"))).otherwise(F.transform(scaled, lambda x: x.cast("int")))
    kept = df.where(v.isNotNull() & (F.size(v) == dims)).where(finite)
    return kept.select(F.col(vec_id).alias("vec_id"), checked.alias("v"))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector its nearest centroid's number (ties: the smaller) and the squared distance."""
    n, k = len(vectors), len(centroids)
    lists = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, lists, axis=0)
    dims = np.arange(centroids.shape[1])
    up = np.stack([np.searchsorted(values[:, j], vectors[:, j]) for j in dims], axis=1) if n else np.zeros((0, len(dims)), int)
    down = up - 1
    far = 2 * LIMIT  # the frontier of a list that is used up
    met = np.zeros((n, k), bool)
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    rows = np.arange(n)
    while len(rows):
        v, lo, hi = vectors[rows], down[rows], up[rows]
        below = np.where(lo >= 0, v - values[np.maximum(lo, 0), dims], far)
        above = np.where(hi < k, values[np.minimum(hi, k - 1), dims] - v, far)
        frontier = (np.minimum(below, above) ** 2).sum(axis=1)
        on = (frontier <= best[rows]) & ~met[rows].all(axis=1)
        rows, lo, hi, rise = rows[on], lo[on], hi[on], (above < below)[on]
        i = np.broadcast_to(np.arange(len(rows))[:, None], rise.shape)
        at = np.where(rise, hi, lo)
        open_list = (at >= 0) & (at < k)
        new = np.zeros((len(rows), k), bool)
        new[i[open_list], lists[at.clip(0, k - 1), dims][open_list]] = True
        new &= ~met[rows]
        met[rows] |= new
        r, c = np.nonzero(new)
        exact = np.full((len(rows), k), np.iinfo(np.int64).max)
        exact[r, c] = ((vectors[rows[r]] - centroids[c]) ** 2).sum(axis=1)
        least = exact.argmin(axis=1)
        found = exact[np.arange(len(rows)), least]
        better = (found < best[rows]) | ((found == best[rows]) & (least < who[rows]))
        best[rows[better]], who[rows[better]] = found[better], least[better]
        up[rows], down[rows] = hi + rise, lo - ~rise
    return who, best


def blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for lo in range(0, batch.num_rows, ROWS):
        part = batch.slice(lo, ROWS)
        yield part, part.column(part.num_columns - 1).flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """Rows (cluster, dim, n, total): exact sums of the vectors that are nearest to each centroid."""
    dims = centroids.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v in blocks(batch, dims):
                cluster, _ = nearest(v, centroids)
                np.add.at(total, cluster, v)
                count += np.bincount(cluster, minlength=len(count))
        c, j = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
        columns = [pa.array(c.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(count[c]), pa.array(total[c, j])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "dim", "n", "total"])

    parts = vectors.select("v").mapInArrow(of, "cluster int, dim int, n long, total long")
    exact = F.sum(F.col("total").cast("decimal(19,0)")).alias("total")
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), exact).collect()


def cluster(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that is kept."""
    spark = df.sparkSession
    ship(spark)
    vectors = written(whole_vectors(df, vec_id, vector, dims), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select("v", hashed.alias("h")).orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for row in sums(vectors, centroids):
            moved[row.cluster, row.dim] = int(row.total) // row.n
        if (moved == centroids).all():  # further rounds would change nothing
            break
        centroids = moved

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v in blocks(batch, dims):
                who, best = nearest(v, centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    assigned = written(vectors.mapInArrow(of, T.StructType([vectors.schema["vec_id"], *fields])), "assigned")
    inertias = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    texts = [",".join(map(str, c.tolist())) for c in centroids]
    about = [
        {"cluster": i, "cluster_inertia": inertias.get(i, 0), "inertia": sum(inertias.values()), "centroid_sha256": hashlib.sha256(t.encode()).hexdigest()}
        for i, t in enumerate(texts)
    ]
    named = small_table(spark, about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = assigned.join(F.broadcast(named), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The same in DuckDB: every distance of every round."""
    steps = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
numbered AS (SELECT row_number() OVER () AS r, vec_id, v FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {k})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
  FROM numbered, c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT cluster, dim, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({dims})) AS dim FROM a{i}) GROUP BY cluster, dim),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN
  (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY dim) AS m FROM s{i} GROUP BY cluster) USING (cluster))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
