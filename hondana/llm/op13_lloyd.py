"""Centroid clustering by plain Lloyd rounds, in integers.

Components become integers of a fixed scale, so distances and sums are exact and reruns agree whatever the partitions. A round broadcasts the centroids (``K`` times 64 integers),
takes squared differences to each of them in NumPy, the least of which wins, the lower number first, and passes on a sum and a count for each
cluster and dimension of its partition; one ``groupBy`` merges those. Only the new centroids, of a fixed size, reach the driver.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part and have no row; a row without vec_id is clustered
but comes last as a first centroid; repeated rows are vectors of their own, also as first centroids, ties among which go by vector; fewer vectors than ``K`` give as many centroids; a
cluster that no vector is nearest to keeps its centroid; components too large for a squared distance of 64 bits are an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hondana.llm import scratch

K = 16
ROUNDS = 3
SCALE = 64
SIZE = 64
#: Components below this have squared distances of 62 bits at most over 64 dimensions.
SMALL = 1 << 27
ROWS = 4096


def whole(vectors: DataFrame, scale: int = SCALE, size: int = SIZE) -> DataFrame:
    """vec_id and v (array<long>, floor of ``scale`` times each component) of the vectors that take part."""
    x = F.col("embedding")
    fine = (F.size(x) == size) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    scaled = lambda y: F.lit(float(scale)) * y.cast("double")
    floor = lambda y: F.when(F.abs(scaled(y)) < 2.0**62, F.floor(scaled(y))).otherwise(F.raise_error(F.lit("components are too large")).cast("long"))
    return vectors.where(x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, floor).alias("v"))


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the lower one of several, and the squared distance to it."""
    if max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)) >= SMALL:
        rows, centroids = rows.astype(object), centroids.astype(object)
    best = np.zeros(len(rows), np.int64)
    least = ((rows - centroids[0]) ** 2).sum(axis=1)
    for k in range(1, len(centroids)):
        d = ((rows - centroids[k]) ** 2).sum(axis=1)
        nearer = (d < least).astype(bool)
        best[nearer], least[nearer] = k, d[nearer]
    if least.dtype == object and len(least) and max(least) >= 1 << 63:
        raise ValueError("a squared distance does not fit 64 bits: components are too large")
    return best, least.astype(np.int64)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        for at in range(0, len(frame), ROWS):
            some = frame.iloc[at : at + ROWS]
            yield some["vec_id"], np.stack(some["v"].to_list())


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dim, total, n of every cluster and dimension of a partition that has vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, x in _slices(frames):
            best, _ = nearest(x, centroids)
            for k in np.unique(best):
                mine = x[best == k]
                counts[k] += len(mine)
                totals[k] += mine.sum(axis=0).astype(object) if np.abs(mine).max() < 1 << 50 else mine.astype(object).sum(axis=0)
        cluster, dim = np.nonzero(np.broadcast_to(counts[:, None] > 0, centroids.shape))
        yield pd.DataFrame({"cluster": cluster.astype(np.int32), "dim": dim.astype(np.int32), "total": [str(totals[c, d]) for c, d in zip(cluster, dim)], "n": counts[cluster]})

    found = rows.mapInPandas(run, "cluster int, dim int, total string, n long")
    return found.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def start(rows: DataFrame, k: int = K) -> np.ndarray:
    """The first centroids: vectors of the smallest digests of ``1:<vec_id>``, in their order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.select("v", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of each one's vectors."""
    out = centroids.copy()
    for r in _sums(rows, centroids).collect():
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _slices(frames):
            best, least = nearest(x, centroids)
            yield pd.DataFrame({"vec_id": ids.astype("Int64").to_numpy(dtype=object, na_value=None), "cluster": best.astype(np.int32), "distance": least})

    return rows.mapInPandas(run, "vec_id long, cluster int, distance long")


def op13_lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    rows = whole(vectors)
    centroids = start(rows, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = scratch.write(assigned(rows, centroids), "assigned")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    of_cluster = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    names = spark.createDataFrame(of_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(rounds: int = ROUNDS) -> str:
    """One common table expression a round; places 1 to 64 of a vector are rows of ``x``."""
    distance = "SELECT x.r, c.cluster, sum((x.y - c.y) * (x.y - c.y)) AS d FROM x JOIN c{n} c USING (place) GROUP BY ALL"
    nearest = "a{n} AS (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (" + distance + ") GROUP BY r)"
    mean = "m{n} AS (SELECT a.cluster, x.place, CAST(sum(x.y) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{n} a USING (r) GROUP BY ALL)"
    moved = "c{m} AS (SELECT c.cluster, c.place, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.y) AS y FROM c{n} c LEFT JOIN m{n} m USING (cluster, place))"
    steps = [s.format(n=n, m=n + 1) for n in range(rounds) for s in (nearest, mean, moved)]
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, unnest(range(1, 65)) AS place, unnest(v) AS y FROM v),
firsts AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM v QUALIFY cluster < 16),
c0 AS (SELECT cluster, unnest(range(1, 65)) AS place, unnest(v) AS y FROM firsts),
{", ".join(steps)},
{nearest.format(n=rounds)},
names AS (SELECT cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN names USING (cluster)
"""


SQL = _sql()
