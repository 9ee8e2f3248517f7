"""Centroid clustering with a pivot table: distances to fixed pivots are stored once and bound every centroid from below.

A vector x keeps, for each pivot p, floor(|x - p|). For a centroid c with the same numbers, |x - c| > abs(floor|x - p| - floor|c - p|) - 1
by the triangle inequality, so a centroid whose largest such bound, squared, is not under the best squared distance met so far can neither
be nearer nor tie. A vector first meets the centroid of its smallest bound, then the others in order of their number,
each only while its bound allows; those that survive get an exact integer distance. Pivots only save work: results do not
depend on them.

A round is one pass over the stored table; a task adds up its vectors by cluster, and rows of (cluster, dimension, sum) are summed by Spark.
The driver holds the k centroids and nothing that grows with the table.

Cases: vectors that are null, of another length than `size`, or with a null or non-finite component take no part; equal vectors and
repeated ids are rows of their own; ties of distance go to the smaller number, ties of hash to the smaller id, then vector; rows with a
null vec_id are clustered but no centroid starts from them unless others run out; fewer vectors than k give as many centroids; an empty
table gives no rows; other columns, whatever their names, are ignored; a component of over LARGEST raises, as squared distances would not fit in a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import cut, unused

#: Pivots; the vectors that they are chosen of, farthest first (their number bounds work on the driver); the largest component.
PIVOTS, POOL, LARGEST = 12, 512, (1 << 27) - 1


def kept(vectors: DataFrame, size: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): the vectors that take part, in integers."""
    fine = (F.size("embedding") == size) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    low = F.array_min(v) < -LARGEST
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), F.when(low | (F.array_max(v) > LARGEST), F.raise_error(F.lit(f"a component of over {LARGEST}"))).otherwise(v).alias("v"))


def squared(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances; differences are under 2**28, so 64 squares fit in 62 bits."""
    d = rows - to
    return np.einsum("ij,ij->i", d, d)


def roots(squares: np.ndarray) -> np.ndarray:
    """Floors of square roots, exact."""
    r = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) * (r + 1) <= squares
    return r


def choose(pool: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first vectors of a pool, each different from those before."""
    if not len(pool):
        return pool
    out, near = [pool[0]], squared(pool, pool[0])
    while len(out) < count and near.max() > 0:
        out.append(pool[int(near.argmax())])
        near = np.minimum(near, squared(pool, out[-1]))
    return np.array(out)


def nearest(rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, and how many exact distances that took; bounds: the centroids' rows of the pivot table."""
    gap = np.zeros((len(rows), len(centroids)), np.int64)
    for p in range(table.shape[1]):
        np.maximum(gap, np.abs(table[:, p, None] - bounds[None, :, p]), out=gap)
    low = np.maximum(gap - 1, 0) ** 2
    first = low.argmin(axis=1)
    cluster, best, done = first.copy(), np.empty(len(rows), np.int64), len(rows)
    for c in range(len(centroids)):
        own = first == c
        best[own] = squared(rows[own], centroids[c])
    for c in range(len(centroids)):
        # a distance is over the root of its bound if that is not zero, so only a bound under the best can win or tie
        rest = np.flatnonzero((first != c) & ((low[:, c] < best) | (best == 0) & (low[:, c] == 0)))
        exact = squared(rows[rest], centroids[c])
        done += len(rest)
        wins = (exact < best[rest]) | (exact == best[rest]) & (c < cluster[rest])
        best[rest[wins]], cluster[rest[wins]] = exact[wins], c
    return cluster, best, done


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, d array<long>): the pivot table, made once."""
    width = pivots.shape[1]

    def add(batches):
        for b in batches:
            rows = _matrix(b.column(1), width)
            d = np.stack([roots(squared(rows, p)) for p in pivots], axis=1) if len(rows) else np.zeros((0, len(pivots)), np.int64)
            at = np.arange(len(rows) + 1, dtype=np.int32) * len(pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, d.ravel())], names=["vec_id", "v", "d"])

    return vectors.select("vec_id", "v").mapInArrow(add, "vec_id long, v array<long>, d array<long>")


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Members and componentwise sums of each cluster, in one pass."""
    k, width = centroids.shape
    bounds = np.stack([roots(squared(centroids, p)) for p in pivots], axis=1)

    def add(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            rows = _matrix(b.column(1), width)
            cluster = nearest(rows, _matrix(b.column(2), bounds.shape[1]), centroids, bounds)[0]
            for c in np.unique(cluster):
                own = rows[cluster == c]
                count[c] += len(own)
                total[c] += own.sum(axis=0)
        used = np.flatnonzero(count)
        place = np.tile(np.arange(-1, width), len(used))
        value = np.concatenate([count[used, None], total[used]], axis=1).ravel()
        yield pa.RecordBatch.from_pydict({"cluster": np.repeat(used, width + 1).astype(np.int32), "place": place.astype(np.int32), "value": value})

    parts = table.mapInArrow(add, "cluster int, place int, value long")
    n, sums = [0] * k, [[0] * width for _ in range(k)]
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # k * (size + 1) rows
        if r.place < 0:
            n[r.cluster] = int(r.value)
        else:
            sums[r.cluster][r.place] = int(r.value)
    return n, sums


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    own = cut(kept(vectors, size, scale))
    (at,) = unused(own.columns, "hash")
    hashed = own.withColumn(at, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    pool = hashed.orderBy(F.col(at).asc_nulls_last(), "vec_id", "v").limit(max(k, POOL)).select("v").collect()
    if not pool:
        return own.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    pool = np.array([r.v for r in pool], dtype=np.int64)
    fixed = choose(pool, pivots)
    table, centroids = cut(with_pivots(own, fixed)), pool[:k].copy()
    for _ in range(rounds):
        n, sums = _sums(table, centroids, fixed)
        new = np.array([[s // m for s in row] if m else centroids[c].tolist() for c, (m, row) in enumerate(zip(n, sums, strict=True))], dtype=np.int64)
        if np.array_equal(new, centroids):  # every round to come would be the same
            break
        centroids = new
    bounds = np.stack([roots(squared(centroids, p)) for p in fixed], axis=1)

    def assign(batches):
        for b in batches:
            c, d, _ = nearest(_matrix(b.column(1), size), _matrix(b.column(2), bounds.shape[1]), centroids, bounds)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "cluster": c.astype(np.int32), "distance": d})

    done = cut(table.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.s) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    if sum(inertia.values()) > (1 << 63) - 1:
        raise ValueError("the inertia does not fit in a long")
    of = lambda f, kind: F.element_at(F.create_map(*[x for c in inertia for x in (F.lit(c), F.lit(f(c)).cast(kind))]), F.col("cluster"))
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    return done.select("vec_id", "cluster", "distance", of(inertia.get, "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digest, "string").alias("centroid_sha256"))


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> str:
    """The same in SQL, a pair of tables for each round."""
    distance = "CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(ok.v, c.v)]) AS BIGINT)"
    parts = [
        f"""WITH ok AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {size} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), vec_id, v) - 1 AS cluster, v FROM ok QUALIFY cluster < {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT ok.id, c.cluster, {distance} AS d FROM ok, c{i} c) x GROUP BY id)")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v
    FROM (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT a.cluster, unnest(ok.v) AS x, unnest(range(1, {size} + 1)) AS place FROM a{i} a JOIN ok USING (id)) u GROUP BY cluster, place) t GROUP BY cluster
  ) m USING (cluster)
)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN ok USING (id) JOIN c{rounds} c ON a.cluster = c.cluster"""
