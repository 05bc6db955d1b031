"""Centroid clustering over a table of pivot distances (LAESA).

Vectors of ``DIMENSIONS`` finite components become integers ``floor(SCALE * x)``. Their distances to a few
fixed pivots are computed once and stored beside them. Every round the distances of the centroids to the
pivots bound each vector's distance to each centroid from below (a side of a triangle is no shorter than the
difference of the others). The centroid with the lowest bound gets its exact integer distance first, and so
does every other whose bound does not exceed the best exact distance so far. Bounds carry a slack for
rounding, so what they rule out is farther in integers; ties go to the smaller number.

A task sums the vectors of each cluster before anything is shuffled: a round moves ``k * DIMENSIONS`` sums a
task and no vectors. Centroids and pivots are ``k`` and ``PIVOTS`` rows, whatever the table.

Pivots are taken farthest first from the ``PIVOT_SAMPLE`` vectors with the smallest hashes; they change how
many exact distances are needed, never the result. Vectors of another length, null ones and those with a
null or non-finite component take no part. Components beyond +-``LARGEST`` count as that (then a distance
fits 64 bits), inertia beyond 64 bits as the largest long. Fewer vectors than ``k`` are that many centroids;
none give no rows. A null vec_id hashes as ``1:``; repeated rows are vectors each, equal hashes in order of
their integers.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterlab.llm.common import pick, stash

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
PIVOTS = 16
PIVOT_SAMPLE = 256
LARGEST = 1 << 27


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array<int>) of the vectors that are kept."""
    v = pick(vectors, vec_id="long", embedding="array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x * scale).cast("double"), F.lit(float(-LARGEST))), F.lit(float(LARGEST))).cast("int"))
    return v.where((F.size("embedding") == dimensions) & fine).select("vec_id", whole.alias("x"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one vector."""
    d = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", d, d)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different rows, each as far as can be from those before it."""
    if not len(x):
        return x
    picked, near = [0], squared(x, x[0])
    while len(picked) < min(n, len(x)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, squared(x, x[picked[-1]]))
    return x[picked]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64))


def assigned(x: np.ndarray, to_pivot: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, the exact squared distance, and how many exact distances that took."""
    held = to_pivots(centroids, pivots)
    low = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(to_pivot[:, p, None] - held[None, :, p]), out=low)
    slack = 1e-9 * (1 + to_pivot.max(axis=1, initial=0) + held.max(initial=0))
    low -= slack[:, None]
    cluster = low.argmin(axis=1)
    best = np.empty(len(x), np.int64)
    for c in range(len(centroids)):
        at = np.flatnonzero(cluster == c)
        best[at] = squared(x[at], centroids[c])
    first, exact = cluster.copy(), len(x)
    reach = np.sqrt(best.astype(np.float64)) + slack
    for c in range(len(centroids)):
        at = np.flatnonzero((low[:, c] <= reach) & (first != c))
        if not len(at):
            continue
        d = squared(x[at], centroids[c])
        exact += len(at)
        better = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
        at, d = at[better], d[better]
        best[at], cluster[at] = d, c
        reach[at] = np.sqrt(d.astype(np.float64)) + slack[at]
    return cluster, best, exact


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def pivot_table(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, x, to_pivot: the stored table of distances."""
    width = pivots.shape[1]

    def run(batches):
        for b in batches:
            d = to_pivots(_matrix(b.column(1), width, np.int32), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, len(pivots), dtype=np.int32)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "x", "to_pivot"])
    return stash(kept.mapInArrow(run, "vec_id long, x array<int>, to_pivot array<double>"))


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the means, those of empty clusters as they were."""
    k, width = centroids.shape

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            x = _matrix(b.column(1), width, np.int32)
            cluster, _, _ = assigned(x, _matrix(b.column(2), len(pivots), np.float64), centroids, pivots)
            for c in np.unique(cluster):
                mine = x[cluster == c]
                count[c] += len(mine)
                sums[c] += mine.sum(axis=0, dtype=np.int64)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(full, pa.int32()), "n": pa.array(count[full]),
                                          "sums": pa.array(sums[full].tolist(), pa.list_(pa.int64()))})
    parts = table.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(
        F.sum(F.col("col").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in totals:  # k * width rows
        out[r.cluster, r.pos] = int(r.total) // r.n
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
              seed: str = "1", pivots: int = PIVOTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    kept = integers(vectors, dimensions, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    few = kept.orderBy(order, "x").limit(max(PIVOT_SAMPLE, k)).collect()
    schema = "vec_id long, cluster int, distance long"
    if not few:
        return kept.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    sample = np.array([r.x for r in few], np.int32)
    fixed, centroids = farthest_first(sample, pivots), sample[:k].astype(np.int64)
    table = pivot_table(kept, fixed)
    for _ in range(rounds):
        centroids = _moved(table, centroids, fixed)

    def run(batches):
        for b in batches:
            cluster, distance, _ = assigned(_matrix(b.column(1), dimensions, np.int32), _matrix(b.column(2), len(fixed), np.float64), centroids, fixed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
    last = stash(table.mapInArrow(run, schema))
    sums = {r.cluster: int(r.s) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    top = (1 << 63) - 1
    own = F.create_map(*[F.lit(x) for c, s in sums.items() for x in (c, min(s, top))])
    name = F.create_map(*[F.lit(x) for c in sums for x in (c, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())])
    return last.select("vec_id", "cluster", "distance", own[F.col("cluster")].cast("long").alias("cluster_inertia"),
                       F.lit(min(sum(sums.values()), top)).cast("long").alias("inertia"), name[F.col("cluster")].alias("centroid_sha256"))


def _sql() -> str:
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: CAST(z[1] - z[2] AS BIGINT) * CAST(z[1] - z[2] AS BIGINT)))"
    parts = [f"""WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(CAST(e AS DOUBLE)))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x FROM (
  SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""d{i} AS (SELECT v.vec_id, v.r, v.x, c.cluster, {near} AS distance FROM v, c{i} c),
a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT cluster, pos, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY cluster, pos),
c{i + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS x FROM s{i} GROUP BY cluster) m ON c.cluster = m.cluster)""")
    return ",\n".join(parts) + f"""
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.cluster = c.cluster
"""


SQL = _sql()
