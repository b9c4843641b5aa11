"""Ball k-means over integer vectors.

A cluster is a ball: its centroid and the greatest distance of a member. By the
triangle inequality another centroid can be as near to a member at distance d
only if the two centroids are at most 2 d apart. So a cluster's neighbours are
the centroids within twice its radius, nearest first; members nearer than half
the way to the first neighbour are its stable core and keep their centroid, and
those in the m-th annulus are compared, exactly, with the first m neighbours.

Each round is one pass over a written table that holds every vector with its
cluster. A pass sends to the driver one row for each cluster and component; no
vector is shuffled, so clusters of any size do no harm. The radius of the next
round is the last one's plus the way that the centroid has moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrid.llm import common

K = 8
ROUNDS = 10
SIZE = 64
SCALE = 1024
SEED = "3"
#: Components must be under it, so that squared distances fit 64 bits.
LIMIT = 2**27
_STATE_DDL = "vec_id long, x binary, cluster int, distance long"
_STATE = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64())])

Centroids = list[list[int]]


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: the vectors with ``size`` finite components, each component floor(scale * x). Others go."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = F.transform("v", lambda e: F.when(F.abs(e) < LIMIT // scale, F.floor(e * scale)).otherwise(F.raise_error(F.lit(f"a component of {LIMIT // scale} or more has no exact distance"))).cast("int"))
    return rows.where((F.size("v") == size) & ~bad).select("vec_id", x.alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> Centroids:
    """The ``k`` vectors whose ids have the smallest SHA-256; of repeated ids the lesser vector comes first."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r[0]) for r in rows.orderBy(key, "x").select("x").limit(k).collect()]  # k rows


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, of equally near ones the least number, and its squared distance."""
    best, at = _squared(x, centroids[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(centroids)):
        d = _squared(x, centroids[j])
        less = d < best
        best[less], at[less] = d[less], j
    return at, best


class Balls:
    """Centroids, and each ball's neighbours by their distance: those within twice the ball's radius."""

    def __init__(self, centroids: Centroids, radii: list[int]) -> None:
        self.centroids = np.array(centroids, np.int64)
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for i, radius in enumerate(radii):
            apart = _squared(self.centroids, self.centroids[i])
            order = [int(j) for j in np.argsort(apart, kind="stable") if j != i and int(apart[j]) <= 4 * radius * radius]
            self.near.append((np.array(order, np.int64), apart[order]))

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroids of rows that were in clusters ``before``, the squared distances, and how many distances that took."""
        at, best, computed = before.astype(np.int64), np.zeros(len(x), np.int64), len(x)
        for i in np.unique(before).tolist():
            rows = np.flatnonzero(before == i)
            own = _squared(x[rows], self.centroids[i])
            best[rows] = own
            order, apart = self.near[i]
            # The number of neighbours that may be as near: 0 in the stable core, m in the m-th annulus.
            annulus = np.searchsorted(apart, 4 * own, side="right")
            for m, j in enumerate(order.tolist()):
                inside = rows[annulus > m]
                if not len(inside):
                    break
                computed += len(inside)
                d = _squared(x[inside], self.centroids[j])
                less = (d < best[inside]) | ((d == best[inside]) & (j < at[inside]))
                best[inside[less]], at[inside[less]] = d[less], j
        return at, best, computed


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), size).astype(np.int64)


def _rows_out(ids: pa.Array, x: pa.Array, at: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, x, pa.array(at.astype(np.int32)), pa.array(best)], schema=_STATE)


def _first_pass(centroids: Centroids, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_state()
        c = np.array(centroids, np.int64)
        for batch in batches:
            x = pa.array([np.array(r, np.int32).tobytes() for r in batch.column(1).to_pylist()], pa.binary())
            yield _rows_out(batch.column(0), x, *nearest(_matrix(x, size), c))

    return run


def _next_pass(balls: Balls, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release_state()
        for batch in batches:
            at, best, _ = balls.assign(_matrix(batch.column(1), size), batch.column(2).to_numpy())
            yield _rows_out(batch.column(0), batch.column(1), at, best)

    return run


def _sums(k: int, size: int) -> Callable:
    """For each cluster of a task its rows, the greatest distance and a sum: of each component, and of distances at ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), [[0] * (size + 1) for _ in range(k)]
        for batch in batches:
            at, d = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = _matrix(batch.column(0), size)
            for i in np.unique(at).tolist():
                own = at == i
                n[i] += own.sum()
                far[i] = max(far[i], d[own].max())
                total[i] = [a + b for a, b in zip(total[i], [*x[own].sum(axis=0).tolist(), sum(d[own].tolist())], strict=True)]
        seen = [i for i in range(k) if n[i]]
        every = lambda v: np.repeat(v[seen], size + 1)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(np.array(seen, np.int32), size + 1)), "component": pa.array(np.tile(np.arange(size + 1, dtype=np.int32), len(seen))),
            "n": every(n), "far": every(far), "total": pa.array([str(t) for i in seen for t in total[i]], pa.string()),
        })

    return run


class Summary:
    """Of each cluster with members: the greatest distance, the distances' sum and the components' means, rounded down."""

    def __init__(self, state: DataFrame, k: int, size: int) -> None:
        parts = state.select("x", "cluster", "distance").mapInArrow(_sums(k, size), "cluster int, component int, n long, far long, total string")
        sums = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
        rows = {(r["cluster"], r["component"]): r for r in sums.collect()}  # at most k * (size + 1) rows
        ends = {i: rows[i, size] for i in range(k) if (i, size) in rows}
        self.far = [ends[i]["far"] if i in ends else 0 for i in range(k)]
        self.inertia = {i: int(r["total"]) for i, r in ends.items()}
        self.means = {i: [int(rows[i, j]["total"]) // r["n"] for j in range(size)] for i, r in ends.items()}


def moved(centroids: Centroids, summary: Summary) -> tuple[Centroids, list[int]]:
    """The next centroids, empty clusters' as they were, and a whole number that no member's distance to them exceeds."""
    after = [summary.means.get(i, c) for i, c in enumerate(centroids)]
    way = [math.isqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) + 1 for p, q in zip(after, centroids, strict=True)]
    return after, [math.isqrt(far) + 1 + w for far, w in zip(summary.far, way, strict=True)]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per vector that is kept.

    Kept are vectors with ``size`` components, none null or not finite; their integers floor(scale * x) are all that
    counts, and components of 131,072 or more raise an error, since their squares don't fit 64 bits. Ties go to the
    smaller number; a cluster without members keeps its centroid. Repeated rows and ids count each; a null id stays
    null. Fewer vectors than ``k`` make fewer clusters; none make an empty result. Rounds end early once no
    centroid moves, since all further ones are alike.
    """
    spark = vectors.sparkSession
    tables = common.Tables(spark, "balls")
    rows = tables.write(integers(vectors, id_col, vector_col, size, scale), "integers")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centroids)
    state = tables.write(rows.mapInArrow(_first_pass(centroids, size), _STATE_DDL), "state0")
    tables.drop("state0")
    summary = Summary(state, k, size)
    for i in range(1, rounds + 1):
        after, radii = moved(centroids, summary)
        if after == centroids:
            break
        centroids = after
        state = tables.write(state.mapInArrow(_next_pass(Balls(centroids, radii), size), _STATE_DDL), f"state{i}")
        tables.drop(f"state{i}")
        summary = Summary(state, k, size)
    inertia = sum(summary.inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    own = of([summary.inertia.get(i, 0) for i in range(k)]).cast("long")
    return state.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(inertia).cast("long").alias("inertia"), of(digest).alias("centroid_sha256"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every kept row of ``embeddings``; cases are defined by ``cluster``."""
    return cluster(common.read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round spelt out: assignment by a comparison with all centroids, then means."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS INTEGER) AS cluster, x AS c FROM v QUALIFY cluster < {K})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT r, cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(x, c)]) AS d FROM v, c{i}) GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"m{i} AS (SELECT cluster, list(m ORDER BY pos) AS c FROM (SELECT cluster, pos, (s - ((s % n) + n) % n) // n AS m FROM (SELECT cluster, pos, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM a{i} JOIN v USING (r)) GROUP BY cluster, pos)) GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (cluster)"""


SQL = _sql()
