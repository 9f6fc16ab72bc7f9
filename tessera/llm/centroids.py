"""Centroid clustering (Lloyd's rounds) with Drake's adaptive bounds.

Beside its cluster, every vector keeps lower bounds on the distances to its several nearest other centroids, each
for one of them in ascending order, and one more bound for all the remaining ones. When centroids have moved, each bound falls by
the movement of its centroid (the last one by the largest). The distance to the own centroid is computed exactly; a
centroid whose bound lies above it can't be nearer. The bounds that don't certify this are rescanned: from the first
place on which the order isn't certain, exact distances are taken to the centroids kept up to the next certain one, and if the last bound
is reached, to all centroids, which also makes new bounds (Drake and Hamerly, "Accelerated k-means with Adaptive Distance Bounds").
The number of bounds adapts: it starts at a quarter of the centroids and follows the highest place that a round
needed, down to an eighth of them.

Components are whole numbers and centroids are floors of exact means, so distances are whole numbers, ties are real ties (the
smaller number wins) and no result depends on the order of addition. Bounds are floats that are rounded towards safety.

Each round is one pass over the written vectors with the centroids in the closure (``k`` times the dimension: small
by the parameters), writes the next state, and sums components inside tasks before they are shuffled. A hot cluster
sends one sum a task and component.

Vectors that aren't of the dimension, hold a null, a NaN or an infinity are left out, as are those with a component
beyond 2^20 in size (a squared distance might not fit a long then). Equal vectors may both be first centroids; the
first by hash, then by components, come first. Fewer vectors than ``k`` give as many centroids. A null id is hashed as the
empty text. Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidied, written

#: Centroids, components, rounds, and whole steps of a component's unit.
CENTROIDS, DIMENSION, ROUNDS, STEPS = 16, 64, 3, 64
#: A component's largest size.
MOST = 1 << 20
#: Bounds are lowered by this share, far above what rounding can add.
_SAFE = 1e-9
_STATE = "id long, vec binary, cluster int, distance long, near array<int>, bounds array<double>, place int"


def whole(vectors: DataFrame, key: str, embedding: str, dimension: int = DIMENSION, steps: int = STEPS) -> DataFrame:
    """(id, vec): the vectors that are kept, in whole steps."""
    x = F.col("x")
    fine = (F.size(x) == dimension) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= MOST))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    return rows.filter(F.coalesce(fine, F.lit(False))).select("id", F.transform(x, lambda v: F.floor(v * float(steps))).alias("vec"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors (id, vec) whose ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["vec"] for r in vectors.orderBy(name, "vec").limit(k).select("vec").collect()], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors and centroids."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        apart = vectors - centre
        out[:, c] = np.einsum("ij,ij->i", apart, apart)
    return out


class Bounded:
    """Nearest centroids of vectors by bounds. ``near`` and ``bounds`` have a row a vector: the kept centroids in ascending order of distance; the last bound is for all others."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray, kept: int):
        self.centroids, self.moved, self.kept = centroids, moved, min(kept, len(centroids) - 1)
        self.computed = 0

    def scanned(self, vectors: np.ndarray, kept: int | None = None) -> tuple[np.ndarray, ...]:
        """Cluster, distance, near, bounds by all distances."""
        kept = self.kept if kept is None else kept
        far = squared(vectors, self.centroids)
        self.computed += far.size
        order = np.argsort(far, axis=1, kind="stable")  # of equal ones the smaller number
        sorted_ = np.take_along_axis(far, order, 1)
        near = order[:, 1 : kept + 1].astype(np.int32)
        bounds = np.sqrt(sorted_[:, 1 : kept + 2].astype(np.float64)) * (1 - _SAFE)
        if bounds.shape[1] <= kept:  # no centroid remains beside the kept ones
            bounds = np.concatenate([bounds, np.full((len(vectors), 1), np.inf)], 1)
        return order[:, 0].astype(np.int32), sorted_[:, 0], near, bounds

    def moved_on(self, vectors: np.ndarray, cluster: np.ndarray, near: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """As :meth:`scanned`, and the places that had to be looked at (0: the own centroid was certain), with bounds of a former round."""
        n, b = near.shape
        fall = np.concatenate([self.moved[near], np.full((n, 1), self.moved.max())], 1)
        bounds = np.maximum(0, (bounds - fall) * (1 - _SAFE) - _SAFE)
        # A bound holds for its place and all after it only if none after it is lower.
        bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
        apart = vectors - self.centroids[cluster]
        distance = np.einsum("ij,ij->i", apart, apart)
        self.computed += n
        upper = np.sqrt(distance.astype(np.float64)) * (1 + _SAFE)
        # All centroids from this place on are certainly farther than the own one.
        place = (bounds <= upper[:, None]).sum(1)
        cluster, near = cluster.copy(), near.copy()
        rescan = place > b
        for p in range(1, b + 1):
            rows = np.flatnonzero(place == p)
            if not len(rows):
                continue
            these = np.concatenate([cluster[rows, None], near[rows, :p]], 1)
            apart = vectors[rows, None, :] - self.centroids[these]
            far = np.einsum("ijk,ijk->ij", apart, apart)
            self.computed += len(rows) * p
            order = np.lexsort((these, far), axis=1)
            these, far = np.take_along_axis(these, order, 1), np.take_along_axis(far, order, 1)
            cluster[rows], distance[rows] = these[:, 0], far[:, 0]
            near[rows, :p] = these[:, 1:]
            bounds[rows, :p] = np.sqrt(far[:, 1:].astype(np.float64)) * (1 - _SAFE)
        if rescan.any():
            cluster[rescan], distance[rescan], near[rescan], bounds[rescan] = self.scanned(vectors[rescan], b)
        # Fewer bounds are kept: the first one that goes holds for all from there on.
        if self.kept < b:
            bounds = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
            near, bounds = near[:, : self.kept], bounds[:, : self.kept + 1]
        return cluster, distance, near, bounds, place


def _rows(column: pa.Array, type_: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), type_).reshape(len(column), -1)


def _listed(rows: np.ndarray, type_: pa.DataType) -> pa.Array:
    width = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(width), pa.array(np.ascontiguousarray(rows).ravel(), type_))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, kept: int) -> DataFrame:
    """The next state, written. Without ``moved`` all distances are taken."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            by = Bounded(centroids, moved, kept)
            held = batch.column("vec")
            vectors = _rows(held, np.int32).astype(np.int64)
            if moved is None:
                *found, place = *by.scanned(vectors), np.full(n, len(centroids))
            else:
                *found, place = by.moved_on(vectors, batch.column("cluster").to_numpy(), _matrix(batch.column("near"), n), _matrix(batch.column("bounds"), n))
            cluster, distance, near, bounds = found
            columns = [batch.column("id"), held, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), _listed(near, pa.int32()), _listed(bounds, pa.float64()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "cluster", "distance", "near", "bounds", "place"])

    return written(state.mapInArrow(nearest, _STATE), "clustered")


def _sums(state: DataFrame, k: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that isn't empty: its number of vectors, and their exact sum by component."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, cluster = _rows(batch.column("vec"), np.int32).astype(np.int64), batch.column("cluster").to_numpy()
            total = np.zeros((k, vectors.shape[1]), np.int64) if total is None else total
            count += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            total[cluster[order][starts]] += np.add.reduceat(vectors[order], starts)
        if total is not None:
            own = np.flatnonzero(count)
            place = np.tile(np.arange(total.shape[1], dtype=np.int32), len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, total.shape[1]).astype(np.int32)), pa.array(place), pa.array(total[own].ravel()), pa.array(np.repeat(count[own], total.shape[1]))], ["cluster", "place", "total", "n"])

    parts = state.select("vec", "cluster").mapInArrow(added, "cluster int, place int, total long, n long")
    # k times the dimension rows.
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["place"])):
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return out


def cluster(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, dimension: int = DIMENSION, rounds: int = ROUNDS, steps: int = STEPS) -> DataFrame:
    """(``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = vectors.sparkSession
    columns = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    with tidied() as keep:
        kept = whole(vectors, key, embedding, dimension, steps)
        centroids = first_centroids(kept, k)
        if not len(centroids):
            return spark.createDataFrame([], columns)
        state, moved, bounds = _packed(kept), None, max(1, len(centroids) // 4)
        for turn in range(rounds + 1):
            state = _assigned(state, centroids, moved, bounds)
            if turn == rounds:
                break
            if moved is not None:
                # The highest place below a whole rescan that this round has needed.
                needed = state.filter(F.col("place") <= bounds).agg(F.max("place")).first()[0] or 0
                bounds = min(bounds, max(1, len(centroids) // 8, needed))
            before, centroids = centroids, centroids.copy()
            for c, (n, total) in _sums(state, len(centroids)).items():
                centroids[c] = [t // n for t in total]
            moved = np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)) * (1 + _SAFE)
        names = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
        sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_own"))
        every = sums.agg(F.sum("_own").alias("_all"))  # of k rows
        placed = names.join(sums, "cluster").crossJoin(every)
        return keep(state.select(F.col("id").alias(key), "cluster", "distance").join(F.broadcast(placed), "cluster").select(key, "cluster", "distance", F.col("_own").cast("long").alias("cluster_inertia"), F.col("_all").cast("long").alias("inertia"), "centroid_sha256"))


def _packed(kept: DataFrame) -> DataFrame:
    """Vectors as bytes of four a component, without a state so far."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                rows = _matrix(batch.column("vec"), n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "vec"])

    return kept.mapInArrow(packed, "id long, vec binary")


def oracle(k: int = CENTROIDS, dimension: int = DIMENSION, rounds: int = ROUNDS, steps: int = STEPS) -> str:
    """SQL with all distances in every round."""
    near = lambda i: f"near{i} AS (SELECT vec_id, v, arg_min(c, [d, c]) AS c, min(d) AS d FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{i}) GROUP BY vec_id, v)"
    mean = lambda i: f"""s{i} AS (SELECT c, i, CAST(sum(x) AS HUGEINT) AS t, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{i}) GROUP BY c, i),
m{i} AS (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN m{i} USING (c))"""  # noqa: E731
    return f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {steps}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) <= {MOST})) = {dimension}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS w FROM kept QUALIFY c < {k}),
{", ".join(near(i) + ", " + mean(i) for i in range(rounds))}, {near(rounds)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} USING (c)
"""


ORACLE = oracle()
