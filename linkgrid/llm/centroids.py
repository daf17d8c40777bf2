"""Centroid clustering on exact integers, pruned by Ptolemaic pivots.

For points x, c and pivots p, q in Euclidean space Ptolemy's inequality says

    d(x, c) * d(p, q)  >=  | d(x, p) * d(c, q) - d(x, q) * d(c, p) |

so distances to a few fixed pivots, kept with every vector for all rounds, bound its distance
to any centroid from below. A vector tries the centroids in the order of their bounds and
stops at the first bound above the least exact distance so far. Bounds are floats, reduced by
more than their rounding error; distances are integers, so pruning never changes a result.

Scale: vectors are turned into integers and measured against the pivots once, and written to
the shared folder with that. A round is one scan: a task adds up its vectors per cluster (at
most clusters x (components + 1) numbers), Spark sums these per (cluster, component), and only
that many numbers reach the driver. There is no shuffle of vectors, so equal vectors or one
huge cluster make no hot key. What goes to tasks are the centroids and pivots.

Edge cases: vectors that are null, of another length, or with a null or non-finite component
are left out (all that differ from the dealt length, not only odd ones); integer components
are held within +-2^22; repeated rows count as often as they come; rows with equal vec_id are
ordered by their vectors as starting centroids; a null vec_id hashes as an empty one and stays
null; fewer vectors than clusters give fewer clusters; an empty table gives an empty table.
Columns other than vec_id and the vector are not read. An inertia beyond a long is the largest
long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.llm.common import kept
from linkgrid.llm.vectors import integers, is_finite, lists, rows_of

#: Far above the rounding error of a bound (some 2^-50), far below any gain from pruning.
SLACK = 1e-12
LARGEST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    clusters: int = 40
    rounds: int = 5
    components: int = 64
    scale: int = 256
    pivots: int = 8
    salt: str = "2"


@dataclass(frozen=True)
class Pivots:
    """Pivots, and the pairs of them with the distance between the two."""

    points: np.ndarray
    pairs: tuple[tuple[int, int, float], ...]


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances of each point to each other point."""
    out = np.empty((len(points), len(others)))
    for i, other in enumerate(others.astype(np.int64)):
        apart = points.astype(np.int64) - other
        out[:, i] = np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64))
    return out


def choose_pivots(points: np.ndarray, count: int) -> Pivots:
    """Points far from each other, one after the other, and the pairs of neighbours in a ring."""
    chosen = [0] if len(points) else []
    least = distances(points, points[:1])[:, 0] if chosen else np.zeros(0)
    while chosen and len(chosen) < count and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(points, points[chosen[-1:]])[:, 0])
    pivots = points[chosen]
    between = distances(pivots, pivots)
    ring = {tuple(sorted((i, (i + 1) % len(chosen)))) for i in range(len(chosen))}
    return Pivots(pivots, tuple((p, q, between[p, q]) for p, q in sorted(ring) if p < q))


def least_squares(to_pivots: np.ndarray, from_pivots: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Lower bounds of the squared distances of vectors (rows) to centroids (columns)."""
    low = np.zeros((len(to_pivots), len(from_pivots)))
    for p, q, between in pivots.pairs:
        one = to_pivots[:, p, None] * from_pivots[None, :, q]
        other = to_pivots[:, q, None] * from_pivots[None, :, p]
        np.maximum(low, (np.abs(one - other) - SLACK * (one + other)) / between, out=low)
    return low * low * (1 - SLACK)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray,
            pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector; how many distances were computed."""
    low = least_squares(to_pivots, distances(centroids, pivots.points), pivots)
    order = np.argsort(low, axis=1, kind="stable")
    vectors, centroids = vectors.astype(np.int64), centroids.astype(np.int64)
    cluster = np.zeros(len(vectors), np.int64)
    best = np.full(len(vectors), LARGEST_LONG)
    rows, computed = np.arange(len(vectors)), 0
    for place in range(len(centroids)):
        at = order[rows, place]
        open_ = low[rows, at] <= best[rows]  # bounds rise with the place
        rows, at = rows[open_], at[open_]
        if not len(rows):
            break
        apart = vectors[rows] - centroids[at]
        square = np.einsum("ij,ij->i", apart, apart)
        computed += len(rows)
        better = (square < best[rows]) | ((square == best[rows]) & (at < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = square[better], at[better]
    return cluster, best, computed


def _prepare(settings: Clustering, pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = integers(rows_of(batch["embedding"], settings.components), settings.scale)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch["vec_id"], "v": lists(v, pa.int32()),
                "to_pivots": lists(distances(v, pivots.points), pa.float64()),
            })

    return run


def _sums(centroids: np.ndarray, pivots: Pivots):
    """Per task and cluster: the number of its vectors, then the sum of each component."""

    def run(batches):
        totals = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            v = rows_of(batch["v"], centroids.shape[1])
            to_pivots = rows_of(batch["to_pivots"], len(pivots.points))
            cluster, _, _ = nearest(v, to_pivots, centroids, pivots)
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            totals[held, 0] += np.diff(np.append(starts, len(v)))
            totals[held, 1:] += np.add.reduceat(v[order].astype(np.int64), starts, axis=0)
        held = np.flatnonzero(totals[:, 0])
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(held, pa.int32()), "sums": lists(totals[held], pa.int64())})

    return run


def _assign(centroids: np.ndarray, pivots: Pivots):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = rows_of(batch["v"], centroids.shape[1])
            to_pivots = rows_of(batch["to_pivots"], len(pivots.points))
            cluster, square, _ = nearest(v, to_pivots, centroids, pivots)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch["vec_id"], "cluster": pa.array(cluster, pa.int32()),
                "distance": pa.array(square, pa.int64())})

    return run


def _moved(ready: DataFrame, centroids: np.ndarray, pivots: Pivots) -> np.ndarray:
    """The floored means of the vectors of each centroid; one without vectors stays."""
    parts = ready.select("v", "to_pivots").mapInArrow(
        _sums(centroids, pivots), "cluster int, sums array<bigint>")
    totals = (
        parts.select("cluster", F.posexplode("sums").alias("place", "value"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    ).collect()
    sums = {(r.cluster, r.place): int(r.value) for r in totals}
    out = centroids.copy()
    for c in {c for c, _ in sums}:
        out[c] = [sums[c, i + 1] // sums[c, 0] for i in range(centroids.shape[1])]
    return out


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, settings: Clustering = Clustering()) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    usable = vectors.where(
        (F.size("embedding") == settings.components) & is_finite("embedding")
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    name = F.concat(F.lit(f"{settings.salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    starts = usable.orderBy(F.sha2(name, 256), "embedding").limit(settings.clusters).collect()
    centroids = integers(
        np.array([r.embedding for r in starts]).reshape(-1, settings.components), settings.scale)
    centroids = centroids.astype(np.int64)
    pivots = choose_pivots(centroids, settings.pivots)
    ready = kept(usable.mapInArrow(
        _prepare(settings, pivots), "vec_id bigint, v array<int>, to_pivots array<double>"),
        "centroid-vectors")
    for _ in range(settings.rounds if len(starts) else 0):
        centroids = _moved(ready, centroids, pivots)
    assigned = kept(ready.mapInArrow(
        _assign(centroids, pivots), "vec_id bigint, cluster int, distance bigint"),
        "centroid-assigned")
    # One row per cluster.
    sums = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster")).collect()
    whole = min(sum(int(r.of_cluster) for r in sums), LARGEST_LONG)
    inertias = spark.createDataFrame(
        [(r.cluster, min(int(r.of_cluster), LARGEST_LONG), whole, centroid_digest(centroids[r.cluster]))
         for r in sums],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(inertias), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
