"""Clustering of vectors by Lloyd's rounds that only work on what has changed.

Vectors are integers, so every sum is exact and every run gives the same clusters. Assignments (cluster and squared distance) are persisted
with the vectors, and the sums and counts of all clusters are kept from round to round. In a round, a vector whose own centroid stayed is
compared with the centroids that moved only; a vector whose own centroid moved is compared with all. Vectors that change their cluster are
transfers: minus the vector for the cluster it leaves, plus the vector for the one it joins. Each task adds its transfers up, the
tasks' sums are added by component, and the totals are added to the kept sums. Centroids are `k` rows of `dims` numbers, so they and the sums are the
driver's; nothing else is.

Defined results: vectors of another size, or with a null or non-finite component, take no part; a component beyond 2^27 after scaling counts as 2^27, so that
squared distances stay within 64 bits; vectors with a null id are clustered but start no centroid unless there are too few others;
repeated rows are vectors of their own, and of equal ids the lesser vector starts a centroid first; fewer vectors than k give fewer
clusters; a table without vectors gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.session import settle, written

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
LIMIT = 1 << 27

STATE = "vec_id long, vector array<int>, cluster int, distance long, left int"


class Clusters(NamedTuple):
    """vec_id, vector, cluster, distance of each vector; centroids and sums of distances by number; sizes; vectors that moved in each round."""

    assigned: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    sizes: list[int]
    moved: list[int]


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector as integers floor(scale * x), of the vectors that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), v * scale))).cast("double"))).cast("int"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("vector"))


def starting_order(seed: int) -> list[Column]:
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("vector").asc()]


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from each centroid, as 64-bit integers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 8 * x.shape[1] * largest * largest < 1 << 53:  # all sums are whole numbers that doubles hold
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = ((x - c) ** 2).sum(1)
    return out


def reassign(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroids and distances, given the ones before `changed` centroids moved; cluster -1 has none yet."""
    cluster, distance = cluster.copy(), distance.copy()
    full = (cluster < 0) | changed[np.maximum(cluster, 0)]
    if full.any():
        d = squared_distances(x[full], centroids)
        cluster[full] = d.argmin(1)  # the first of equals
        distance[full] = d.min(1)
    if changed.any() and not full.all():
        numbers = np.flatnonzero(changed)
        d = squared_distances(x[~full], centroids[numbers])
        at = d.argmin(1)
        best, number = d[np.arange(len(d)), at], numbers[at]
        own, own_distance = cluster[~full], distance[~full]
        better = (best < own_distance) | (best == own_distance) & (number < own)
        cluster[~full], distance[~full] = np.where(better, number, own), np.where(better, best, own_distance)
    return cluster, distance


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.int64)


def _assign(centroids: np.ndarray, changed: np.ndarray, dims: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            old = batch.column(2).to_numpy().astype(np.int64)
            cluster, distance = reassign(_matrix(batch.column(1), dims), old, batch.column(3).to_numpy(), centroids, changed)
            left = np.where(cluster == old, -2, old)  # -2: stayed, -1: is new
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(left, pa.int32())], [x.split()[0] for x in STATE.split(", ")])

    return rows


def _transfers(k: int, dims: int):
    """Per task: cluster, component (dims: the count, dims + 1: vectors that moved), signed total."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([_matrix(batch.column(0), dims), np.ones((batch.num_rows, 2), np.int64)])
            np.add.at(total, batch.column(1).to_numpy(), x)
            left = batch.column(2).to_numpy()
            x[:, dims + 1] = 0
            np.subtract.at(total, left[left >= 0], x[left >= 0])
        cluster, component = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(total[cluster, component], pa.int64())], ["cluster", "component", "n"])

    return rows


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> Clusters:
    """Lloyd's algorithm for a number of rounds, and a last assignment."""
    if k < 1 or dims < 1 or rounds < 0:
        raise ValueError("k and dims must be positive, rounds not negative")
    start = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, dims=dims, scale=scale)
    first = start.orderBy(*starting_order(seed)).limit(k).collect()
    centroids = np.array([r["vector"] for r in first], np.int64).reshape(-1, dims)
    none = lambda kind: F.lit(-1).cast(kind)
    state = start.select("vec_id", "vector", none("int").alias("cluster"), none("long").alias("distance"), none("int").alias("left"))
    if not len(centroids):
        return Clusters(state.where("false"), centroids, [], [], [])
    sums, changed, moved, drop = np.zeros((len(centroids), dims + 2), np.int64), np.ones(len(centroids), bool), [], None
    for number in range(rounds + 1):
        following = state.mapInArrow(_assign(centroids, changed, dims), STATE)
        if number == rounds:
            state = settle(following)
        else:
            state, drop_next = written(following)
            if drop:
                drop()
            drop = drop_next
        change = state.where("left <> -2").select("vector", "cluster", "left").mapInArrow(_transfers(len(centroids), dims), "cluster int, component int, n long")
        for r in change.groupBy("cluster", "component").agg(F.sum("n").alias("n")).collect():
            sums[r["cluster"], r["component"]] += r["n"]
        moved.append(int(sums[:, dims + 1].sum()) - sum(moved))
        if number == rounds:
            break
        following_centroids = centroids.copy()
        some = sums[:, dims] > 0
        following_centroids[some] = sums[some, :dims] // sums[some, dims : dims + 1]
        changed = (following_centroids != centroids).any(1)
        centroids = following_centroids
    if drop:
        drop()
    inertia = [0] * len(centroids)
    for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect():
        inertia[r["cluster"]] = int(r["n"])
    return Clusters(state.drop("left"), centroids, inertia, sums[:, dims].tolist(), moved)


def labelled(clusters: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size of each vector; the table of k clusters is broadcast."""
    spark = clusters.assigned.sparkSession
    all_of_it = sum(clusters.inertia)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    table = [(j, clusters.inertia[j], all_of_it, digest(c), clusters.sizes[j]) for j, c in enumerate(clusters.centroids)]
    about = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return clusters.assigned.drop("vector").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")
