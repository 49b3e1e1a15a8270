"""Centroid clustering with Yinyang bounds, on whole numbers.

Centroids are put into groups once. Every vector keeps an upper bound of the distance to
its own centroid and one lower bound for each group. After a round bounds are loosened by
how far centroids moved. If no group can hold a nearer centroid the vector is done
(global filter); else groups that can't are passed over (group filter), and of the rest
only centroids that may be nearer by the group's former bound are measured exactly.
Bounds only decide what is measured, with slack for rounding; distances are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import discard, shared_dir, written

#: Components of a vector, units of one, clusters, rounds, groups of centroids.
SIZE, UNIT, CLUSTERS, ROUNDS, GROUPS = 64, 64, 16, 3, 4
#: Vectors with a component of more units aren't kept: distances and sums stay exact longs.
MOST = 1 << 27
#: Products of components up to this, summed over a vector, are exact in doubles.
EXACT = 1 << 22
_SLACK = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, measured int, distance long"


def kept_vectors(vectors: DataFrame, size: int = SIZE, unit: int = UNIT) -> DataFrame:
    """vec_id and v, the components as whole units; rows without exactly `size` finite components (each within MOST units) are left out."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * unit <= MOST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.coalesce((F.size(x) == size) & sound, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * unit).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: str = "1:") -> np.ndarray:
    """The vectors with the smallest SHA-256 of seed and vec_id, as rows; equal hashes by components, null ids last; fewer vectors give fewer centroids."""
    hashed = kept.select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "v")
    rows = hashed.orderBy(F.asc_nulls_last("hash"), "v").limit(clusters).collect()  # one row a cluster
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each point and a column for each centre."""
    if not len(points) or max(np.abs(points).max(), np.abs(centres).max()) <= EXACT:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        own, far = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", c, c)
        return (own[:, None] - 2 * (p @ c.T) + far[None, :]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)


def grouped(centres: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering of the centroids themselves, once."""
    seeds = centres[: max(1, min(groups, len(centres)))].astype(np.float64)
    own = np.zeros(len(centres), dtype=np.int64)
    for _ in range(rounds):
        own = ((centres[:, None, :] - seeds[None]) ** 2).sum(axis=2).argmin(axis=1)
        seeds = np.stack([centres[own == g].mean(axis=0) if (own == g).any() else seeds[g] for g in range(len(seeds))])
    return own


def _group_least(by_centre: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.stack([by_centre[:, group == g].min(axis=1) if (group == g).any() else np.full(len(by_centre), np.inf) for g in range(group.max() + 1)], axis=1)


def assigned(points: np.ndarray, centres: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """cluster, upper, lower, measured: every centroid measured; ties go to the smaller number."""
    exact = squared(points, centres)
    own, at = exact.argmin(axis=1), np.arange(len(points))
    reach = np.sqrt(exact.astype(np.float64))
    upper = reach[at, own]
    reach[at, own] = np.inf
    return own, upper, _group_least(reach, group), np.full(len(points), len(centres))


def reassigned(points: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, group: np.ndarray, drift: np.ndarray, path: float) -> tuple[np.ndarray, ...]:
    """The same after centroids moved by `drift` (by `path` at most since the first round), measuring only what bounds can't rule out."""
    loose = np.array([drift[group == g].max() if (group == g).any() else 0.0 for g in range(group.max() + 1)])
    upper, fallen, own, measured = upper + drift[own], lower - loose, own.copy(), np.zeros(len(points), dtype=np.int64)
    slack = lambda u: u + _SLACK * (1 + u + path)
    need = np.flatnonzero(fallen.min(axis=1) <= slack(upper))
    if not len(need):
        return own, upper, fallen, measured
    exact_own = ((points[need] - centres[own[need]]) ** 2).sum(axis=1)
    upper[need] = np.sqrt(exact_own.astype(np.float64))
    measured[need] = 1
    still = fallen[need].min(axis=1) <= slack(upper[need])
    need, exact_own = need[still], exact_own[still]
    if len(need):
        at, limit, before = np.arange(len(need)), slack(upper[need]), own[need]
        bound = lower[need][:, group] - drift  # of each centroid, by its group's former bound
        open_ = (fallen[need] <= limit[:, None])[:, group] & (bound <= limit[:, None])
        open_[at, before] = False
        exact = np.full(bound.shape, np.iinfo(np.int64).max)
        exact[at, before] = exact_own
        bound[at, before] = upper[need]
        for j in np.flatnonzero(open_.any(axis=0)):
            rows = np.flatnonzero(open_[:, j])
            exact[rows, j] = squared(points[need[rows]], centres[j : j + 1])[:, 0]
            bound[rows, j] = np.sqrt(exact[rows, j].astype(np.float64))
        now = exact.argmin(axis=1)
        own[need], upper[need] = now, bound[at, now]
        bound[at, now] = np.inf
        fallen[need] = _group_least(bound, group)
        measured[need] += open_.sum(axis=1)
    return own, upper, fallen, measured


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).astype(np.int64).reshape(batch.num_rows, -1)


def _round(state: DataFrame, centres: np.ndarray, group: np.ndarray, drift: np.ndarray | None, path: float) -> DataFrame:
    """One assignment of all vectors as a map over batches; centroids (a row a cluster) go with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch)
            if drift is None:
                own, upper, lower, measured = assigned(points, centres, group)
            else:
                flat = np.asarray(batch.column("lower").flatten()).reshape(batch.num_rows, -1)
                own, upper, lower, measured = reassigned(points, np.asarray(batch.column("cluster")), np.asarray(batch.column("upper")), flat, centres, group, drift, path)
            distance = ((points - centres[own]) ** 2).sum(axis=1)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, lower.size + 1, lower.shape[1]), pa.int32()), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper), bounds, pa.array(measured, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "cluster", "upper", "lower", "measured", "distance"])

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Floors of the means of each cluster's vectors; a centroid without vectors stays. Tasks add up their own first."""
    clusters, size = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((clusters, size), dtype=np.int64), np.zeros(clusters, dtype=np.int64)
        for batch in batches:
            own = np.asarray(batch.column("cluster"))
            order = np.argsort(own, kind="stable")
            some, starts = np.unique(own[order], return_index=True)
            if len(some):
                sums[some] += np.add.reduceat(_points(batch)[order], starts, axis=0)
                counts += np.bincount(own, minlength=clusters)
        full = np.flatnonzero(counts)
        offsets = pa.array(np.arange(0, size * len(full) + 1, size), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(sums[full].ravel())), pa.array(counts[full])], names=["cluster", "sums", "n"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, sums array<long>, n long")
    added = parts.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centres.copy()
    for r in added.collect():  # clusters x components
        out[r.cluster, r["at"]] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, size: int = SIZE, unit: int = UNIT, clusters: int = CLUSTERS, rounds: int = ROUNDS, groups: int = GROUPS) -> DataFrame:
    """vec_id, cluster, distance (squared), measured (centroids that the last assignment measured), cluster_inertia, inertia, centroid_sha256.

    A row for each kept row, repeated ones too; vectors with a null, NaN, infinite or absent
    component, or of another length, have none; no vectors give no rows. Other columns
    aren't read. State is written each round and the former one deleted.
    """
    spark = vectors.sparkSession
    path = shared_dir(spark, "vectors")
    state = written(kept_vectors(vectors, size, unit), path)
    centres = first_centroids(state, clusters)
    if not len(centres):
        empty = "vec_id long, cluster int, distance long, measured int, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    group, drift, moved = grouped(centres, groups), None, 0.0
    for k in range(rounds + 1):
        to = shared_dir(spark, "vectors")
        state = written(_round(state, centres, group, drift, moved), to)
        discard(spark, path)
        path = to
        if k < rounds:
            now = _means(state, centres)
            drift = np.sqrt(((now - centres) ** 2).sum(axis=1).astype(np.float64))
            centres, moved = now, moved + float(drift.max())
    sums = dict(state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect())  # one row a cluster
    told = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance", "measured").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "measured", "cluster_inertia", "inertia", "centroid_sha256")
