"""Centroid clustering with Drake's adaptive bounds, on integer vectors and exact distances.

Each vector keeps its centroid with an upper bound of its distance, several next centroids with a lower bound
each, and one lower bound for all the rest. When centroids move, bounds move by as much; only where the order
can't be told from the bounds are distances taken anew: of the listed centroids up to the last one in doubt,
or of all of them when the bound of the rest is in doubt. Distances are compared as exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, ship, trimmed

#: Greatest size of a component: squares of differences of 64 of them still add up within a long.
MOST = 1 << 27
#: Bounds are floats of distances under 2**32, so a dozen roundings stay far under this.
SLACK = 1e-4
#: Vectors handled at once.
BLOCK = 4096

_STATE = "vec_id long, vector array<int>, near array<int>, bounds array<double>, used int"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, vector of floor(scale * x)): vectors of exactly `dims` components, none null or non-finite."""
    x = F.transform(F.col("v"), lambda c: c.cast("double"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    narrow = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v"))
    kept = narrow.where((F.size("v") == dims) & ~F.coalesce(bad, F.lit(True)))

    def whole(c: Column) -> Column:
        big = F.raise_error(F.lit(f"a component is over {MOST} after scaling")).cast("int")
        return F.when(F.abs(c * scale) < MOST, F.floor(c * scale).cast("int")).otherwise(big)

    return kept.select("vec_id", F.transform(x, whole).alias("vector"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x from each row of c, as longs."""
    big = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * big * big * max(1, x.shape[1]) < 1 << 53:  # every partial sum is a whole number that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for k in range(len(c)):
        out[:, k] = ((x.astype(np.int64) - c[k]) ** 2).sum(1)
    return out


def _own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) - c) ** 2).sum(-1)


def scan(x: np.ndarray, c: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(near, bounds) by all distances: the nearest centroid and the b next ones; ties go to smaller numbers.

    bounds: upper bound of the first, lower bounds of the next b, lower bound of all others.
    """
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")[:, : b + 2]
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    if far.shape[1] < b + 2:  # every centroid is listed: nothing is left for the last bound
        far = np.concatenate([far, np.full((len(x), b + 2 - far.shape[1]), np.inf)], axis=1)
    return order[:, : b + 1].astype(np.int32), far


def rescan(x: np.ndarray, c: np.ndarray, moved: np.ndarray, near: np.ndarray, bounds: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, bounds, used) after centroids moved to c by `moved`: used is the listed centroids looked at, -1 for all.

    Lists are cut to b next centroids first; the bound of what is cut off joins the last one.
    """
    if near.shape[1] > b + 1:
        bounds = np.concatenate([bounds[:, : b + 1], bounds[:, b + 1 :].min(1, keepdims=True)], axis=1)
        near = near[:, : b + 1]
    near, bounds = near.copy(), bounds.copy()
    bounds[:, 0] += moved[near[:, 0]]
    bounds[:, 1:-1] -= moved[near[:, 1:]]
    bounds[:, -1] -= moved.max()
    used = np.zeros(len(x), np.int32)
    doubt = np.flatnonzero(bounds[:, 1:].min(1) <= bounds[:, 0] + SLACK)
    bounds[doubt, 0] = np.sqrt(_own_squared(x[doubt], c[near[doubt, 0]]).astype(np.float64))  # a tight bound may settle it
    doubt = doubt[bounds[doubt, 1:].min(1) <= bounds[doubt, 0] + SLACK]
    every = bounds[doubt, -1] <= bounds[doubt, 0] + SLACK
    rows = doubt[every]
    if len(rows):
        near[rows], bounds[rows] = scan(x[rows], c, near.shape[1] - 1)
        used[rows] = -1
    rows = doubt[~every]
    if len(rows):
        open_ = bounds[rows, 1:-1] <= bounds[rows, :1] + SLACK
        last = open_.shape[1] - np.argmax(open_[:, ::-1], axis=1)  # the last listed centroid in doubt
        used[rows] = last
        for z in np.unique(last).tolist():
            some = rows[last == z]
            listed = near[some, : z + 1]
            d = np.stack([_own_squared(x[some], c[listed[:, j]]) for j in range(z + 1)], axis=1)
            order = np.lexsort((listed, d), axis=1)
            near[some, : z + 1] = np.take_along_axis(listed, order, 1)
            bounds[some, : z + 1] = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    return near, bounds, used


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            yield batch.slice(a, BLOCK)


def _assigned(state: DataFrame, centres: np.ndarray, moved: np.ndarray | None, b: int) -> DataFrame:
    """The state after one more assignment; without bounds yet (no `moved`) by all distances."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            vector = batch.column("vector")
            x = _matrix(vector, centres.shape[1])
            if moved is None:
                near, bounds = scan(x, centres, b)
                used = np.full(len(x), -1, np.int32)
            else:
                lists = batch.column("near"), batch.column("bounds")
                width = len(lists[0].flatten()) // len(x)
                near, bounds, used = rescan(x, centres, moved, _matrix(lists[0], width), _matrix(lists[1], len(lists[1].flatten()) // len(x)), b)
            columns = [batch.column("vec_id"), vector, _lists(near, pa.int32()), _lists(bounds, pa.float64()), pa.array(used)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "near", "bounds", "used"])

    return state.mapInArrow(trimmed(run), _STATE)


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums of each centroid's vectors, their counts, most listed centroids that a rescan looked at).

    A task sends one row a centroid, and the driver gets k * dims numbers.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        total, count, used = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for batch in _blocks(batches):
            own = batch.column("near").flatten().to_numpy().reshape(batch.num_rows, -1)[:, 0]
            np.add.at(total, own, _matrix(batch.column("vector"), dims))
            count += np.bincount(own, minlength=k)
            used = max(used, int(batch.column("used").to_numpy().max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), _lists(total, pa.int64()), pa.array(np.full(k, used))], ["c", "n", "total", "used"])

    parts = state.mapInArrow(run, "c long, n long, total array<long>, used long")
    got = parts.select("c", "n", "used", F.posexplode("total").alias("dim", "x")).groupBy("c", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.max("used").alias("used")).collect()
    total, count, used = np.zeros((k, dims), object), np.zeros(k, object), 0
    for r in got:
        total[r["c"], r["dim"]], count[r["c"]], used = r["x"], r["n"], max(used, r["used"])
    return total, count, used


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding", stats: list[dict] | None = None) -> DataFrame:
    """One row a vector of `dims` finite components: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components are floor(scale * x). Centroids start as the k vectors of the smallest SHA-256 of `seed:vec_id`,
    in that order (a null id is hashed as `seed:`; ties by the vector). Each round assigns every vector to the
    nearest centroid (ties: smaller number) and replaces centroids by the floor of their vectors' mean; one
    without vectors stays. A last assignment follows. Fewer than k vectors give fewer centroids. Vectors that
    are null, of another length, or with a null or non-finite component give no row; repeated rows and null ids
    give a row each; an empty table gives none. A component over 2**27 after scaling is an error, as distances
    would not be longs. `stats` gets a row a round: centroids listed, most that were looked at.

    Between rounds the vectors with their bounds are a table in the shared folder; centroids (k rows) are the
    only thing that the driver holds.
    """
    ship(rows.sparkSession)
    vectors = cut(whole_vectors(rows, id_col, vector_col, dims, scale))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(place, "vector").limit(k).collect()
    if not first:
        return _report(vectors.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long")), [])
    centres = np.array([r["vector"] for r in first], np.int64)
    k = len(centres)
    least, b = min(max(1, k // 8), k - 1), min(max(1, k // 4), k - 1)
    state, moved = vectors, None
    for _ in range(rounds):
        before, state = state, cut(_assigned(state, centres, moved, b))
        discard(before)
        total, count, used = _sums(state, k, dims)
        if stats is not None:
            stats.append({"listed": b, "used": used, "moved": None if moved is None else float(moved.max())})
        if moved is not None:
            b = min(b, max(least, used))
        new = np.array([[int(x) // int(n) for x in t] if n else old.tolist() for t, n, old in zip(total, count, centres, strict=True)], np.int64)
        moved = np.sqrt(_own_squared(new, centres).astype(np.float64))
        centres = new
    before, state = state, cut(_assigned(state, centres, moved, b))
    discard(before)
    assigned = cut(_distances(state, centres))
    discard(state)
    return _report(assigned, centres.tolist())


def _distances(state: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            own = batch.column("near").flatten().to_numpy().reshape(batch.num_rows, -1)[:, 0]
            d = _own_squared(_matrix(batch.column("vector"), centres.shape[1]), centres[own])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own), pa.array(d)], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def _report(assigned: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Adds the inertia of each cluster and of all, and the centroid's hash: one row a centroid is joined."""
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = assigned.agg(F.sum("distance").alias("inertia"))
    shas = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres)]
    named = assigned.sparkSession.createDataFrame(shas, "cluster int, centroid_sha256 string")
    small = own.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(inertia))  # one row
    return assigned.select("vec_id", "cluster", "distance").join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
