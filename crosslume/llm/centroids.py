"""Exact k-means on whole numbers, with bounds that geometric drift loosens.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to all
others. When centroids have moved, the upper bound grows by the drift of the own centroid. The lower
bound need not shrink by the full drift of the others: the vectors of a cluster lie in a sphere around its old
centroid, and seen from a moving centroid the sphere fills a cone. A step of length s at an angle t to a
vector shortens the distance to it by at most s * cos(t); in the plane of the old centroid, the moved one and
the sphere's center, the smallest angle to any vector of the sphere is that to the center less that of the cone.
Vectors whose bounds still keep apart stay where they are; the others get their own distance computed,
and if that does not do, are scanned exactly against all centroids.

A round is one pass over packed blocks of vectors without a shuffle; blocks carry the bounds, and the tasks'
sums of vectors by cluster are added up as whole numbers. Only centroids and these sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslume.llm.vectors import exact_type, largest, usable, whole
from crosslume.sources.staging import stage

BLOCK = 4096  # vectors packed into a row
STEPS = 8  # pieces of a centroid's way, each with its own cone

_BLOCKS = "n int, ids binary, named binary, vectors binary, cluster binary, upper binary, lower binary, scanned long, sums binary"
_SUMS = "cluster int, place int, total decimal(38,0)"


class Move(NamedTuple):
    """Old and new centroids, what lower bounds lose by cluster, and the drift of each centroid."""

    centroids: np.ndarray
    loss: np.ndarray
    drift: np.ndarray


def shortening(centers: np.ndarray, radii: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """At most how much closer a centroid gets to any point of a sphere when it moves from old to new.

    (sphere, centroid); negative where it surely goes away. Both the angle to the center, which only grows on
    the way, and the nearest distance bound each of ``STEPS`` pieces of the way.
    """
    way = new - old
    length = np.sqrt((way**2).sum(1))
    to = centers[:, None, :] - old[None, :, :]
    square = (to**2).sum(2)
    unit = way / np.maximum(length, 1e-300)[:, None]
    along = np.einsum("ijk,jk->ij", to, unit)
    across = np.sqrt(np.maximum(square - along**2, 0))
    lost = np.zeros_like(along)
    for i in range(STEPS):
        a, b = length * i / STEPS, length * (i + 1) / STEPS
        angle = np.arctan2(across, along - a)
        gap = np.where((along > a) & (along < b), 0.0, np.minimum(np.abs(along - a), np.abs(along - b)))
        near = np.sqrt(across**2 + gap**2)
        ratio = radii[:, None] / np.maximum(near, 1e-300)
        cone = np.where(ratio < 1, np.arcsin(np.minimum(ratio, 1)), np.pi)
        lost += length / STEPS * np.cos(np.maximum(angle - cone, 0))
    # Some room for rounding; never more than the whole drift.
    return np.minimum(lost + 1e-9 * (length + np.sqrt(square)), length)


def move(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> Move:
    """``radii``: of spheres around the old centroids that hold all their vectors."""
    k = len(old)
    lost = shortening(old.astype(np.float64), radii, old.astype(np.float64), new.astype(np.float64))
    lost[np.arange(k), np.arange(k)] = -np.inf
    drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))
    return Move(new, lost.max(1) if k > 1 else np.zeros(k), drift)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vector by centroid."""
    kind = exact_type(4 * x.shape[1], largest(x) + largest(centroids), largest(x) + largest(centroids))
    kind = np.float64 if kind is np.float32 else kind
    x, c = x.astype(kind), centroids.astype(kind)
    return ((x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None, :]).astype(np.int64)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (the first of a tie), its distance and that of the next one."""
    far = distances(x, centroids)
    best = far.argmin(1)
    here = np.arange(len(x))
    upper = np.sqrt(far[here, best].astype(np.float64))
    far[here, best] = np.iinfo(np.int64).max
    lower = np.sqrt(far.min(1).astype(np.float64)) if far.shape[1] > 1 else np.full(len(x), np.inf)
    return best, upper, lower


def own_distance(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to its centroid."""
    return ((x.astype(np.int64) - centroids[cluster]) ** 2).sum(1)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Move) -> int:
    """Bring clusters and bounds up to date in place; returns how many vectors were scanned."""
    upper += step.drift[cluster]
    lower -= step.loss[cluster]
    apart = 1 - 1e-9  # a distance is exact to this share at least; ties are always scanned
    near = np.flatnonzero(upper >= lower * apart)
    upper[near] = np.sqrt(own_distance(x[near], step.centroids, cluster[near]).astype(np.float64))
    near = near[upper[near] >= lower[near] * apart]
    if len(near):
        cluster[near], upper[near], lower[near] = scan(x[near], step.centroids)
    return len(near)


def _sums(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    """By cluster: count, greatest upper bound (in whole numbers, rounded up) and sums of components."""
    out = np.zeros((k, x.shape[1] + 2), np.int64)
    order = np.argsort(cluster, kind="stable")
    own, start = np.unique(cluster[order], return_index=True)
    if len(own):
        out[own, 0] = np.diff(np.append(start, len(order)))
        out[own, 1] = np.ceil(np.maximum.reduceat(upper[order], start)).astype(np.int64) + 1
        out[own, 2:] = np.add.reduceat(x[order].astype(np.int64), start, axis=0)
    return out


def _block(ids, named, x, cluster, upper, lower, scanned, k) -> pa.RecordBatch:
    parts = [ids, named, x, cluster.astype(np.int32), upper, lower]
    columns = [pa.array([len(ids)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
    columns += [pa.array([scanned], pa.int64()), pa.array([_sums(x, cluster, upper, k).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _names(_BLOCKS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _first(shared, length: int):
    """Blocks out of rows, with a full scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                good, size = usable(part.column("vector"))
                rows = np.flatnonzero(good & (size == length))
                if not len(rows):
                    continue
                x = whole(part.column("vector"), rows, length)
                ids = part.column("id").take(pa.array(rows))
                named = np.asarray(ids.is_valid())
                ids = np.asarray(ids.fill_null(0)).astype(np.int64)
                yield _block(ids, named, x, *scan(x, centroids), len(rows), len(centroids))

    return run


def _unpack(row: dict, length: int) -> list[np.ndarray]:
    kinds = [np.int64, bool, np.int32, np.int32, np.float64, np.float64]
    ids, named, x, *state = (np.frombuffer(row[c], t).copy() for c, t in zip(_names(_BLOCKS)[1:7], kinds))
    return [ids, named, x.reshape(len(ids), length), *state]


def _again(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                ids, named, x, cluster, upper, lower = _unpack(batch.slice(at, 1).to_pylist()[0], length)
                scanned = reassign(x, cluster, upper, lower, step)
                yield _block(ids, named, x, cluster, upper, lower, scanned, len(step.centroids))

    return run


def _totals(blocks: DataFrame, k: int, length: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Counts, radii and exact sums by cluster, of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros((k, length + 1), object), np.zeros(k, np.int64)
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                own = np.frombuffer(sums, np.int64).reshape(k, length + 2)
                most = np.maximum(most, own[:, 1])
                total += np.delete(own, 1, axis=1)
        cluster, place = np.divmod(np.arange(k * (length + 1)), length + 1)
        cluster, place = np.append(cluster, np.arange(k)), np.append(place, np.full(k, -1))
        numbers = [int(v) for v in [*total.ravel(), *most]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(numbers, pa.decimal128(38, 0))],
            _names(_SUMS),
        )

    rows = blocks.select("sums").mapInArrow(run, _SUMS)
    total = F.when(F.col("place") < 0, F.max("total")).otherwise(F.sum("total"))
    got = {(r["cluster"], r["place"]): int(r["t"]) for r in rows.groupBy("cluster", "place").agg(total.alias("t")).collect()}
    counts = np.array([got.get((c, 0), 0) for c in range(k)])
    radii = np.array([float(got.get((c, -1), 0)) for c in range(k)])
    return counts, radii, [[got.get((c, i + 1), 0) for i in range(length)] for c in range(k)]


def _members(shared, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                ids, named, x, cluster, *_ = _unpack(batch.slice(at, 1).to_pylist()[0], length)
                far = own_distance(x, centroids, cluster)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=~named), pa.array(cluster), pa.array(far)], ["id", "cluster", "distance"]
                )

    return run


class Result(NamedTuple):
    """(id, cluster, distance) of every vector, the final centroids, and the vectors scanned in each pass."""

    members: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    length: int = 64,
    seed: int = 2,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> Result:
    """Lloyd's rounds from the ``k`` vectors with the least sha256 of ``<seed>:<id>``, in that order.

    Components x count as floor(256 * x). A round assigns every vector to the nearest centroid (the first of a
    tie), then puts every centroid with vectors at the floor of their mean; after the last round vectors are
    assigned once more. Vectors that are null, of another length, or have null, infinite or NaN components take
    no part. Repeated rows count each; of rows that share an id (and so the hash) the lesser vector comes
    first as a centroid; rows without id are clustered but begin no cluster. With fewer than ``k`` named
    vectors there are as many centroids; with none the result is empty. A component beyond 2**18 is an
    error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector")
    ).filter(F.size("vector") == length)
    finite = F.forall("vector", lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.filter(finite & F.col("id").isNotNull()).orderBy(digest, "vector").limit(k)
    picked = first.select("vector").toArrow().column("vector").combine_chunks()
    centroids = whole(picked, np.arange(len(picked)), length).astype(np.int64)
    k = len(centroids)
    if not k:
        return Result(spark.createDataFrame([], "id long, cluster int, distance long"), centroids, [])
    shared = spark.sparkContext.broadcast(centroids)
    blocks = stage(rows.mapInArrow(_first(shared, length), _BLOCKS), "centroids-blocks")
    shared.destroy()
    scanned = []
    for _ in range(rounds):
        counts, radii, sums = _totals(blocks, k, length)
        new = np.array([[s // n for s in row] if n else c.tolist() for n, row, c in zip(counts.tolist(), sums, centroids)])
        step = move(centroids, new, radii)
        centroids = new
        shared = spark.sparkContext.broadcast(step)
        blocks = stage(blocks.mapInArrow(_again(shared, length), _BLOCKS), "centroids-blocks")
        shared.destroy()
        scanned.append(blocks.agg(F.sum("scanned")).first()[0] or 0)
    shared = spark.sparkContext.broadcast(centroids)
    members = blocks.select(*_names(_BLOCKS)[:7]).mapInArrow(_members(shared, length), "id long, cluster int, distance long")
    return Result(members, centroids, scanned)
