"""Exact search for the greatest inner products: ball trees with branch and bound, one tree for each shard.

Vectors are dealt into cells that a tree over a bounded sample marks out, and cells into shards of at most
``SHARD`` rows. A shard is one row of a written table: its vectors in the order of a balanced ball tree, and the
centers and radii of the tree's nodes. No inner product with a vector of a ball exceeds
``query . center + |query| * radius``.

Queries go through the shards in blocks of bounded size. A first pass looks only at the best leaf of
each shard near the block; the k-th score it finds is shared with all tasks of the second pass, which
goes down the trees level by level, drops nodes that cannot reach the k-th score, and visits the
leaves left in the order of their bounds while the k-th score rises. The sample decides nothing but where
cells end: every row is indexed and every bound is a true one, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslume.llm.vectors import exact_type, largest, usable, whole
from crosslume.sources.staging import stage, stage_path

SHARD, LEAF = 4096, 64
SAMPLE = 4096  # rows that mark out cells
BLOCK_BYTES = 8 << 20  # of queries broadcast at once

_POINTS = "row long, id long, asks boolean, spread long, length int, cell int, vector binary"
_SHARDS = "length int, cell int, n int, rows binary, ids binary, named binary, vectors binary, centers binary, radii binary"
_FOUND = "query int, id long, score long"


class Tree(NamedTuple):
    """A balanced tree over rows: their order, and node by node (level by level) centers, radii and cuts."""

    order: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    axes: np.ndarray
    cuts: np.ndarray


def _ends(n: int, level: int) -> np.ndarray:
    return np.arange((1 << level) + 1) * n >> level


def grow(x: np.ndarray, depth: int) -> Tree:
    """Each node's rows are halved at the median along the line between two rows far apart.

    The sort is stable, so rows that are equal stay in the order they came in.
    """
    x = x.astype(np.float64)
    order = np.arange(len(x))
    centers, radii, axes, cuts = [], [], [], []
    for level in range(depth + 1):
        ends, halves = _ends(len(x), level), _ends(len(x), level + 1)[1::2]
        for a, b, half in zip(ends[:-1], ends[1:], halves):
            part = x[order[a:b]]
            center = part.mean(0) if b > a else np.zeros(x.shape[1])
            away = ((part - center) ** 2).sum(1)
            centers.append(center)
            radii.append(np.sqrt(away.max()) if b > a else 0.0)
            if level == depth:
                continue
            axis, cut = np.zeros(x.shape[1]), 0.0
            if b > a and radii[-1] > 0:
                one = part[away.argmax()]
                axis = part[((part - one) ** 2).sum(1).argmax()] - one
                along = part @ axis
                by = np.argsort(along, kind="stable")
                order[a:b] = order[a:b][by]
                cut = along[by[max(half - a - 1, 0)]]
            axes.append(axis)
            cuts.append(cut)
    return Tree(order, np.array(centers), np.array(radii), np.array(axes), np.array(cuts))


def cell_of(tree: Tree, x: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of the sample's tree each row falls into."""
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        right = np.einsum("ij,ij->i", x.astype(np.float64), tree.axes[node]) > tree.cuts[node]
        node = 2 * node + 1 + right
    return node - ((1 << depth) - 1)


class Best:
    """The k best of each query so far; ``floor`` is a score the k-th best surely reaches."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.zeros((n, k), np.int64)
        self.nameless = np.ones((n, k), bool)
        self.floor = floor

    def kth(self, which: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[which, -1], self.floor[which])

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        """Candidates in ascending order of id (those without one last) with their score for each query."""
        some = scores.max(1) >= self.kth(which)
        which, scores = which[some], scores[some]
        if not len(which):
            return
        first = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        score = np.hstack([self.score[which], np.take_along_axis(scores, first, 1)])
        id_ = np.hstack([self.id[which], ids[first]])
        none = np.hstack([self.nameless[which], nameless[first]])
        by = np.lexsort((id_, none, -score), axis=1)[:, : self.k]
        self.score[which] = np.take_along_axis(score, by, 1)
        self.id[which] = np.take_along_axis(id_, by, 1)
        self.nameless[which] = np.take_along_axis(none, by, 1)


class Shard:
    """A shard's row, unpacked."""

    def __init__(self, row: dict):
        n, length = row["n"], row["length"]
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nameless = ~np.frombuffer(row["named"], bool)
        self.x = np.frombuffer(row["vectors"], np.int32).reshape(n, length)
        self.radii = np.frombuffer(row["radii"], np.float64)
        self.centers = np.frombuffer(row["centers"], np.float64).reshape(len(self.radii), length)
        self.depth = len(self.radii).bit_length() - 1

    def bounds(self, level: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        own = slice((1 << level) - 1, (2 << level) - 1)
        centers, radii = self.centers[own], self.radii[own]
        size = np.sqrt((centers**2).sum(1)) + radii
        # Balls of equal rows have exact bounds; others get some room for rounding.
        return queries @ centers.T + norms[:, None] * (radii + 1e-9 * size * (radii > 0))


def search(shard: Shard, queries: np.ndarray, norms: np.ndarray, rows: np.ndarray, best: Best, probe: bool = False) -> int:
    """Offer to ``best`` what the shard holds; returns the number of products computed. A query never meets its own row."""
    active = np.arange(len(queries))
    keep = np.ones((len(queries), 1), bool)
    for level in range(shard.depth + 1):
        bound = shard.bounds(level, queries[active], norms[active])
        keep &= bound >= best.kth(active)[:, None]
        some = keep.any(1)
        active, keep, bound = active[some], keep[some], bound[some]
        if not len(active):
            return 0
        if level < shard.depth:
            keep = np.repeat(keep, 2, axis=1)
    bound = np.where(keep, bound, -np.inf)
    by = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, by, 1)
    ends = _ends(len(shard.x), shard.depth)
    kind = exact_type(shard.x.shape[1], largest(shard.x), largest(queries))
    x, done, at, width = shard.x.astype(kind), 0, 0, 1
    leaves = 1 if probe else by.shape[1]
    while at < leaves and len(active):
        to = min(at + width, leaves)
        open_ = bound[:, at:to] >= best.kth(active)[:, None]
        open_ &= np.isfinite(bound[:, at:to])
        who, which = np.nonzero(open_)
        leaf = by[who, at + which]
        for one in np.unique(leaf):
            a, b = ends[one], ends[one + 1]
            asking = active[who[leaf == one]]
            if shard.radii[(1 << shard.depth) - 1 + one] == 0:  # equal rows: of a tie only smaller ids matter
                asking = asking[_wins(shard, a, queries[asking], best, asking)]
            if a == b or not len(asking):
                continue
            scores = (queries[asking].astype(kind) @ x[a:b].T).astype(np.float64)
            done += scores.size
            scores[rows[asking][:, None] == shard.rows[None, a:b]] = -np.inf
            best.offer(asking, scores, shard.ids[a:b], shard.nameless[a:b])
        at, width = to, 2 * width
        if at < leaves:
            left = bound[:, at] >= best.kth(active)
            active, by, bound = active[left], by[left], bound[left]
    return done


def _wins(shard: Shard, a: int, queries: np.ndarray, best: Best, asking: np.ndarray) -> np.ndarray:
    """Whether the first of a leaf's equal rows comes before a query's k-th best so far."""
    score = queries.astype(np.float64) @ shard.x[a].astype(np.float64)
    tie = score == best.score[asking, -1]
    later = best.nameless[asking, -1] < shard.nameless[a]
    later |= (best.nameless[asking, -1] == shard.nameless[a]) & (best.id[asking, -1] <= shard.ids[a])
    return ~(tie & later)


def _points(trees: dict[int, tuple[Tree, int]]):
    """Whole-numbered vectors with their cells; rows that are no vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            good, size = usable(vectors)
            for length in np.unique(size[good]):
                at = np.flatnonzero(good & (size == length))
                x = whole(vectors, at, int(length))
                tree, depth = trees.get(int(length), (None, 0))
                cell = cell_of(tree, x, depth) if depth else np.zeros(len(at), np.int64)
                part = batch.select(["row", "id", "asks", "spread"]).take(pa.array(at))
                width = 4 * int(length)
                data = x.tobytes()
                packed = [data[i * width : (i + 1) * width] for i in range(len(at))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(np.full(len(at), length, np.int32)),
                        pa.array(cell.astype(np.int32)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["row", "id", "asks", "spread", "length", "cell", "vector"],
                )

    return run


def _pack(shard: int, leaf: int):
    """Rows sorted by length and cell, into shards of at most ``shard`` rows with their trees."""

    def shard_of(held: list[pa.RecordBatch], length: int, cell: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("id").combine_chunks()
        named = np.asarray(ids.is_valid())
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.int32).reshape(len(ids), length)
        first = np.lexsort((ids, ~named))
        depth = max(0, (-(-len(ids) // leaf) - 1).bit_length())
        tree = grow(x[first], depth)
        # Rows of a leaf stand in the order of ids, those without one last.
        place = np.arange(len(ids))
        where = np.repeat(place[: 1 << depth], np.diff(_ends(len(ids), depth)))
        order = first[tree.order[np.lexsort((tree.order, where))]]
        rows = np.asarray(table.column("row").combine_chunks()).astype(np.int64)
        parts = [rows[order], ids[order], named[order], x[order], tree.centers, tree.radii]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], pa.int32()) for v in (length, cell, len(ids))] + [pa.array([p.tobytes()], pa.binary()) for p in parts],
            ["length", "cell", "n", "rows", "ids", "named", "vectors", "centers", "radii"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            length, cell = np.asarray(batch.column("length")), np.asarray(batch.column("cell"))
            turn = np.flatnonzero((np.diff(length) != 0) | (np.diff(cell) != 0)) + 1
            for a, b in zip([0, *turn], [*turn, batch.num_rows]):
                if a == b:
                    continue
                own = (int(length[a]), int(cell[a]))
                if held and own != key:
                    yield shard_of(held, *key)
                    held, size = [], 0
                key = own
                while a < b:
                    take = min(b - a, shard - size)
                    held.append(batch.slice(a, take))
                    a, size = a + take, size + take
                    if size == shard:
                        yield shard_of(held, *key)
                        held, size = [], 0
        if held:
            yield shard_of(held, *key)

    return run


def _search(shared, k: int, probe: bool):
    """The task's k best of every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries, floor = shared.value
        real = queries.astype(np.float64)
        norms = np.sqrt((real**2).sum(1))
        best = Best(len(rows), k, floor)
        for batch in batches:
            for row in batch.to_pylist():
                search(Shard(row), real, norms, rows, best, probe)
        query, place = np.nonzero(np.isfinite(best.score) & (best.score >= floor[:, None]))
        if len(query):
            ids = pa.array(best.id[query, place], mask=best.nameless[query, place])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query.astype(np.int32)), ids, pa.array(best.score[query, place].astype(np.int64))],
                ["query", "id", "score"],
            )

    return run


def index(
    vectors: DataFrame, is_query: Column, id_column: str, column: str, shard: int, leaf: int
) -> tuple[DataFrame, DataFrame]:
    """The written shards, and the written queries with their cells."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
        F.col(column).cast("array<double>").alias("vector"),
    )
    total = rows.count()
    some = rows.select("vector").sample(False, min(1.0, 2 * SAMPLE / max(total, 1)), 7).limit(SAMPLE).toArrow()
    picked = some.column("vector").combine_chunks()
    good, size = usable(picked)
    deepest = max(0, (total // shard).bit_length())
    trees = {}
    for length in np.unique(size[good]):
        at = np.flatnonzero(good & (size == length))
        depth = min(deepest, max(0, (len(at) // 4).bit_length() - 1))
        trees[int(length)] = (grow(whole(picked, at, int(length)), depth), depth)
    points = stage(rows.mapInArrow(_points(trees), _POINTS), "ball-points")
    # Ranges over (length, cell, spread) cut a large cell into as many tasks as it takes.
    sorted_ = points.repartitionByRange("length", "cell", "spread").sortWithinPartitions("length", "cell", "spread")
    shards = stage(sorted_.mapInArrow(_pack(shard, leaf), _SHARDS), "ball-shards")
    return shards, points.filter("asks")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    column: str = "embedding",
    shard: int = SHARD,
    leaf: int = LEAF,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: the ``k`` greatest inner products of each query.

    Components x count as floor(256 * x). Queries are the rows for which ``is_query`` holds; each meets all rows
    but itself. Ties go to smaller ids; rows without id are candidates, after all others of a tie, and
    no queries unless ``is_query`` makes them so. Each of repeated rows is a query and a candidate of its own. Null
    vectors and those with null, infinite or NaN components take no part; vectors of different length
    are never compared (empty ones score 0 with each other). A component beyond 2**18 is an error, as its
    products may not fit. A query without candidates has no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    shards, asking = index(vectors, is_query, id_column, column, shard, leaf)
    counts = asking.groupBy("length", "cell").count().collect()  # no more than cells
    lengths = sorted({r["length"] for r in counts})
    path, wrote = stage_path(spark, "ball-found"), False
    for length in lengths:
        own = {r["cell"]: r["count"] for r in counts if r["length"] == length}
        at_once = max(1, block_bytes // max(8 * length, 8))
        # Neighbouring cells share blocks until those are full; a cell with more queries has several.
        group, groups, filled = {}, 0, 0
        for cell in sorted(own):
            if filled and filled + own[cell] > at_once:
                groups, filled = groups + 1, 0
            group[cell], filled = groups, filled + own[cell]
        cells = [[c for c in group if group[c] == g] for g in range(groups + 1)]
        sizes = [sum(own[c] for c in cs) for cs in cells]
        for cs, size in zip(cells, sizes):
            parts = -(-size // at_once)
            some = asking.filter((F.col("length") == length) & F.col("cell").isin(cs))
            for part in range(parts):
                block = some.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).select("row", "id", "vector")
                table = block.toArrow().combine_chunks().sort_by("row")
                if not table.num_rows:
                    continue
                rows = np.asarray(table.column("row").combine_chunks()).astype(np.int64)
                ids = table.column("id").combine_chunks()
                x = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.int32).reshape(len(rows), length)
                floor = np.full(len(rows), -np.inf)
                place = Window.partitionBy("query").orderBy(F.desc("score"))
                for probe in (True, False):
                    shared = spark.sparkContext.broadcast((rows, x, floor))
                    near = shards.filter(F.col("length") == length)
                    near = near.filter(F.col("cell").isin(cs)) if probe else near
                    found = near.mapInArrow(_search(shared, k, probe), _FOUND)
                    if probe:
                        kth = found.withColumn("place", F.row_number().over(place)).filter(F.col("place") == k)
                        for r in kth.select("query", "score").collect():  # one for each query of the block
                            floor[r["query"]] = r["score"]
                    else:
                        names = spark.createDataFrame(
                            pa.table({"query": pa.array(np.arange(len(rows), dtype=np.int32)), "row": rows, "query_id": ids})
                        )
                        found.join(F.broadcast(names), "query").select("row", "query_id", "id", "score").write.mode(
                            "append"
                        ).parquet(path)
                        wrote = True
                    shared.destroy()
    schema = "row long, query_id long, id long, score long"
    found = spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
