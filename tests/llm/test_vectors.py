"""Exact search and exact k-means against brute force, on odd vectors too."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosslume.llm import ball_tree, centroids

SCHEMA = "vec_id long, embedding array<float>, score long, rows string"
ODD = [
    (900, None), (950, [1.0, None, 2.0]), (1000, [math.nan, 0.0, 0.0]), (1050, [math.inf, 0.0, 0.0]),
    (1100, []), (1101, []), (1150, [1.0]), (1151, [2.0, 1.0]),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], SCHEMA)


def some(n, length, seed, ids=None):
    x = np.random.default_rng(seed).normal(0, 1, (n, length)).astype(np.float32).round(2)
    return [(i if ids is None else ids[i], [float(a) for a in v]) for i, v in enumerate(x)]


def good(v):
    return v is not None and all(a is not None and math.isfinite(a) for a in v)


def whole(v):
    return [math.floor(256 * float(np.float32(a))) for a in v]


def best(rows, k=5):
    """Sorted (query, rank, id, score) by comparing everything."""
    own = [(i, whole(v)) for i, v in rows if good(v)]
    out = []
    for n, (i, q) in enumerate(own):
        if i is None or i % 50:
            continue
        found = [(-sum(a * b for a, b in zip(q, v)), j is None, j) for m, (j, v) in enumerate(own) if m != n and len(v) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=str)


def searched(spark, rows, **options):
    found = ball_tree.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_search_equals_brute_force(spark):
    rows = some(700, 6, 1) + ODD
    # Few and many shards, leaves of few rows, blocks of few queries.
    for options in ({}, {"shard": 40, "leaf": 3, "block_bytes": 8 * 6 * 4}, {"shard": 1, "leaf": 1}):
        assert searched(spark, rows[:300] + ODD if options.get("shard") == 1 else rows, **options) == best(
            rows[:300] + ODD if options.get("shard") == 1 else rows
        )


def test_search_with_ties_repeats_and_rows_without_id(spark):
    same = [(i, [0.5, -0.25]) for i in range(0, 400, 7)]
    rows = same + [(50, [0.5, -0.25]), (50, [0.5, -0.25]), (50, [1.0, 0.0]), (None, [0.5, -0.25]), (None, [2.0, -2.0])]
    want = best(rows)
    assert searched(spark, rows, shard=16, leaf=2) == searched(spark, rows) == want
    # Equal rows reach each other by the smallest ids.
    assert [(r[1], r[2]) for r in want if r[0] == 350 and r[2] is not None][:1] == [(2, 50)]


def test_search_of_little(spark):
    assert searched(spark, []) == searched(spark, [(1, [1.0])]) == searched(spark, [(50, [1.0])]) == []
    assert searched(spark, [(50, [1.0]), (3, [-2.0])]) == [(50, 1, 3, -(256 * 512))]
    with pytest.raises(Exception, match="beyond"):
        searched(spark, [(50, [1e9]), (3, [1.0])])


def test_search_skips_most_of_what_is_far_away():
    random = np.random.default_rng(3)
    x = (random.normal(0, 1, (32, 8))[:, None, :] * 40 + random.normal(0, 1, (32, 64, 8))).reshape(-1, 8).astype(np.int32)
    tree = ball_tree.grow(x, 6)
    order = tree.order
    shard = ball_tree.Shard(
        {
            "n": len(x), "length": 8, "rows": order.astype(np.int64).tobytes(), "ids": order.astype(np.int64).tobytes(),
            "named": np.ones(len(x), bool).tobytes(), "vectors": x[order].tobytes(),
            "radii": tree.radii.tobytes(), "centers": tree.centers.tobytes(),
        }
    )
    queries = x[::50].astype(float)
    norms = np.sqrt((queries**2).sum(1))
    found = ball_tree.Best(len(queries), 5, np.full(len(queries), -np.inf))
    done = ball_tree.search(shard, queries, norms, np.arange(len(x))[::50], found)
    assert done < 0.35 * len(queries) * len(x)
    # A score the k-th best surely reaches saves more, and a ball that cannot reach it is not opened.
    again = ball_tree.Best(len(queries), 5, found.score[:, -1].copy())
    assert ball_tree.search(shard, queries, norms, np.arange(len(x))[::50], again) <= done
    assert (again.score == found.score).all()
    none = ball_tree.Best(len(queries), 5, np.full(len(queries), 1e12))
    assert ball_tree.search(shard, queries, norms, np.arange(len(x))[::50], none) == 0


def lloyd(rows, k, rounds, length, seed=2):
    own = [(i, np.array(whole(v), object)) for i, v in rows if good(v) and len(v) == length]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), list(v)) for i, v in own if i is not None)
    centers = [np.array(v, object) for _, v in named[:k]]

    def nearest(v):
        return min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in own]
        for j in range(len(centers)):
            members = [v for (_, v), a in zip(own, at) if a == j]
            if members:
                centers[j] = sum(members) // len(members)
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in own), key=str), [list(c) for c in centers]


@pytest.mark.parametrize("k, rounds, n", [(7, 4, 400), (40, 5, 300), (5, 3, 3), (1, 2, 20)])
def test_clusters_equal_brute_force(spark, k, rounds, n):
    rows = some(n, 3, k) + [(7, [0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.25]), (None, [0.1, 0.2, 0.3]), *ODD]
    found = centroids.cluster(table(spark, rows), k, rounds, length=3)
    members, centers = lloyd(rows, k, rounds, 3)
    assert found.centroids.tolist() == centers
    assert sorted((tuple(r) for r in found.members.collect()), key=str) == members


def test_clusters_of_ties_and_of_nothing(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(60)]
    found = centroids.cluster(table(spark, rows), 6, 3, length=2)
    assert sorted((tuple(r) for r in found.members.collect()), key=str) == lloyd(rows, 6, 3, 2)[0]
    nothing = centroids.cluster(table(spark, ODD), 6, 3, length=3)
    assert nothing.members.collect() == [] and nothing.members.columns == ["id", "cluster", "distance"]


def test_bounds_spare_scans_in_apart_clusters(spark):
    random = np.random.default_rng(1)
    rows = [(i, [float(a) for a in random.normal(0, 0.02, 2) + [i % 8, i // 8 % 8]]) for i in range(2000)]
    found = centroids.cluster(table(spark, rows), 40, 5, length=2)
    assert found.scanned[-1] < 0.3 * len(rows)


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_drift_is_never_more_than_what_is_allowed_for(seed):
    random = np.random.default_rng(seed)
    d = int(random.integers(1, 6))
    centers, radii = random.normal(0, 10, (4, d)), random.uniform(0, 12, 4)
    old = random.normal(0, 10, (5, d))
    new = old + random.normal(0, 1, (5, d)) * random.uniform(0, 10)
    lost = centroids.shortening(centers, radii, old, new)
    way = np.sqrt(((new - old) ** 2).sum(1))
    assert (lost <= way[None, :]).all()
    for i in range(4):
        inside = random.normal(0, 1, (300, d))
        inside *= (random.uniform(0, 1, 300) ** 0.2 * radii[i] / np.sqrt((inside**2).sum(1)))[:, None]
        x = centers[i] + inside
        shorter = np.sqrt(((x[:, None] - old) ** 2).sum(2)) - np.sqrt(((x[:, None] - new) ** 2).sum(2))
        assert (shorter.max(0) <= lost[i] + 1e-9).all()


def test_drift_sideways_costs_less_than_its_length():
    one = np.array([[0.0, 0.0]])
    lost = centroids.shortening(one, np.array([1.0]), np.array([[10.0, 0.0]]), np.array([[10.0, 2.0]]))
    assert lost[0, 0] < 0.2 < 2
    away = centroids.shortening(one, np.array([1.0]), np.array([[10.0, 0.0]]), np.array([[13.0, 0.0]]))
    assert away[0, 0] < -2.9
