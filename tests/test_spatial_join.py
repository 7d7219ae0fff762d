import math
import random

import pytest
from pyspark.sql import functions as F
from shapes import edges, largest_method, lights, polygons, rows_of, square, streets
from test_geodesy import vincenty

from crosslume.operators import (
    classify_edges,
    decompose_edges,
    hot_keys,
    key_counts,
    lights_within,
    segment_hits,
    split_join,
)
from crosslume.operators.centers import crossings
from crosslume.operators import spatial_join
from crosslume.operators.skew import crowded_keys, piece_of
from crosslume.operators.spatial_join import segment_candidates
from crosslume.plans import fixtures
from crosslume.sources import stage

SF = "/root/testdata/sf0.001"


def test_split_join_equals_plain_join(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("l")
    )
    right = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 60).alias("k"), F.col("id").alias("r")
    )
    for how, sides in {
        "inner": [{"split_left": ["l"]}, {"split_right": ["r"]}, {"split_left": ["l"], "split_right": ["r"]}],
        "left": [{"split_left": ["l"]}],
    }.items():
        want = rows_of(left.join(right, "k", how).select("k", "l", F.coalesce("r", F.lit(-1))), "*")
        for options in sides:
            got = split_join(left, right, ["k"], how, hot_rows=100, **options)
            assert rows_of(got.select("k", "l", F.coalesce("r", F.lit(-1))), "*") == want


def test_split_join_spreads_a_hot_key(spark):
    left = spark.range(6000).select(F.lit(1).alias("k"), F.col("id").alias("l"))
    right = spark.range(5).select(F.lit(1).alias("k"), F.col("id").alias("r"))
    joined = split_join(left, right, ["k"], split_left=["l"], hot_rows=100, hint="merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in per_task) == 30000
    assert len(per_task) == 4 and max(r["count"] for r in per_task) < 15000


def test_any_number_of_hot_keys_and_pieces(spark):
    many = spark.range(60_000).select((F.col("id") % 3000).alias("k"), F.col("id").alias("l"))
    found = hot_keys(key_counts(many, ["k"]), ["k"], rows=10)
    assert found.count() == 3000 and {r["ways"] for r in found.collect()} == {2}
    assert hot_keys(key_counts(many, ["k"]), ["k"], rows=20).count() == 0
    one = spark.range(12_000).select(F.lit(7).alias("k"), F.col("id").alias("l"))
    ways = hot_keys(key_counts(one, ["k"]), ["k"], rows=10).first()["ways"]
    assert ways == 1200
    pieces = one.groupBy(piece_of(["l"], F.lit(ways)).alias("piece")).count()
    assert pieces.agg(F.sum("count")).first()[0] == 12_000
    assert pieces.agg(F.max("count")).first()[0] < 40


def random_segments(rng, n, length):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, 0.02), rng.uniform(-0.01, 0.01)
        t, r = rng.uniform(0, 2 * math.pi), rng.choice([length, length / 50])
        out.append((i, [(x, y), (x + r * math.cos(t), y + r * math.sin(t))]))
    return out


def crosses(p, q):
    (ax, ay), (bx, by) = p
    (cx, cy), (dx, dy) = q
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
    return 0 <= t <= 1 and 0 <= u <= 1


@pytest.mark.parametrize("cell, hot_rows", [(0.0003, 3), (0.001, 200_000), (0.5, 3)])
def test_segment_hits_equal_brute_force(spark, cell, hot_rows):
    rng = random.Random(5)
    ours, theirs = random_segments(rng, 120, 0.004), random_segments(rng, 90, 0.03)
    want = sorted((i, j) for i, p in ours for j, q in theirs if crosses(p, q))
    got = segment_hits(
        edges(spark, [(i, 1, p) for i, p in ours]),
        streets(spark, [(j, None, q) for j, q in theirs]),
        cell,
        hot_rows=hot_rows,
    )
    assert rows_of(got, "crosswalk_id", "street_segment_id") == want


def test_street_through_a_corner_and_along_an_edge(spark):
    box = decompose_edges(polygons(spark, [(1, [square(0.0, 0.0, 1e-4, 1e-4)])]))
    corner = streets(spark, [(5, None, [(-2e-4, -2e-4), (2e-4, 2e-4)])])
    hits = segment_hits(box, corner)
    assert hits.count() == 4
    assert rows_of(hits.select("x", "y").distinct(), "*") == [(-1e-4, -1e-4), (1e-4, 1e-4)]
    along = streets(spark, [(5, None, [(-3e-4, -1e-4), (3e-4, -1e-4)])])
    hits = segment_hits(box, along)
    on_edge = hits.where("edge_id = 1")
    assert rows_of(on_edge, "x", "y") == [(-1e-4, -1e-4), (1e-4, -1e-4)]
    assert rows_of(hits.select("x", "y").distinct(), "*") == [(-1e-4, -1e-4), (1e-4, -1e-4)]


def test_streets_without_geometry_or_with_one_vertex(spark):
    box = decompose_edges(polygons(spark, [(1, [square(0.0, 0.0, 1e-4, 1e-4)])]))
    assert segment_hits(box, streets(spark, [(1, "FT", None), (2, "FT", [(0.0, 0.0)])])).count() == 0


@pytest.mark.parametrize("radius, hot_rows", [(20.0, 200_000), (350.0, 2)])
def test_lights_within_equal_brute_force(spark, radius, hot_rows):
    rng = random.Random(11)
    spots = [(-71.06, 42.36), (179.9999, 10.0), (-179.9999, 10.0), (25.0, 80.0), (0.0, 89.9995)]
    near = 2 * radius / 111320

    def around(n):
        rows = []
        for i in range(n):
            lon, lat = rng.choice(spots)
            lon += rng.uniform(-near, near) / max(math.cos(math.radians(lat)), 1e-4)
            rows.append((i, ((lon + 180) % 360 - 180, min(lat + rng.uniform(-near, near), 90.0))))
        return rows

    ours, theirs = around(80), around(120)
    want = sorted(
        (i, j) for i, p in ours for j, q in theirs if vincenty(*p, *q) <= radius
    )
    got = lights_within(lights(spark, ours), lights(spark, theirs), radius, hot_rows=hot_rows)
    assert rows_of(got, "OBJECTID", "streetlight_id") == want
    assert len(want) > 50


def test_null_vertices_meet_nothing(spark):
    box = decompose_edges(polygons(spark, [(1, [square(0.0, 0.0, 1e-3, 1e-3)])]))
    broken = streets(spark, [(1, None, [(None, None), (0.002, 0.002)]), (2, None, [(-0.002, 0.0), None, (0.002, 0.0)])])
    assert segment_hits(box, broken).count() == 0


def test_rings_keep_apart(spark):
    outer, hole = square(0.0, 0.0, 4e-4, 4e-4), square(0.0, 0.0, 1e-4, 1e-4)
    parts = decompose_edges(polygons(spark, [(1, [outer, hole])]))
    hits = segment_hits(parts, streets(spark, [(5, "FT", [(0.0, -2e-4), (0.0, -1e-4)])]))
    met = classify_edges(parts, hits).where("is_vehicle_edge")
    assert rows_of(met, "ring_id", "edge_id") == [(2, 1)]


def test_vertices_inside_an_overlap_do_not_count(spark):
    box = decompose_edges(polygons(spark, [(1, [square(0.0, 0.0, 1e-4, 1e-4)])]))
    ends = [(-3e-4, -1e-4), (3e-4, -1e-4)]
    for inner in ([], [(5e-5, -1e-4)], [(-5e-5, -1e-4), (2e-5, -1e-4), (6e-5, -1e-4)]):
        line = [ends[0], *inner, ends[1]]
        got = crossings(segment_hits(box, streets(spark, [(5, None, line)]))).first()
        assert (got["n"], got["sum_x"], got["sum_y"]) == (2, 0, -200_000)


def test_only_streets_along_edges_are_counted_by_piece(spark):
    box = decompose_edges(polygons(spark, [(1, [square(0.0, 0.0, 1e-4, 1e-4)]), (2, [square(5e-3, 0.0, 1e-4, 1e-4)])]))
    across = (6, None, [(-3e-4, 0.0), (0.0, 0.0), (6e-3, 0.0)])
    nameless = (None, None, [(5e-3, -3e-4), (5e-3, 3e-4)])
    along = (5, None, [(-3e-4, -1e-4), (2e-5, -1e-4), (3e-4, -1e-4)])
    again = (None, None, [(-3e-4, 1e-4), (-2e-5, 1e-4), (3e-4, 1e-4)])

    def found(*lines):
        rows = crossings(stage(segment_hits(box, streets(spark, lines)), "hits")).collect()
        return {(r["crosswalk_id"], r["street_segment_id"]): (r["n"], r["sum_x"], r["sum_y"]) for r in rows}

    want = {(1, 6): (2, 0, 0), (2, 6): (2, 10_000_000, 0), (2, None): (2, 10_000_000, 0)}
    assert found(across, nameless) == want
    # A vertex inside a stretch goes, also where the street has no id.
    assert found(across, nameless, along, again) == {**want, (1, 5): (2, 0, -200_000), (1, None): (2, 0, 200_000)}
    plain = crossings(stage(segment_hits(box, streets(spark, [across, nameless])), "hits"))
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def scans(df):
    """Files that the static plan reads, by the name they were staged under."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_inputs_of_the_distance_join_are_staged_once(spark):
    spots = fixtures.streetlights(spark, SF)
    near = lights_within(spots, spots, 20)
    # Bins of either side: one scan to count keys, for either cut, and one to join.
    assert scans(near) <= 6
    assert "orders.parquet" not in near._jdf.queryExecution().executedPlan().toString()


def test_radius_is_checked(spark):
    some = lights(spark, [(1, (0.0, 0.0))])
    for radius in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            lights_within(some, some, radius)


def test_joins_never_compare_all_pairs(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = segment_hits(
            decompose_edges(fixtures.crosswalks(spark, SF)), fixtures.street_segments(spark, SF)
        )
        near = lights_within(fixtures.streetlights(spark, SF), fixtures.streetlights(spark, SF), 20)
        for df in (found, near):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
            assert "SortMergeJoin" in plan
            assert "PythonUDF" not in plan and "ArrowEval" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_generated_methods_are_small_enough_to_compile(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = stage(decompose_edges(fixtures.crosswalks(spark, SF)), "parts")
        found = segment_hits(parts, fixtures.street_segments(spark, SF))
        spots = stage(fixtures.streetlights(spark, SF), "lights")
        near = lights_within(spots, fixtures.streetlights(spark, SF), 20)
        assert largest_method(spark, found) < 8000
        assert largest_method(spark, near) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lights_within_a_thousand_kilometres(spark):
    rng = random.Random(5)

    def points(n):
        return [(i, (rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1))))) for i in range(n)]

    ours, theirs = points(60), points(300)
    want = {(i, j) for i, p in ours for j, q in theirs if vincenty(*p, *q) <= 1e6}
    got = lights_within(lights(spark, ours), lights(spark, theirs), 1e6)
    assert {(r["OBJECTID"], r["streetlight_id"]) for r in got.collect()} == want and len(want) > 50


def test_crowded_cells_are_cut_finer(spark):
    rng = random.Random(2)

    def short(n):
        """Segments of a twentieth of a cell, all in one cell."""
        some = []
        for i in range(n):
            x, y, turn = rng.uniform(5e-5, 9.5e-4), rng.uniform(5e-5, 9.5e-4), rng.uniform(0, 6.28)
            some.append((i, [(x, y), (x + 4e-5 * math.cos(turn), y + 4e-5 * math.sin(turn))]))
        return some

    ratio = []
    for n in (400, 1600):
        ours, theirs = short(n), short(n)
        sides = edges(spark, [(i, 1, line) for i, line in ours]), streets(spark, [(j, None, line) for j, line in theirs])
        candidates = segment_candidates(*sides, cell_pairs=64).count()
        ratio.append(candidates / (n * n))
        found = {(r["crosswalk_id"], r["street_segment_id"]) for r in segment_hits(*sides, cell_pairs=64).collect()}
        plain = segment_hits(*sides, cell_pairs=1 << 60)
        assert rows_of(plain, "crosswalk_id", "street_segment_id", "x", "y") == rows_of(
            segment_hits(*sides, cell_pairs=64), "crosswalk_id", "street_segment_id", "x", "y"
        )
        assert found == {(r["crosswalk_id"], r["street_segment_id"]) for r in plain.collect()} and len(found) > 50
    assert ratio[1] < 0.05 and ratio[1] <= 1.2 * ratio[0]


def test_counts_of_cells_stay_off_the_driver(spark):
    """However small the files look: one row may make a hundred cells."""
    found = segment_hits(decompose_edges(fixtures.crosswalks(spark, SF)), fixtures.street_segments(spark, SF))
    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    counted = [line for line in plan if "Join" in line and line.count("gx#") >= 2 and "sx#" not in line]
    assert any("SortMergeJoin" in line and "Inner" in line for line in counted)
    assert not any("BroadcastHashJoin" in line and "Inner" in line for line in counted)


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    """A file of one row group is read by one task, but geometry is made by all."""
    spark.range(1000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = fixtures.crosswalks(spark, str(tmp_path))
    rows = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in rows) == 1000 == made.select("OBJECTID").distinct().count()


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_keys_are_counted_one_by_one_only_where_some_may_be_hot(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), "id")
    assert crowded_keys(rows, ["k"], 10_100) is None
    assert [(r["k"], r["ways"]) for r in crowded_keys(rows, ["k"], 10_000).collect()] == [(1, 2)]
    # More full shares than are listed.
    many = crowded_keys(rows.select((F.col("id") % 3000).alias("k")), ["k"], 9).collect()
    assert len(many) == 3000 and {r["ways"] for r in many} == {2}


def test_sides_without_crowded_keys_are_shuffled_once(spark):
    parts = stage(decompose_edges(fixtures.crosswalks(spark, SF)), "parts")
    roads = stage(fixtures.street_segments(spark, SF), "roads")
    spots = stage(fixtures.streetlights(spark, SF), "spots")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert shuffles(segment_candidates(parts, roads)) == 2
        assert shuffles(lights_within(spots, spots, 20)) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cells_of_both_sides_are_merged_to_find_crowded_ones(spark, monkeypatch):
    """Their counts are staged before the join of the segments, and never broadcast."""
    seen = {}

    def kept(df, name):
        seen[name] = df._jdf.queryExecution().sparkPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(spatial_join, "stage", kept)
    segment_candidates(decompose_edges(fixtures.crosswalks(spark, SF)), fixtures.street_segments(spark, SF))
    assert "SortMergeJoin" in seen["cells"] and "BroadcastHashJoin" not in seen["cells"]


@pytest.mark.parametrize("radius", [0.5, 20.0, 3000.0])
def test_a_center_goes_to_eight_bins_at_most(spark, radius):
    """Points on a line that crosses many bins, at distances just below and above the radius."""
    step = radius / 111_000 / 2
    ours = [(i, (25.0 + i * step, 60.0 + i * step)) for i in range(60)]
    want = sorted((i, j) for i, p in ours for j, q in ours if vincenty(*p, *q) <= radius)
    got = lights_within(lights(spark, ours), lights(spark, ours), radius)
    assert rows_of(got, "OBJECTID", "streetlight_id") == want
    step_rows = got._jdf.queryExecution().optimizedPlan().toString()
    assert step_rows.count("[1,1,1]") == 1 and "[-1," not in step_rows
