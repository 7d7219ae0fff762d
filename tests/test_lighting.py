import math

import pytest
from pyspark.sql import functions as F
from shapes import edges, largest_method, lights, polygons, rows_of, square, streets

from crosslume.operators import lighting
from crosslume.operators import (
    brightness,
    classify_edges,
    classify_sides,
    contrast_heuristics,
    decompose_edges,
    explode_lights,
    find_crosswalk_centers,
    center_light_pairs,
    light_lists,
    lights_within,
    lookup_distance,
    oneway_centers,
    segment_hits,
    twoway_centers,
    vehicle_direction,
    with_axes,
)
from crosslume.operators.lighting import contrast_label
from crosslume.sources import stage

U = 1e-5


_chains = {}


def chain(spark, boxes, roads):
    """Classified edges and hits of some crosswalks on some streets, computed once each."""
    key = repr((boxes, roads))
    if key not in _chains:
        _chains[key] = _chain(spark, boxes, roads)
    return _chains[key]


def _chain(spark, boxes, roads):
    parts = stage(decompose_edges(polygons(spark, boxes)), "parts")
    hits = stage(segment_hits(parts, streets(spark, roads)), "hits")
    return stage(classify_edges(parts, hits), "segments"), hits


def directed(centers):
    """Centers with their direction, staged as later steps read them several times."""
    return stage(vehicle_direction(centers).drop("street_start"), "centers")


def paired(centers, points, **options):
    return stage(lights_within(stage(with_axes(centers), "axes"), points, 20, **options), "pairs")


def crosswalk(i=1, x=0.0, y=0.0):
    """Box 12 wide and 4 high: streets running north cross edges 1 and 3."""
    return (i, [square(x, y, 6 * U, 2 * U)])


def north(oid, code=None, x=0.0):
    return (oid, code, [(x, -20 * U), (x, 20 * U)])


def test_edges_take_the_highest_of_their_lowest_streets(spark):
    # Street 3 hits edges 1 and 3, street 9 hits edge 2 (east) only.
    roads = [north(3, "FT"), north(7, "B", U), (9, None, [(5 * U, 0.0), (9 * U, 0.0)])]
    segments, _ = chain(spark, [crosswalk(), crosswalk(2, x=1.0)], roads)
    assert rows_of(segments.where("crosswalk_id = 1"), "edge_id", "is_vehicle_edge", "street_segment_id", "is_oneway") == [
        (1, True, 9, False),
        (2, True, 9, False),
        (3, True, 9, False),
        (4, False, 9, False),
    ]
    lonely = segments.where("crosswalk_id = 2").collect()
    assert all(not r["is_vehicle_edge"] and r["street_segment_id"] is None and not r["is_oneway"] for r in lonely)


@pytest.mark.parametrize("code, oneway", [("FT", True), ("TF", False), ("ft", False), ("B", False), (None, False)])
def test_oneway_codes(spark, code, oneway):
    segments, _ = chain(spark, [crosswalk()], [north(3, code)])
    assert {r["is_oneway"] for r in segments.collect()} == {oneway}


def test_oneway_center_on_every_street(spark):
    segments, hits = chain(spark, [crosswalk()], [north(3, "FT"), north(4, "B", 2 * U)])
    centers = vehicle_direction(oneway_centers(segments, hits)).orderBy("street_segment_id").collect()
    assert [(r["street_segment_id"], r["center_id"]) for r in centers] == [(3, "A"), (4, "A")]
    assert tuple(centers[0]["geometry"]) == (0, 0) and tuple(centers[1]["geometry"]) == (2 * U, 0)
    # Edge 2 is the first no street hits; its south end is nearer to the start of the street.
    assert [tuple(p) for p in centers[0]["ped_edge_geom"]] == [(6 * U, -2 * U), (6 * U, 2 * U)]
    assert tuple(centers[0]["from_coord"]) == (6 * U, -2 * U)
    assert tuple(centers[0]["to_coord"]) == (6 * U, 2 * U)


def test_oneway_crosswalk_with_all_edges_hit(spark):
    roads = [north(3, "FT"), (2, "FT", [(-20 * U, 0.0), (20 * U, 0.0)])]
    segments, hits = chain(spark, [crosswalk()], roads)
    centers = directed(find_crosswalk_centers(segments, hits))
    got = centers.collect()
    assert len(got) == 2
    assert all(r["ped_edge_geom"] is None and r["from_coord"] is None and r["to_coord"] is None for r in got)
    near = paired(centers, lights(spark, [(1, (3 * U, 3 * U))]))
    sides = classify_sides(near).collect()
    assert len(sides) == 2 and all(r["side"] == "from" and r["angle_rad"] is None for r in sides)


def test_oneway_tie_starts_at_the_second_end(spark):
    start = spark.range(1).select(
        F.lit(True).alias("is_oneway"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).alias("street_start"),
        F.array(
            F.struct(F.lit(1.0).alias("x"), F.lit(-1.0).alias("y")),
            F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")),
        ).alias("ped_edge_geom"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).alias("geometry"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).alias("street_center_point"),
    )
    row = vehicle_direction(start).first()
    assert tuple(row["from_coord"]) == (1, 1) and tuple(row["to_coord"]) == (1, -1)


def test_two_records_of_one_street_do_not_repeat_lights(spark):
    segments, hits = chain(spark, [crosswalk()], [north(3, "FT"), north(4, "FT")])
    centers = directed(oneway_centers(segments, hits))
    pairs = paired(centers, lights(spark, [(8, (3 * U, 3 * U))]))
    listed = light_lists(centers, pairs).collect()
    assert [r["streetlight_id"] for r in listed] == [[8], [8]]


def test_twoway_centers_and_directions(spark):
    segments, hits = chain(spark, [crosswalk()], [north(3)])
    got = vehicle_direction(twoway_centers(segments, hits)).orderBy("center_id").collect()
    assert [(r["center_id"], tuple(r["geometry"])) for r in got] == [
        ("A", (-3e-5, 0)),
        ("B", (3e-5, 0)),
    ]
    # West of the street traffic runs south, east of it north.
    assert tuple(got[0]["from_coord"]) == (-6 * U, 2 * U) and tuple(got[0]["to_coord"]) == (-6 * U, -2 * U)
    assert tuple(got[1]["from_coord"]) == (6 * U, -2 * U) and tuple(got[1]["to_coord"]) == (6 * U, 2 * U)


def test_twoway_east_west_street(spark):
    box = (1, [square(0.0, 0.0, 2 * U, 6 * U)])
    segments, hits = chain(spark, [box], [(3, None, [(-20 * U, 0.0), (20 * U, 0.0)])])
    got = {tuple(r["geometry"]): r for r in vehicle_direction(twoway_centers(segments, hits)).collect()}
    above, below = got[(0, 3e-5)], got[(0, -3e-5)]
    # North of the street traffic runs west, south of it east.
    assert above["from_coord"]["x"] == 2 * U and above["to_coord"]["x"] == -2 * U
    assert below["from_coord"]["x"] == -2 * U and below["to_coord"]["x"] == 2 * U


def center_row(spark, edge, center, street):
    def p(xy):
        return F.struct(F.lit(float(xy[0])).alias("x"), F.lit(float(xy[1])).alias("y"))

    return spark.range(1).select(
        F.lit(1).cast("long").alias("crosswalk_id"),
        F.lit("A").alias("center_id"),
        F.lit(2).cast("long").alias("street_segment_id"),
        F.lit(False).alias("is_oneway"),
        F.array(p(edge[0]), p(edge[1])).alias("ped_edge_geom"),
        p(center).alias("geometry"),
        p(street).alias("street_center_point"),
        F.lit(None).cast("struct<x:double,y:double>").alias("street_start"),
    )


def test_level_edge_gives_the_second_end_twice(spark):
    row = vehicle_direction(center_row(spark, [(0, 1), (2, 1)], (5, 0), (0, 0))).first()
    assert tuple(row["from_coord"]) == tuple(row["to_coord"]) == (2, 1)
    row = vehicle_direction(center_row(spark, [(1, 0), (1, 2)], (0, 5), (0, 0))).first()
    assert tuple(row["from_coord"]) == tuple(row["to_coord"]) == (1, 2)


def test_center_on_the_street_point_has_no_direction(spark):
    row = vehicle_direction(center_row(spark, [(0, 1), (2, 2)], (0, 0), (0, 0))).first()
    assert row["from_coord"] is None and row["to_coord"] is None


def test_twoway_crosswalk_with_one_free_edge(spark):
    roads = [north(3), (9, None, [(5 * U, 0.0), (9 * U, 0.0)])]
    segments, hits = chain(spark, [crosswalk()], roads)
    centers = directed(find_crosswalk_centers(segments, hits))
    assert [r["center_id"] for r in centers.collect()] == ["A"]
    classified = classify_sides(paired(centers, lights(spark, [(1, (3 * U, 3 * U))])))
    row = classified.first()
    assert row["side"] == "from" and row["angle_rad"] is None and row["a_to_b"] is None
    score = contrast_heuristics(classified, centers, 0.01).first()
    assert score["from_contrast_heuristic"] == 0 and score["from_brightness_heuristic"] > 0
    assert score["to_brightness_heuristic"] == 0


SPOTS = [
    (1, (0.0, 9 * U)),
    (2, (0.0, -9 * U)),
    (3, (9 * U, 0.0)),
    (4, (4 * U, 9 * U)),
    (5, (U, -7 * U)),
    (6, (2 * U, 8 * U)),
]


def scored(spark, points=SPOTS):
    """Centers, pairs, classified lights and scores of one two-way crosswalk."""
    key = repr(points)
    if key not in _chains:
        if "centers" not in _chains:
            segments, hits = chain(spark, [crosswalk()], [north(3)])
            _chains["centers"] = directed(find_crosswalk_centers(segments, hits))
        centers = _chains["centers"]
        pairs = paired(centers, lights(spark, points))
        classified = classify_sides(pairs)
        scores = brightness(contrast_heuristics(classified, centers, 0.01))
        _chains[key] = centers, pairs, classified, scores
    return _chains[key]


def test_sides_swap_between_the_lanes(spark):
    _, _, classified, _ = scored(spark)
    side = {(r["center_id"], r["streetlight_id"]): r["side"] for r in classified.collect()}
    # A looks south, B north; the light on the axis is on neither side, which counts as 'from'.
    assert side[("A", 1)] == "from" and side[("A", 2)] == "to"
    assert side[("B", 1)] == "to" and side[("B", 2)] == "from"
    assert side[("A", 3)] == side[("B", 3)] == "from"


def test_side_and_angle_formula(spark):
    _, pairs, classified, _ = scored(spark)
    row = classified.where("center_id = 'A' AND streetlight_id = 4").first()
    pair = pairs.where("center_id = 'A' AND streetlight_id = 4").first()
    (ax, ay), (bx, by) = (tuple(p) for p in row["a_to_b"])
    cx, cy = row["geometry"]["x"] - pair["geometry"]["x"], row["geometry"]["y"] - pair["geometry"]["y"]
    angle = math.atan2(cx * (by - ay) - cy * (bx - ax), cx * (bx - ax) + cy * (by - ay))
    assert row["angle_rad"] == pytest.approx(angle)
    assert row["abs_sin_angle"] == pytest.approx(abs(math.sin(angle)))
    assert [tuple(p) for p in row["line_geom"]] == [tuple(pair["geometry"]), tuple(row["geometry"])]


def test_light_at_a_center(spark):
    _, _, _, scores = scored(spark, [(1, (3e-5, 0.0))])
    row = scores.where("center_id = 'B'").first()
    assert math.isinf(row["from_brightness_heuristic"]) and math.isinf(row["light_heuristic"])
    assert math.isnan(row["from_contrast_heuristic"])
    assert row["contrast_heuristic"] == "strong positive contrast"


def test_center_without_lights(spark):
    centers, pairs, _, scores = scored(spark, [(1, (1.0, 1.0))])
    assert [r["contrast_heuristic"] for r in scores.collect()] == ["no contrast"] * 2
    assert {r["light_heuristic"] for r in scores.collect()} == {0.0}
    listed = light_lists(centers, pairs).collect()
    assert all(r["streetlight_id"] is None and r["streetlight_dist"] is None for r in listed)
    assert explode_lights(light_lists(centers, pairs)).count() == 0


def test_sums_are_those_of_32_bit_distances(spark):
    _, _, classified, scores = scored(spark)
    rows = [r for r in classified.collect() if r["center_id"] == "B"]
    import numpy as np

    want = {"to": [0.0, 0.0], "from": [0.0, 0.0]}
    for r in rows:
        d = np.float32(r["dist"]) * np.float32(r["dist"])
        want[r["side"]][0] += r["abs_sin_angle"] / float(d)
        want[r["side"]][1] += float(np.float32(1.0) / d)
    got = scores.where("center_id = 'B'").first()
    for side in want:
        assert got[f"{side}_contrast_heuristic"] == pytest.approx(want[side][0], rel=1e-12)
        assert got[f"{side}_brightness_heuristic"] == pytest.approx(want[side][1], rel=1e-12)


@pytest.mark.parametrize(
    "to_side, from_side, label",
    [
        (0.0, 0.005, "no contrast"),
        (0.0, 0.006, "weak positive contrast"),
        (0.006, 0.0, "weak negative contrast"),
        (0.0, 0.0076, "strong positive contrast"),
        (0.0076, 0.0, "strong negative contrast"),
        (0.01, 0.0174, "no contrast"),
        (0.01, 0.0199, "weak positive contrast"),
        (0.0199, 0.01, "weak negative contrast"),
        (0.01, 0.021, "strong positive contrast"),
        (0.021, 0.01, "strong negative contrast"),
    ],
)
def test_labels(spark, to_side, from_side, label):
    got = spark.range(1).select(contrast_label(F.lit(to_side), F.lit(from_side), 0.01)).first()[0]
    assert got == label


def test_lists_are_cut_but_whole(spark):
    points = [(i, ((i % 50) * 1e-7, (i // 50) * 1e-7)) for i in range(1000)]
    centers, pairs, _, _ = scored(spark, points)
    whole = light_lists(centers, pairs)
    assert {r["list_part"] for r in whole.collect()} == {0}
    cut = light_lists(centers, pairs, list_rows=100)
    rows = cut.collect()
    assert len(rows) > 10 and max(len(r["streetlight_id"]) for r in rows) <= 100
    assert all(r["streetlight_id"] == sorted(r["streetlight_id"]) for r in rows)
    key = ["crosswalk_id", "center_id", "streetlight_id", "dist"]
    assert rows_of(explode_lights(cut), *key) == rows_of(pairs, *key) == rows_of(explode_lights(whole), *key)


def test_pairs_keep_centers_without_lights(spark):
    centers, pairs, _, _ = scored(spark, [(1, (3e-5, 0.0)), (2, (1.0, 1.0))])
    long = center_light_pairs(centers, pairs)
    assert long.columns == [*centers.columns, "streetlight_id", "streetlight_dist"]
    want = rows_of(explode_lights(light_lists(centers, pairs)), "center_id", "streetlight_id")
    assert rows_of(long.where("streetlight_id IS NOT NULL"), "center_id", "streetlight_id") == want
    centers, pairs, _, _ = scored(spark, [(1, (1.0, 1.0))])
    assert center_light_pairs(centers, pairs).where("streetlight_id IS NULL").count() == centers.count() > 0


def test_explode_with_points_and_lookup(spark):
    centers, pairs, _, _ = scored(spark)
    listed = light_lists(with_axes(centers), pairs)
    key = ["crosswalk_id", "center_id", "streetlight_id", "dist"]
    again = explode_lights(listed, lights(spark, SPOTS))
    assert rows_of(classify_sides(again), *key, "side") == rows_of(classify_sides(pairs), *key, "side")
    looked = listed.select(
        lookup_distance(F.col("streetlight_id"), F.col("streetlight_dist"), F.lit(2).cast("long")).alias("two"),
        F.col("streetlight_dist")[1].alias("want"),
        lookup_distance(F.col("streetlight_id"), F.col("streetlight_dist"), F.lit(99).cast("long")).alias("none"),
    ).collect()
    assert all(r["two"] == r["want"] and r["none"] is None for r in looked)


def test_hot_crosswalk_gives_the_same_scores(spark):
    roads = [north(i, "FT", (i % 11 - 5) * U / 2) for i in range(40)]
    segments, hits = chain(spark, [crosswalk(), crosswalk(2, x=30 * U)], roads)
    spots = lights(spark, [(i, (i * U, 3 * U)) for i in range(12)])

    def run(rows):
        centers = directed(find_crosswalk_centers(segments, hits, hot_rows=rows))
        axes = stage(with_axes(centers, hot_rows=rows), "axes")
        pairs = stage(lights_within(axes, spots, 20, hot_rows=rows), "pairs")
        scores = contrast_heuristics(classify_sides(pairs), centers, 0.01, keep_geometry=True, hot_rows=rows)
        return rows_of(
            scores.select("crosswalk_id", "center_id", "geometry.x", F.round("to_contrast_heuristic", 9),
                          F.round("from_contrast_heuristic", 9)), "*")

    assert run(3) == run(200_000)


def test_edges_need_no_streets(spark):
    parts = edges(spark, [(1, 1, [(0.0, 0.0), (1.0, 0.0)])])
    hits = segment_hits(parts, streets(spark, [(1, None, [(5.0, 5.0), (6.0, 6.0)])]))
    assert find_crosswalk_centers(classify_edges(parts, hits), hits).count() == 0


def test_generated_methods_are_small_enough_to_compile(spark):
    centers, pairs, classified, scores = scored(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = lights_within(stage(with_axes(centers), "axes"), lights(spark, SPOTS), 20)
        frames = [near, classify_sides(pairs), scores, light_lists(centers, pairs)]
        assert max(largest_method(spark, df) for df in frames) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_pairs_of_centers_take_one_join_where_none_is_crowded(spark, monkeypatch):
    rows = [(1, "A", 7), (1, "B", 7), (2, "A", None), (3, None, 7)]
    centers = spark.createDataFrame(rows, "crosswalk_id long, center_id string, street_segment_id long")
    near = [(1, "A", 7, n, float(n)) for n in range(40)] + [(2, "A", None, 1, 1.0), (3, None, 7, 1, 1.0)]
    pairs = spark.createDataFrame(near, "crosswalk_id long, center_id string, street_segment_id long, streetlight_id long, dist float")
    plain = lighting.center_light_pairs(centers, pairs)
    assert "Union" not in plain._jdf.queryExecution().optimizedPlan().toString()
    lists = lighting.light_lists(centers, pairs)
    assert "Window" not in lists._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(map(str, plain.collect()))
    assert len(found) == 43
    monkeypatch.setattr(lighting, "crowded_keys", lambda *given: True)
    assert sorted(map(str, lighting.center_light_pairs(centers, pairs).collect())) == found
    assert sorted(map(str, lighting.light_lists(centers, pairs).collect())) == sorted(map(str, lists.collect()))


def shuffles(df):
    """Exchanges of the initial plan, each once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_hits_of_a_crosswalk_are_gathered_once(spark):
    box = square(0.0, 0.0, 5e-5, 5e-5)
    parts = stage(decompose_edges(polygons(spark, [(i, [box]) for i in range(3)])), "edges")
    roads = streets(spark, [(7, "FT", [(0.0, -1e-4), (0.0, 1e-4)]), (9, None, [(2e-5, -1e-4), (2e-5, 1e-4)])])
    hits = stage(segment_hits(parts, roads), "hits")
    segments = classify_edges(parts, hits.repartition("crosswalk_id"))
    # Edges and hits for the class of the crosswalk, and hits for the points: nothing is shuffled a second time.
    assert shuffles(twoway_centers(segments, hits)) <= 3
    assert shuffles(oneway_centers(segments, hits)) <= 3
    # A crosswalk with too many hits is not gathered, and gives the same.
    key = ["crosswalk_id", "center_id", "street_segment_id", "geometry", "ped_edge_geom"]
    want = rows_of(oneway_centers(segments, hits), *key)
    assert len(want) == 6 and rows_of(oneway_centers(segments, hits, hot_rows=2), *key) == want


def test_axes_stay_off_the_driver(spark):
    centers, _, _, _ = scored(spark)
    assert "BroadcastHashJoin" not in with_axes(centers)._jdf.queryExecution().executedPlan().toString()


def test_lights_of_lists_are_counted_in_the_pairs(spark):
    centers, pairs, _, _ = scored(spark)
    pairs = stage(pairs, "pairs")
    lists, key = light_lists(centers, pairs), ["crosswalk_id", "center_id", "streetlight_id", "dist", "light"]
    again = explode_lights(lists, lights(spark, SPOTS), pairs)
    assert rows_of(again, *key) == rows_of(explode_lights(lists, lights(spark, SPOTS)), *key)
    # Two joins: the lists to the centers, and the points to the lists. None is for a list of hot keys.
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 2
