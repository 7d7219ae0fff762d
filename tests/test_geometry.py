import itertools
import math
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from shapes import polygons

from crosslume.functions import geometry as G
from crosslume.operators import check_unique, decompose_edges, simplify_to_rectangle


def test_wkt_round_trip(spark):
    texts = {
        "point": ["POINT (1.5 -2)", "point(1.5 -2)", "POINT Z (1.5 -2 7)"],
        "line": ["LINESTRING (0 0, 1 1, 2 0.25)", "LINESTRING(0 0,1 1,2 0.25)"],
        "polygon": ["POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))"],
    }
    for kind, values in texts.items():
        df = spark.createDataFrame([(v,) for v in values], "t string")
        out = {r[0] for r in df.select(G.to_wkt(G.from_wkt(F.col("t"), kind), kind)).collect()}
        assert len(out) == 1
        again = spark.createDataFrame([(t,) for t in out], "t string")
        assert {r[0] for r in again.select(G.to_wkt(G.from_wkt(F.col("t"), kind), kind)).collect()} == out


def test_wkt_of_parts(spark):
    texts = {
        "multipoint": ["MULTIPOINT (1 2, 3 4)", "multipoint ((1 2), (3 4))", "MULTIPOINT Z (1 2 0, EMPTY, 3 4 0)"],
        "multiline": ["MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))", "MULTILINESTRING((0 0,1 1),(2 2,3 3,4 4))"],
        "multipolygon": [
            "MULTIPOLYGON (((0 0,1 0,1 1,0 0)), ((5 5,9 5,9 9,5 5), (6 6,8 7,8 6,6 6)))",
            "MULTIPOLYGON (EMPTY, ((0 0,1 0,1 1,0 0)),((5 5,9 5,9 9,5 5),(6 6,8 7,8 6,6 6)))",
        ],
        "geometry": ["GEOMETRYCOLLECTION (POINT (1 2), POLYGON ((0 0,1 0,1 1,0 0)))", "GeometryCollection(POINT(1 2),POLYGON((0 0,1 0,1 1,0 0)), LINESTRING EMPTY)"],
    }
    for kind, values in texts.items():
        df = spark.createDataFrame([(v,) for v in values], "t string")
        out = {r[0] for r in df.select(G.to_wkt(G.from_wkt(F.col("t"), kind), kind)).collect()}
        assert len(out) == 1 and out.pop().startswith(values[0].split(" ")[0])
        # A column of any geometry writes the same.
        any_ = {r[0] for r in df.select(G.to_wkt(G.from_wkt(F.col("t"), "geometry"), "geometry")).collect()}
        assert any_ == {r[0] for r in df.select(G.to_wkt(G.from_wkt(F.col("t"), kind), kind)).collect()}


def test_wkt_multipolygon_empty_and_bad_text(spark):
    text = "MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))"
    df = spark.createDataFrame([(text,), ("POLYGON EMPTY",), (None,)], "t string")
    parsed = df.select(G.from_wkt(F.col("t"), "multipolygon").alias("g"))
    assert [r["n"] for r in parsed.select(F.size("g.polygons").alias("n")).collect()][0] == 2
    assert parsed.where("g IS NULL").count() == 2
    for text, kind in [("LINESTRING (0 0, 1 1)", "point"), (text, "polygon"), ("CIRCLE (0 0)", "geometry")]:
        bad = spark.createDataFrame([(text,)], "t string")
        with pytest.raises(PySparkException):
            bad.select(G.from_wkt(F.col("t"), kind)).collect()


def test_rectangle_and_edges_of_parts(spark):
    text = "MULTIPOLYGON (((0 0,1 0,1 1,0 1,0 0)),((3 0,4 0,4 1,3 1,3 0),(3.2 0.2,3.8 0.2,3.8 0.8,3.2 0.2)))"
    df = spark.createDataFrame([(1, text)], "OBJECTID long, t string").select(
        "OBJECTID", G.from_wkt(F.col("t"), "multipolygon").alias("geometry")
    )
    (ring,) = simplify_to_rectangle(df).first()["geometry"]
    assert [tuple(p) for p in ring] == [(0, 0), (4, 0), (4, 1), (0, 1), (0, 0)]
    ids = sorted((r["ring_id"], r["edge_id"]) for r in decompose_edges(df).collect())
    assert ids == [(1, i) for i in range(1, 5)] + [(2, i) for i in range(1, 5)] + [(3, i) for i in range(1, 4)]


def test_snap_is_half_up_without_negative_zero(spark):
    df = spark.createDataFrame([(-1e-12,), (1.25,), (-1.25,)], "v double")
    out = [r[0] for r in df.select(G.snap(F.col("v"), 1)).collect()]
    assert out == [0.0, 1.3, -1.2] and math.copysign(1, out[0]) == 1


def rectangle(spark, rings, decimals=9):
    df = simplify_to_rectangle(polygons(spark, [(1, rings)]), decimals)
    return [[tuple(p) for p in ring] for ring in df.first()["geometry"]]


def area(ring):
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in itertools.pairwise(ring)) / 2


def test_rectangle_of_known_shapes(spark):
    notch = [(0, 0), (4, 0), (4, 2), (2, 1), (0, 2), (0, 0)]
    assert rectangle(spark, [notch]) == [[(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]]
    # A vertex in the middle of a side changes nothing, nor does where the ring starts.
    extra = [(4, 2), (2, 2), (0, 2), (0, 0), (2, 0), (4, 0), (4, 2)]
    assert rectangle(spark, [extra]) == [[(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]]
    tilted = [(0, 0), (8, 6), (5, 10), (-3, 4), (0, 0)]
    (ring,) = rectangle(spark, [tilted])
    assert ring[0] == (0, 0) and area(ring) == pytest.approx(50)
    (ring,) = rectangle(spark, [[(0, 0), (3, 0), (0, 4), (0, 0)]])
    assert area(ring) == pytest.approx(12)


def test_rectangle_without_area_has_no_edges(spark):
    line = [(0.0, 0.0), (1.0, 1.0), (3.0, 3.0), (2.0, 2.0), (0.0, 0.0)]
    assert rectangle(spark, [line]) == [[(0, 0), (3, 3)]]
    flat = simplify_to_rectangle(polygons(spark, [(1, [line])]))
    assert decompose_edges(flat).count() == 0
    text = flat.select(G.to_wkt(F.col("geometry"), "polygon")).first()[0]
    assert text.startswith("LINESTRING (0.000000000 0.0")


coordinate = st.integers(-50, 50).map(float)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(coordinate, coordinate), min_size=3, max_size=12), min_size=1, max_size=20))
def test_rectangle_encloses_and_is_least(spark, shapes):
    rings = [(i, [[*points, points[0]]]) for i, points in enumerate(shapes)]
    boxes = simplify_to_rectangle(polygons(spark, rings), 9).collect()
    for row in boxes:
        points = list(dict.fromkeys(shapes[row["OBJECTID"]]))
        ring = [tuple(p) for p in row["geometry"][0]]
        if len(ring) == 2:
            assert best_area(points) == pytest.approx(0, abs=1e-6)
            continue
        for (ax, ay), (bx, by) in itertools.pairwise(ring):
            length = math.hypot(bx - ax, by - ay)
            for x, y in points:
                assert ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length > -1e-6
        assert area(ring) == pytest.approx(best_area(points), rel=1e-6)
        assert ring[0] == ring[4] == min(ring, key=lambda p: (p[1], p[0]))


def best_area(points):
    """Least box over the directions of all vertex pairs."""
    best = math.inf
    for (ax, ay), (bx, by) in itertools.combinations(points, 2):
        r = math.hypot(bx - ax, by - ay)
        ux, uy = (bx - ax) / r, (by - ay) / r
        a = [x * ux + y * uy for x, y in points]
        b = [y * ux - x * uy for x, y in points]
        best = min(best, (max(a) - min(a)) * (max(b) - min(b)))
    return 0 if math.isinf(best) else best


def test_rectangle_of_large_rings(spark):
    def tilted(x, y):
        return (0.8 * x - 0.6 * y, 0.6 * x + 0.8 * y)

    def ellipse(n, a, b):
        angles = [2 * math.pi * i / n for i in range(n)]
        ring = [tilted(a * math.cos(t), b * math.sin(t)) for t in angles]
        return [*ring, ring[0]]

    # All vertices of an ellipse are on the hull; along its axes the box is least.
    shapes = [(10_000, 5.0, 2.0), (1_000, 40.0, 39.0), (200, 3.0, 1.0)]
    start = time.time()
    rows = simplify_to_rectangle(polygons(spark, [(i, [ellipse(*s)]) for i, s in enumerate(shapes)]), 9).collect()
    assert time.time() - start < 90
    for row in rows:
        n, a, b = shapes[row["OBJECTID"]]
        ring = [tuple(p) for p in row["geometry"][0]]
        assert area(ring) == pytest.approx(4 * a * b, rel=1e-4)
    # Searched and scanned boxes are the same.
    random_ = random.Random(3)
    rings = []
    for i in range(12):
        points = [(random_.gauss(0, 30), random_.gauss(0, 10)) for _ in range(100)]
        points += [(x / math.hypot(x, y) * 80, y / math.hypot(x, y) * (50 + i)) for x, y in points]
        rings.append((i, [[*points, points[0]]]))
    some = polygons(spark, rings)
    searched = {r["OBJECTID"]: r["geometry"] for r in simplify_to_rectangle(some, 9).collect()}
    for i, (ring,) in rings:
        assert area([tuple(p) for p in searched[i][0]]) == pytest.approx(best_area(hull_of(ring)), rel=1e-9)


def hull_of(points):
    """Vertices of the convex hull."""
    points = sorted(set(points))

    def half(some):
        chain = []
        for p in some:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (
                chain[-1][1] - chain[-2][1]
            ) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(points) + half(points[::-1])


def test_edges_of_rings_and_holes(spark):
    outer = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 1)]
    rows = decompose_edges(
        polygons(spark, [(7, [outer, hole])])
    ).collect()
    ids = sorted((r["crosswalk_id"], r["ring_id"], r["edge_id"]) for r in rows)
    assert ids == [(7, 1, i) for i in range(1, 5)] + [(7, 2, i) for i in range(1, 4)]
    second = next(r for r in rows if r["ring_id"] == 1 and r["edge_id"] == 2)
    assert [tuple(p) for p in second["geometry"]] == [(9, 0), (9, 9)]


def test_duplicate_ids_are_an_error(spark):
    check_unique(spark.range(3).withColumnRenamed("id", "OBJECTID"))
    twice = spark.createDataFrame([(1,), (2,), (1,)], "OBJECTID long")
    with pytest.raises(ValueError, match="OBJECTID 1 occurs 2 times"):
        check_unique(twice, name="lights")


@pytest.mark.parametrize(
    "segments, want",
    [
        (((0, 0), (2, 0), (1, -1), (1, 1)), [(1, 0)]),
        (((0, 0), (2, 0), (1, 0), (1, 1)), [(1, 0)]),
        (((0, 0), (2, 0), (2, 0), (3, 5)), [(2, 0)]),
        (((0, 0), (2, 0), (1, 0), (5, 0)), [(1, 0), (2, 0)]),
        (((0, 0), (2, 0), (2, 0), (5, 0)), [(2, 0)]),
        (((0, 0), (2, 0), (3, 0), (5, 0)), None),
        (((0, 0), (2, 0), (0, 1), (2, 1)), None),
        (((0, 0), (2, 0), (1, 0), (1, 0)), [(1, 0)]),
        (((1, 0), (1, 0), (0, 0), (2, 0)), [(1, 0)]),
        (((1, 1), (1, 1), (0, 0), (2, 0)), None),
        (((0, 0), (0, 4), (0, 3), (0, 1)), [(0, 1), (0, 3)]),
    ],
)
def test_segment_crossing(spark, segments, want):
    points = [G.point(F.lit(float(x)), F.lit(float(y))) for x, y in segments]
    got = spark.range(1).select(G.segment_crossing(*points)).first()[0]
    assert (None if got is None else [tuple(p) for p in got]) == want


def test_text_is_parsed_once(spark):
    """However often the parser refers to it, or Spark to what is parsed."""
    df = spark.createDataFrame([("POINT (1 2)",)], "text string")
    for kind in G.KINDS:
        expression = df.select(G.from_wkt(F.col("text"), kind).alias("g"))._jdf.queryExecution().analyzed().toString()
        assert expression.split("\n")[0].count("text#") == 1


def test_text_of_coordinates_does_not_depend_on_how_it_is_made(spark):
    """Casts to decimal, outside of lambdas, write what the format does, which still serves odd numbers."""
    odd = [0.0, -0.0, 1e-5, -1e-5, 9.99e-6, -3e-10, 5e-10, 1e8, 999999999.9999999, 1e9, -1e19, 1e300]
    odd += [float("nan"), float("inf"), float("-inf"), None]
    odd += [0.1234567895, -0.1234567885, 2.5e-5, 71.0000000005, -71.0600000015, 42.3601234567891]
    values = odd + [(-1) ** i * 1.7**i * 1.0000000005e-5 for i in range(60)]
    rows = [(x, y) for x, y in zip(values, values[1:] + values[:1])]
    frame = spark.createDataFrame(rows, "x double, y double").withColumn("p", G.point(F.col("x"), F.col("y")))
    frame = frame.withColumn("line", F.array("p", G.point(F.col("y"), F.col("x"))))
    got = frame.select(G.to_wkt(F.col("p")), G.to_wkt(F.col("line"), "line"), F.format_string("%.9f %.9f", "x", "y"), F.format_string("%.9f %.9f", "y", "x"))
    for text, line, forth, back in got.collect():
        assert text == f"POINT ({forth})" and line == f"LINESTRING ({forth}, {back})"
    assert "decimal(19,9)" in got._jdf.queryExecution().optimizedPlan().toString()
    gap = frame.limit(1).select(G.to_wkt(F.array(F.lit(None).cast("struct<x:double,y:double>"), G.point(F.lit(1), F.lit(2))), "line"))
    assert gap.first()[0] == "LINESTRING (null null, 1.000000000 2.000000000)"
