import math
import random

import pytest
from pyspark.sql import functions as F

from crosslume.functions import geodesy as D
from crosslume.functions.geometry import point


def vincenty(lon1, lat1, lon2, lat2):
    """Inverse geodesic on WGS84 by iteration."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(v))) for v in (lat1, lat2))
    big_l = math.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = big_l
    for _ in range(200):
        s = math.hypot(
            math.cos(u2) * math.sin(lam),
            math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam),
        )
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        alpha = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - alpha**2
        mid = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        new = big_l + (1 - k) * f * alpha * (
            sigma + k * s * (mid + k * c * (-1 + 2 * mid**2))
        )
        if abs(new - lam) < 1e-15:
            break
        lam = new
    usq = cos2 * (a**2 - b**2) / b**2
    big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
    big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
    d = big_b * s * (
        mid
        + big_b / 4 * (c * (-1 + 2 * mid**2) - big_b / 6 * mid * (-3 + 4 * s**2) * (-3 + 4 * mid**2))
    )
    return b * big_a * (sigma - d)


@pytest.mark.parametrize("meters, error", [(20, 1e-7), (200, 1e-7), (2000, 1e-6), (20000, 1e-3)])
def test_geodesic_from_chord(spark, meters, error):
    rng = random.Random(meters)
    rows = []
    for lat in (0.0, 10.0, -42.36, 70.0, 85.0, -89.0):
        for _ in range(50):
            bearing, lon = rng.uniform(0, 2 * math.pi), rng.uniform(-180, 180)
            step = math.degrees(meters / 6371000.0)
            to_lat = lat + step * math.cos(bearing)
            to_lon = lon + step * math.sin(bearing) / math.cos(math.radians(lat))
            rows.append((lon, lat, to_lon, to_lat))
    p, q = point(F.col("a"), F.col("b")), point(F.col("c"), F.col("d"))
    e, g = D.ecef(p), D.ecef(q)
    chord = F.sqrt(sum(((e[i] - g[i]) * (e[i] - g[i]) for i in "yz"), (e["x"] - g["x"]) * (e["x"] - g["x"])))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select("*", D.geodesic_from_chord(chord, D.curvature_24(p)).alias("m")).collect()
    for r in got:
        assert r["m"] == pytest.approx(vincenty(r["a"], r["b"], r["c"], r["d"]), abs=error)


def test_sphere_distance(spark):
    df = spark.range(1).select(
        D.sphere_distance(point(F.lit(0.0), F.lit(0.0)), point(F.lit(90.0), F.lit(0.0))).alias("q"),
        D.sphere_distance(point(F.lit(179.9), F.lit(0.0)), point(F.lit(-179.9), F.lit(0.0))).alias("a"),
    )
    quarter, across = df.first()
    assert quarter == pytest.approx(math.pi / 2 * 6371000)
    assert across == pytest.approx(math.radians(0.2) * 6371000)


def test_meters_to_degrees(spark):
    out = spark.range(1).select(
        D.meters_to_degrees(F.lit(20.0)).alias("d"), D.meters_to_degrees(F.lit(20.0), 0.0).alias("e")
    )
    d, e = out.first()
    assert d == pytest.approx(20 / (111320 * math.cos(math.radians(42.3601))))
    assert e == pytest.approx(20 / 111320)


def test_mercator_area_takes_holes_off(spark):
    def ring(w, turn):
        corners = [(-w, -w), (w, -w), (w, w), (-w, w), (-w, -w)]
        return corners[::turn]

    rows = [(1, [ring(0.01, 1)]), (2, [ring(0.01, 1), ring(0.005, -1)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "id long, g array<array<struct<x:double,y:double>>>")
    area = {r["id"]: r["a"] for r in df.select("id", D.mercator_area(F.col("g")).alias("a")).collect()}
    side = math.radians(0.02) * 6378137
    assert area[1] == pytest.approx(side * side, rel=1e-6)
    assert area[2] == pytest.approx(0.75 * side * side, rel=1e-6)
    assert area[3] is None and area[4] is None


def along_geodesic(lon, lat, azimuth, length, steps=4000):
    """Where a geodesic ends: its differential equations, by Runge and Kutta."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)

    def slope(state):
        phi, _, alpha = state
        w = math.sqrt(1 - e2 * math.sin(phi) ** 2)
        n, m = a / w, a * (1 - e2) / w**3
        east = math.sin(alpha) / n
        return (math.cos(alpha) / m, east / math.cos(phi), math.tan(phi) * east)

    state, h = (math.radians(lat), math.radians(lon), azimuth), length / steps
    for _ in range(steps):
        k1 = slope(state)
        k2 = slope([s + h / 2 * k for s, k in zip(state, k1)])
        k3 = slope([s + h / 2 * k for s, k in zip(state, k2)])
        k4 = slope([s + h * k for s, k in zip(state, k3)])
        state = [s + h / 6 * (p + 2 * q + 2 * r + t) for s, p, q, r, t in zip(state, k1, k2, k3, k4)]
    return (math.degrees(state[1]) + 180) % 360 - 180, math.degrees(state[0])


def test_geodesic_of_any_length(spark):
    rng = random.Random(1)
    rows = []
    for length in (2e4, 1e5, 1e6, 5e6, 1.5e7):
        for _ in range(8):
            start = (rng.uniform(-180, 180), rng.uniform(-60, 60))
            rows.append((*start, *along_geodesic(*start, rng.uniform(0, 2 * math.pi), length), length))
    # Along the equator and a meridian, to the pole, across the antimeridian, and nowhere.
    a = 6378137.0
    rows += [(0.0, 0.0, 9.0, 0.0, a * math.pi / 20), (10.0, 0.0, 10.0, 90.0, 10001965.729), (5.0, 5.0, 5.0, 5.0, 0.0)]
    rows += [(179.0, 0.0, -179.0, 0.0, a * math.pi / 90)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want double")
    found = df.select(D.geodesic_distance(point(F.col("a"), F.col("b")), point(F.col("c"), F.col("d"))).alias("got"), "want")
    assert max(abs(r["got"] - r["want"]) for r in found.collect()) < 1e-3
