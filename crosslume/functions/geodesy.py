"""Distances on the earth as column expressions (degrees in, metres out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosslume.functions.geometry import parts_of, point

# WGS84 ellipsoid, mean sphere radius, metres per degree of latitude.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)
SPHERE_RADIUS_M = 6371000.0
METERS_PER_DEGREE = 111320.0

# The least radius of curvature (along the meridian at the equator).
LEAST_CURVE_M = WGS84_A * (1.0 - WGS84_F) ** 2

# Up to this distance the formula from the chord is right to 1 mm.
NEAR_M = 20_000.0
GEODESIC_STEPS = 12


def ecef_axes(p: Column | dict[str, Column]) -> dict[str, Column]:
    """Earth-centred x, y, z of a lon/lat point on the WGS84 ellipsoid."""
    lon, lat = F.radians(p["x"]), F.radians(p["y"])
    n = F.lit(WGS84_A) / F.sqrt(1.0 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return {
        "x": n * F.cos(lat) * F.cos(lon),
        "y": n * F.cos(lat) * F.sin(lon),
        "z": n * (1.0 - WGS84_E2) * F.sin(lat),
    }


def vertical(p: Column | dict[str, Column]) -> dict[str, Column]:
    """The upright direction at a point, of length 1."""
    lon, lat = F.radians(p["x"]), F.radians(p["y"])
    return {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}


def ecef(p: Column) -> Column:
    """``ecef_axes`` as one struct."""
    return F.struct(*[value.alias(axis) for axis, value in ecef_axes(p).items()])


def curvature_24(p: Column | dict[str, Column]) -> Column:
    """24 M N at a point, M and N being the WGS84 radii of curvature."""
    s = F.sin(F.radians(p["y"]))
    w = 1.0 - WGS84_E2 * s * s
    return F.lit(24.0 * WGS84_A * WGS84_A * (1.0 - WGS84_E2)) / (w * w)


def geodesic_from_chord(chord: Column, curvature: Column) -> Column:
    """Geodesic length from the straight distance: c + c^3 / (24 M N).

    Holds everywhere, poles and antimeridian too; within 1 mm up to ``NEAR_M``.
    """
    return chord + chord * chord * chord / curvature


def geodesic_distance(
    p: Column | dict[str, Column], q: Column | dict[str, Column], steps: int = GEODESIC_STEPS
) -> Column:
    """Geodesic length on WGS84 between points of any distance, by Vincenty's inverse formula.

    Its iteration runs a fixed number of steps. Within 1 mm, but for points less than a degree from being
    antipodal, where it need not converge and may be off by some kilometres.
    """

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def reduced(point_: Column | dict[str, Column]) -> Column:
        return F.atan((1.0 - WGS84_F) * F.tan(F.radians(point_["y"])))

    def along(g: Column, turn: Column) -> Column:
        """Arc and azimuth for a difference of longitude on the auxiliary sphere."""
        across = g["c2"] * F.sin(turn)
        up = g["c1"] * g["s2"] - g["s1"] * g["c2"] * F.cos(turn)
        first = F.struct(
            F.sqrt(across * across + up * up).alias("sin"),
            (g["s1"] * g["s2"] + g["c1"] * g["c2"] * F.cos(turn)).alias("cos"),
        )

        def azimuth(arc: Column) -> Column:
            sine = F.when(arc["sin"] == 0, 0.0).otherwise(g["c1"] * g["c2"] * F.sin(turn) / arc["sin"])
            return F.struct(arc["sin"].alias("sin"), arc["cos"].alias("cos"), sine.alias("az"), (1.0 - sine * sine).alias("cc"))

        def middle(arc: Column) -> Column:
            m = F.when(arc["cc"] <= 1e-15, 0.0).otherwise(arc["cos"] - 2.0 * g["s1"] * g["s2"] / arc["cc"])
            names = [arc[c].alias(c) for c in ("sin", "cos", "az", "cc")]
            return F.struct(*names, m.alias("m"), F.atan2(arc["sin"], arc["cos"]).alias("arc"))

        return let(let(first, azimuth), middle)

    def turned(g: Column, turn: Column) -> Column:
        def next_turn(a: Column) -> Column:
            c = WGS84_F / 16.0 * a["cc"] * (4.0 + WGS84_F * (4.0 - 3.0 * a["cc"]))
            inner = a["arc"] + c * a["sin"] * (a["m"] + c * a["cos"] * (2.0 * a["m"] * a["m"] - 1.0))
            return g["turn"] + (1.0 - c) * WGS84_F * a["az"] * inner

        return let(along(g, turn), next_turn)

    def length(a: Column) -> Column:
        minor = WGS84_A * (1.0 - WGS84_F)
        u = a["cc"] * (WGS84_A * WGS84_A - minor * minor) / (minor * minor)
        big_a = 1.0 + u / 16384.0 * (4096.0 + u * (u * (320.0 - 175.0 * u) - 768.0))
        big_b = u / 1024.0 * (256.0 + u * (u * (74.0 - 47.0 * u) - 128.0))

        def ended(b: Column) -> Column:
            mm = a["m"] * a["m"]
            last = b / 6.0 * a["m"] * (4.0 * a["sin"] * a["sin"] - 3.0) * (4.0 * mm - 3.0)
            change = b * a["sin"] * (a["m"] + b / 4.0 * (a["cos"] * (2.0 * mm - 1.0) - last))
            return minor * big_a * (a["arc"] - change)

        return let(big_b, ended)

    one, two = reduced(p), reduced(q)
    turn = F.radians(q["x"] - p["x"])
    turn = F.atan2(F.sin(turn), F.cos(turn))  # the short way around
    given = F.struct(
        *(f(u).alias(f"{name}{i}") for i, u in ((1, one), (2, two)) for name, f in (("s", F.sin), ("c", F.cos))),
        turn.alias("turn"),
    )

    def solved(g: Column) -> Column:
        final = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), g["turn"], lambda t, _: turned(g, t))
        return let(let(final, lambda t: along(g, t)), length)

    return let(given, solved)


def sphere_distance(
    p: Column | dict[str, Column],
    q: Column | dict[str, Column],
    radius_m: float = SPHERE_RADIUS_M,
) -> Column:
    """Great-circle distance by the haversine formula."""
    sin_lat = F.sin(F.radians(q["y"] - p["y"]) / 2.0)
    sin_lon = F.sin(F.radians(q["x"] - p["x"]) / 2.0)
    h = sin_lat * sin_lat + F.cos(F.radians(p["y"])) * F.cos(F.radians(q["y"])) * sin_lon * sin_lon
    return 2.0 * radius_m * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def flip_lat_long(p: Column) -> Column:
    """Point with latitude first."""
    return F.when(p.isNotNull(), point(p["y"], p["x"]))


def meters_to_degrees(meters: Column, latitude: Column | float = 42.3601) -> Column:
    """Degrees that span a length: the larger of its latitude and longitude sizes."""
    lat = latitude if isinstance(latitude, Column) else F.lit(float(latitude))
    return F.greatest(
        meters / METERS_PER_DEGREE, meters / (METERS_PER_DEGREE * F.cos(F.radians(lat)))
    )


def web_mercator(p: Column) -> Column:
    """Metres east and north in EPSG:3857 (a sphere of the equatorial radius) of a point in longitude and latitude."""
    x = F.radians(p["x"]) * F.lit(WGS84_A)
    y = F.ln(F.tan(F.lit(math.pi / 4) + F.radians(p["y"]) / 2)) * F.lit(WGS84_A)
    return F.struct(x.alias("x"), y.alias("y"))


def mercator_area(geometry: Column, kind: str = "polygon") -> Column:
    """Square metres of all polygons of a geometry in EPSG:3857: outer rings less holes, whichever way they run.

    NULL without rings.
    """

    def ring_area(ring: Column) -> Column:
        flat = F.transform(ring, web_mercator)

        def around(points: Column) -> Column:
            # From the first vertex on, as the products of whole coordinates would lose digits.
            o = F.get(points, F.lit(0))
            ends = F.zip_with(
                F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
                F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
                lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"]),
            )
            return F.abs(F.aggregate(ends, F.lit(0.0), lambda total, x: total + x)) / 2

        return F.get(F.transform(F.array(flat), around), F.lit(0))

    def polygon_area(rings: Column) -> Column:
        signed = F.transform(rings, lambda ring, i: F.when(i == 0, ring_area(ring)).otherwise(-ring_area(ring)))
        return F.aggregate(signed, F.lit(0.0), lambda a, x: a + x)

    polygons = parts_of(geometry, kind, "polygons")
    total = F.aggregate(F.transform(polygons, polygon_area), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.exists(polygons, lambda rings: F.size(rings) > 0), total)
