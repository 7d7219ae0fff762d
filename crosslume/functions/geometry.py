"""Planar geometry as column expressions.

A point is ``struct<x,y>``, a line ``array<point>`` and a polygon ``array<ring>`` with closed rings, the first one the
outer ring and the others holes. What has parts keeps them: a multipoint is ``struct<points>``, a multiline
``struct<lines>``, a multipolygon ``struct<polygons>``, each an array of parts, and ``geometry`` takes anything, as
``struct<type,points,lines,polygons>``.
Nothing here is a Python UDF: every function returns a ``Column`` built from Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
POLYGON = T.ArrayType(LINE)
#: Kinds with parts, and the field that holds them.
PARTS = {"multipoint": "points", "multiline": "lines", "multipolygon": "polygons"}
SINGLE = {"multipoint": "point", "multiline": "line", "multipolygon": "polygon"}
_FAMILIES = {"points": T.ArrayType(POINT), "lines": T.ArrayType(LINE), "polygons": T.ArrayType(POLYGON)}
GEOMETRY = T.StructType(
    [T.StructField("type", T.StringType()), *(T.StructField(name, kind) for name, kind in _FAMILIES.items())]
)
KINDS = {
    "point": POINT,
    "line": LINE,
    "polygon": POLYGON,
    **{kind: T.StructType([T.StructField(name, _FAMILIES[name])]) for kind, name in PARTS.items()},
    "geometry": GEOMETRY,
}

# Decimal places kept for computed coordinates (1e-9 degree is 0.1 mm): equal points compare equal.
# Fixed value: decimals a coordinate keeps when geometry is loaded or simplified (the default of the
# WKT writer that geometry passes through there).
TEXT_DECIMALS = 6
SNAP_DECIMALS = 9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value, so that it is computed once however often ``body`` refers to it.

    Spark has no common subexpressions inside lambdas, in branches and in the filters it infers.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(data_type: T.DataType) -> str | None:
    """The name of a geometry's kind (see ``KINDS``), or None, from a column's type."""

    def shape(t: T.DataType):
        if isinstance(t, T.ArrayType):
            return [shape(t.elementType)]
        return {f.name: shape(f.dataType) for f in t.fields} if isinstance(t, T.StructType) else ""

    return next((kind for kind, own in KINDS.items() if shape(own) == shape(data_type)), None)


def parts_of(geometry: Column, kind: str, family: str) -> Column:
    """The points, lines or polygons of a geometry, as an array (NULL where the geometry is)."""
    if kind == "geometry" or PARTS.get(kind) == family:
        return geometry[family]
    if family == f"{kind}s":
        return F.when(geometry.isNotNull(), F.array(geometry))
    return F.when(geometry.isNotNull(), F.array().cast(_FAMILIES[family]))


def vertex_lists(geometry: Column, kind: str) -> Column:
    """All rings, lines and single points of a geometry, as lists of vertices."""
    rings, lines = F.flatten(parts_of(geometry, kind, "polygons")), parts_of(geometry, kind, "lines")
    if kind in ("polygon", "multipolygon"):
        return geometry if kind == "polygon" else rings
    if kind in ("line", "multiline"):
        return lines
    return F.concat(rings, lines, F.transform(parts_of(geometry, kind, "points"), lambda p: F.array(p)))


def of_parts(kind: str, type_name: Column, parts: dict[str, Column]) -> Column:
    """A geometry of this kind out of arrays of parts by family; an error if the kind has no room for them.

    ``type_name`` is the name a ``geometry`` keeps.
    """
    every = {name: parts.get(name, F.array().cast(own)) for name, own in _FAMILIES.items()}
    if kind == "geometry":
        return F.struct(type_name.alias("type"), *(part.alias(name) for name, part in every.items()))
    family = PARTS.get(kind, f"{kind}s")
    if kind in PARTS:
        return F.struct(every[family].alias(family))
    more = F.raise_error(F.lit(f"a geometry of several parts is no {kind}: read it as multi{kind}"))
    return let(every[family], lambda own: F.when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(more.cast(KINDS[kind])))


def map_points(geometry: Column, kind: str, change: Callable[[Column], Column]) -> Column:
    """The geometry with every vertex changed."""

    def line(points: Column) -> Column:
        return F.transform(points, change)

    def polygon(rings: Column) -> Column:
        return F.transform(rings, line)

    changes = {"points": change, "lines": line, "polygons": polygon}

    def changed(own: Column) -> Column:
        if kind in ("point", "line", "polygon"):
            return F.when(own.isNotNull(), changes[f"{kind}s"](own))
        names = [PARTS[kind]] if kind in PARTS else list(changes)
        fields = [F.transform(own[name], changes[name]).alias(name) for name in names]
        kept = [own["type"].alias("type")] if kind == "geometry" else []
        return F.when(own.isNotNull(), F.struct(*kept, *fields))

    return let(geometry, changed)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def snap(value: Column, decimals: int = SNAP_DECIMALS) -> Column:
    """Round half up by plain arithmetic; never yields -0.0."""
    scale = F.lit(10.0**decimals)
    return F.floor(value * scale + F.lit(0.5)) / scale


def snap_point(p: Column, decimals: int = SNAP_DECIMALS) -> Column:
    return F.when(p.isNotNull(), point(snap(p["x"], decimals), snap(p["y"], decimals)))


def midpoint(p: Column, q: Column) -> Column:
    return F.when(
        p.isNotNull() & q.isNotNull(), point((p["x"] + q["x"]) / 2.0, (p["y"] + q["y"]) / 2.0)
    )


def make_line(p: Column, q: Column) -> Column:
    """Two-point line, NULL when an end is NULL."""
    return F.when(p.isNotNull() & q.isNotNull(), F.array(p, q))


def point_n(line: Column, n: int) -> Column:
    """n-th vertex, counted from 1; NULL beyond the end."""
    return F.try_element_at(line, F.lit(n))


def planar_distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def line_pieces(line: Column) -> Column:
    """array<struct<p,q>> of consecutive vertex pairs, empty below two vertices."""
    n = F.size(line)
    return F.when(
        n > 1,
        F.zip_with(
            F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda p, q: F.struct(p.alias("p"), q.alias("q")),
        ),
    )


def pieces_of(geometry: Column, kind: str) -> Column:
    """The vertex pairs of all lines of a geometry, one line after the other; none joins two lines."""
    if kind == "line":
        return line_pieces(geometry)
    each = F.transform(parts_of(geometry, kind, "lines"), line_pieces)
    return F.flatten(F.filter(each, lambda pieces: pieces.isNotNull()))


def ring_edges(ring: Column) -> Column:
    """Edges of a closed ring; a ring has at least four vertices, anything shorter has no edge."""
    return F.when(F.size(ring) >= 4, line_pieces(ring))


# ---------------------------------------------------------------- text

_NUMBERS = "%.9f %.9f"


def _numbers_text(*points: Column) -> Column:
    """Coordinates with nine decimals, points parted by ", ".

    As ``_NUMBERS`` writes them. Casts round alike and take half the time, but know neither NULL, NaN, -0.0 nor other ends of the scale.
    """
    values = [p[axis] for p in points for axis in "xy"]
    plain = reduce(and_, ((F.abs(v) >= 1e-5) & (F.abs(v) < 1e9) for v in values))
    casts = [v.cast("decimal(19,9)").cast("string") for v in values]
    pairs = [F.concat_ws(" ", x, y) for x, y in zip(casts[::2], casts[1::2], strict=True)]
    text = F.concat_ws(", ", *pairs) if len(pairs) > 1 else pairs[0]
    return F.when(plain, text).otherwise(F.format_string(", ".join([_NUMBERS] * len(points)), *values))


def _coords_text(points: Column) -> Column:
    texts = F.array_join(F.transform(points, lambda p: F.format_string(_NUMBERS, p["x"], p["y"])), ", ")
    two = _numbers_text(F.get(points, F.lit(0)), F.get(points, F.lit(1)))
    # Most lines have two vertices; outside of a lambda their text is made by generated code.
    known = F.get(points, F.lit(0)).isNotNull() & F.get(points, F.lit(1)).isNotNull()
    return F.concat(F.lit("("), F.when((F.size(points) == 2) & known, two).otherwise(texts), F.lit(")"))


def _polygon_body(rings: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(rings, _coords_text), ", "), F.lit(")"))


def _pair_text(p: Column) -> Column:
    return F.format_string(f"({_NUMBERS})", p["x"], p["y"])


# Names of the types in WKT, by family: of one part, of several.
_WKT_NAMES = {
    "points": ("POINT", "MULTIPOINT"),
    "lines": ("LINESTRING", "MULTILINESTRING"),
    "polygons": ("POLYGON", "MULTIPOLYGON"),
}
_COLLECTION = "GEOMETRYCOLLECTION"
_BODIES = {"points": _pair_text, "lines": _coords_text, "polygons": _polygon_body}


def _family_text(parts: Column, family: str, several: Column) -> Column:
    """One part under its own name, unless ``several``; any number of parts under that of many."""
    one, many = _WKT_NAMES[family]
    body = _BODIES[family]
    single = F.concat(F.lit(f"{one} "), body(F.get(parts, F.lit(0))))
    multi = F.concat(F.lit(f"{many} ("), F.array_join(F.transform(parts, body), ", "), F.lit(")"))
    multi = F.when(F.size(parts) == 0, F.lit(f"{many} EMPTY")).otherwise(multi)
    return F.when((F.size(parts) == 1) & ~several, single).otherwise(multi)


def _any_text(geometry: Column) -> Column:
    """Text of a ``geometry``, under the type it keeps."""
    text = None
    for family, (one, many) in _WKT_NAMES.items():
        own = _family_text(geometry[family], family, geometry["type"] == many)
        text = (F if text is None else text).when(geometry["type"].isin(one, many), own)

    def each(family: str) -> Column:
        return F.transform(geometry[family], lambda p: F.concat(F.lit(f"{_WKT_NAMES[family][0]} "), _BODIES[family](p)))

    every = F.concat(*(each(family) for family in _WKT_NAMES))
    body = F.concat(F.lit(f"{_COLLECTION} ("), F.array_join(every, ", "), F.lit(")"))
    return text.otherwise(F.when(F.size(every) == 0, F.lit(f"{_COLLECTION} EMPTY")).otherwise(body))


def to_wkt(geometry: Column, kind: str = "point") -> Column:
    """Canonical WKT with nine decimals, so that equal geometries have equal text.

    A geometry with parts is written as one of many parts unless it has just one.
    """
    if kind in PARTS:
        text = _family_text(geometry[PARTS[kind]], PARTS[kind], F.lit(False))
    elif kind == "geometry":
        text = _any_text(geometry)
    elif kind == "point":
        text = F.concat(F.lit("POINT ("), _numbers_text(geometry), F.lit(")"))
    elif kind == "line":
        text = F.concat(F.lit("LINESTRING "), _coords_text(geometry))
    elif kind == "polygon":
        # A polygon without area is reduced to the segment it covers.
        flat = (F.size(geometry) == 1) & (F.size(F.get(geometry, F.lit(0))) == 2)
        text = F.when(flat, F.concat(F.lit("LINESTRING "), _coords_text(F.get(geometry, F.lit(0))))).otherwise(
            F.concat(F.lit("POLYGON "), _polygon_body(geometry))
        )
    else:
        raise ValueError(f"unknown geometry kind {kind!r}")
    return F.when(geometry.isNotNull(), text)


_BETWEEN_LINES = r"\)\s*,\s*\("
_BETWEEN_POLYGONS = r"\)\s*\)\s*,\s*\(\s*\("
_NO_MEMBER = r"(?i)\w*\s*EMPTY\s*,\s*|,\s*\w*\s*EMPTY"
_EMPTY = r"(?i)^\s*\w+(\s+(Z|M|ZM))?\s+EMPTY\s*$"


def _text_point(text: Column) -> Column:
    numbers = F.split(F.trim(F.translate(text, "()", "  ")), r"\s+")
    return let(numbers, lambda own: point(F.get(own, F.lit(0)), F.get(own, F.lit(1))))


def _text_line(text: Column) -> Column:
    return F.transform(F.split(text, ","), _text_point)


def _text_polygon(text: Column) -> Column:
    return F.transform(F.split(text, _BETWEEN_LINES), _text_line)


def _text_parts(text: Column, family: str) -> Column:
    """The parts of a text of this family, single or many."""
    body = F.regexp_replace(F.regexp_replace(text, _NO_MEMBER, ""), r"^[^(]*\(", "")
    between, parse = {
        "points": (",", _text_point),
        "lines": (_BETWEEN_LINES, _text_line),
        "polygons": (_BETWEEN_POLYGONS, _text_polygon),
    }[family]
    return F.transform(F.split(body, between), parse)


def _wkt_type(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+?)(?i:Z|M|ZM)?\s*(?:\(|\s)", 1))


def _text_any(text: Column) -> Column:
    """A ``geometry`` out of text of any type."""
    inside = F.regexp_replace(F.regexp_replace(text, _NO_MEMBER, ""), rf"(?i)^\s*{_COLLECTION}\s*(Z|M|ZM)?\s*\((.*)\)\s*$", "$2")
    next_member = r"(?i)\s*,\s*(?=(?:MULTI)?(?:POINT|LINESTRING|POLYGON|GEOMETRYCOLLECTION))"
    collection = _wkt_type(text) == _COLLECTION
    members = F.when(collection, F.split(inside, next_member)).otherwise(F.array(text))
    typed = F.transform(members, lambda m: F.struct(_wkt_type(m).alias("type"), m.alias("text")))
    known = [name for names in _WKT_NAMES.values() for name in names]

    def parsed(each: Column) -> Column:
        def every(family: str) -> Column:
            own = F.filter(each, lambda m: m["type"].isin(*_WKT_NAMES[family]))
            return F.flatten(F.transform(own, lambda m: _text_parts(m["text"], family)))

        wrong = F.exists(each, lambda m: ~m["type"].isin(*known))
        return F.when(
            wrong, F.raise_error(F.concat(F.lit("not a geometry in WKT: "), text)).cast(GEOMETRY)
        ).otherwise(of_parts("geometry", _wkt_type(text), {family: every(family) for family in _WKT_NAMES}))

    return let(typed, parsed)


def from_wkt(text: Column, kind: str = "point") -> Column:
    """Parse WKT; Z and M values are left out, EMPTY gives NULL (in a collection, nothing), other text raises an error.

    Kinds with parts take texts of one part too; ``geometry`` takes any type and collections, though not
    a collection inside another.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown geometry kind {kind!r}")

    def parsed(own: Column) -> Column:
        empty = own.isNull() | own.rlike(_EMPTY)
        if kind == "geometry":
            return F.when(empty, F.lit(None)).otherwise(_text_any(own))
        family = PARTS.get(kind, f"{kind}s")
        one, many = _WKT_NAMES[family]
        return (
            F.when(empty, F.lit(None))
            .when(own.rlike(rf"(?i)^\s*({one}|{many})\s*(Z|M|ZM)?\s*\("), of_parts(kind, F.lit(None), {family: _text_parts(own, family)}))
            .otherwise(F.raise_error(F.concat(F.lit(f"not a {kind} in WKT: "), own)))
        )

    return let(text, parsed)


# ---------------------------------------------------------------- rectangle


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


# Vertices from which on rings are searched by halving instead of scanned.
LARGE_RING = 64


def _first_true(n: Column, test: Callable[[Column], Column]) -> Column:
    """The least t below n for which ``test`` holds, n if there is none, given that it holds for all above as well."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))

    def span(low: Column, high: Column) -> Column:
        return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        def around(middle: Column) -> Column:
            return F.when(test(middle), span(s["low"], middle)).otherwise(span(middle + 1, s["high"]))

        return F.when(s["low"] < s["high"], let(((s["low"] + s["high"]) / 2).cast("int"), around)).otherwise(s)

    return F.aggregate(rounds, span(F.lit(0), n), halve)["low"]


def _half_hull(points: Column) -> Column:
    """Lower hull of points sorted by (x, y).

    The turn test holds for a prefix of the chain and fails for the rest, so one filter, or for a long
    chain a search by halves, removes every vertex a new point makes obsolete.
    """

    def add(chain: Column, p: Column) -> Column:
        kept = F.filter(
            chain,
            lambda v, k: (k == 0) | (_cross(F.get(chain, k - 1), v, p) > 0),
        )
        right = _first_true(F.size(chain) - 1, lambda t: _cross(F.get(chain, t), F.get(chain, t + 1), p) <= 0)
        kept = F.when(F.size(chain) > LARGE_RING, F.slice(chain, F.lit(1), right + 1)).otherwise(kept)
        return F.concat(kept, F.array(p))

    return F.aggregate(points, F.array().cast(LINE), add)


def _hull(points: Column) -> Column:
    """Counter-clockwise hull of sorted distinct points, without a closing vertex."""

    def without_last(chain: Column) -> Column:
        return F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0)))

    return F.concat(
        let(_half_hull(points), without_last), let(_half_hull(F.reverse(points)), without_last)
    )


def _best_box(hull: Column) -> Column:
    """Smallest box over all hull edges: unit direction u and the extents along and across it.

    Of a large hull the extents are searched by halves. Where rounding misleads a search, a box comes out too
    small; so if all vertices lie in the smallest box it is the right one, and if not, all are scanned.
    """

    def inside(box: Column) -> Column:
        room = F.lit(1e-12) * (F.abs(box["a1"] - box["a0"]) + F.abs(box["b1"] - box["b0"]))

        def within(p: Column) -> Column:
            a = p["x"] * box["u"]["x"] + p["y"] * box["u"]["y"]
            b = p["y"] * box["u"]["x"] - p["x"] * box["u"]["y"]
            along = (a >= box["a0"] - room) & (a <= box["a1"] + room)
            return along & (b >= box["b0"] - room) & (b <= box["b1"] + room)

        return F.forall(hull, within)

    searched = F.when(F.size(hull) > LARGE_RING, _searched_box(hull))
    return let(searched, lambda box: F.when(box.isNotNull() & inside(box), box).otherwise(_scanned_box(hull)))


def _searched_box(hull: Column) -> Column:
    """As ``_scanned_box``: the edges of a hull turn steadily, so its extreme vertices are where a quarter is passed."""
    n = F.size(hull)

    def vertex(i: Column) -> Column:
        return F.get(hull, i % n)

    def box(start: Column, k: Column) -> Column:
        def unit(end: Column) -> Column:
            length = F.hypot(end["x"] - start["x"], end["y"] - start["y"])
            x, y = (end["x"] - start["x"]) / length, (end["y"] - start["y"]) / length
            return F.struct(x.alias("x"), y.alias("y"))

        def passed(u: Column, quarters: int) -> Column:
            """The vertex from which on edges have turned by so many quarters."""

            def turned(t: Column) -> Column:
                def test(e: Column) -> Column:
                    dot = u["x"] * (e["q"]["x"] - e["p"]["x"]) + u["y"] * (e["q"]["y"] - e["p"]["y"])
                    cross = u["x"] * (e["q"]["y"] - e["p"]["y"]) - u["y"] * (e["q"]["x"] - e["p"]["x"])
                    if quarters == 1:
                        return ~((dot > 0) & (cross >= 0))
                    return (cross < 0) | ((cross == 0) & (dot < 0)) if quarters == 2 else (dot >= 0) & (cross < 0)

                return let(F.struct(vertex(k + t).alias("p"), vertex(k + t + 1).alias("q")), test)

            return vertex(k + 1 + _first_true(n - 1, lambda t: turned(t + 1)))

        def extents(u: Column) -> Column:
            def along(p: Column) -> Column:
                return p["x"] * u["x"] + p["y"] * u["y"]

            def across(p: Column) -> Column:
                return p["y"] * u["x"] - p["x"] * u["y"]

            return F.struct(
                u.alias("u"),
                let(passed(u, 3), along).alias("a0"),
                let(passed(u, 1), along).alias("a1"),
                across(start).alias("b0"),
                let(passed(u, 2), across).alias("b1"),
            )

        def ranked(s: Column) -> Column:
            area = (s["a1"] - s["a0"]) * (s["b1"] - s["b0"])
            return F.struct(F.round(area, 14).alias("area"), k.alias("k"), s.alias("box"))

        return let(vertex(k + 1), lambda end: let(unit(end), lambda u: let(extents(u), ranked)))

    return F.array_min(F.transform(hull, box))["box"]


def _scanned_box(hull: Column) -> Column:
    """Smallest box over all hull edges.

    The hull lies to the left of its edges, so the lower extent across is that of the edge itself.
    """

    def box(start: Column, k: Column) -> Column:
        end = F.get(hull, (k + 1) % F.size(hull))
        delta = F.struct((end["x"] - start["x"]).alias("x"), (end["y"] - start["y"]).alias("y"))

        def unit(d: Column) -> Column:
            length = F.hypot(d["x"], d["y"])
            return F.struct((d["x"] / length).alias("x"), (d["y"] / length).alias("y"))

        def along(u: Column) -> Column:
            return F.struct(
                u.alias("u"),
                F.transform(hull, lambda p: p["x"] * u["x"] + p["y"] * u["y"]).alias("a"),
                F.array_max(
                    F.transform(hull, lambda p: p["y"] * u["x"] - p["x"] * u["y"])
                ).alias("b1"),
                (start["y"] * u["x"] - start["x"] * u["y"]).alias("b0"),
            )

        def extents(s: Column) -> Column:
            return F.struct(
                s["u"].alias("u"),
                F.array_min(s["a"]).alias("a0"),
                F.array_max(s["a"]).alias("a1"),
                s["b0"].alias("b0"),
                s["b1"].alias("b1"),
            )

        def ranked(s: Column) -> Column:
            area = (s["a1"] - s["a0"]) * (s["b1"] - s["b0"])
            return F.struct(F.round(area, 14).alias("area"), k.alias("k"), s.alias("box"))

        return let(
            delta,
            lambda d: let(
                unit(d), lambda u: let(along(u), lambda s: let(extents(s), ranked))
            ),
        )

    return F.array_min(F.transform(hull, box))["box"]


def _box_ring(box: Column, origin: Column, decimals: int) -> Column:
    """Closed counter-clockwise ring that starts at the lowest (y, x) corner."""

    def corner(a: str, b: str) -> Column:
        return point(
            snap(box[a] * box["u"]["x"] - box[b] * box["u"]["y"] + origin["x"], decimals),
            snap(box[a] * box["u"]["y"] + box[b] * box["u"]["x"] + origin["y"], decimals),
        )

    def close(corners: Column) -> Column:
        lowest = F.array_min(
            F.transform(corners, lambda c, i: F.struct(c["y"], c["x"], i.alias("i")))
        )["i"]
        return let(
            lowest, lambda first: F.array(*[F.get(corners, (first + i) % 4) for i in (0, 1, 2, 3, 0)])
        )

    corners = F.array(corner("a0", "b0"), corner("a1", "b0"), corner("a1", "b1"), corner("a0", "b1"))
    return let(corners, close)


def min_area_rectangle(polygon: Column, decimals: int = SNAP_DECIMALS) -> Column:
    """Oriented rectangle of least area around a polygon, as a polygon.

    One side of it lies on a hull edge, so the hull edges are the only directions tried. Equal areas
    go to the earlier hull edge, counted counter-clockwise from the lowest (x, y) vertex. A polygon
    whose vertices lie on one line gives that segment as its only "ring".
    """

    def around(rings: Column) -> Column:
        vertices = F.flatten(rings)

        def from_origin(origin: Column) -> Column:
            local = F.sort_array(
                F.array_distinct(
                    F.transform(
                        vertices,
                        lambda p: F.struct(
                            (p["x"] - origin["x"]).alias("x"), (p["y"] - origin["y"]).alias("y")
                        ),
                    )
                )
            )

            def segment(points: Column) -> Column:
                ends = F.array(F.get(points, F.lit(0)), F.get(points, F.size(points) - 1))
                return F.transform(
                    ends,
                    lambda p: point(
                        snap(p["x"] + origin["x"], decimals), snap(p["y"] + origin["y"], decimals)
                    ),
                )

            def rectangle(points: Column) -> Column:
                return let(
                    _hull(points),
                    lambda hull: F.when(
                        F.size(hull) >= 3,
                        let(_best_box(hull), lambda box: _box_ring(box, origin, decimals)),
                    ).otherwise(segment(points)),
                )

            return let(local, rectangle)

        return let(F.get(vertices, F.lit(0)), from_origin)

    return F.when(F.size(F.flatten(polygon)) > 0, F.array(let(polygon, around)))


# ---------------------------------------------------------------- segments


def segment_turns(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Side of c and d seen from ab (o1, o2), and of a and b seen from cd (o3, o4)."""
    return {
        "o1": _cross(a, b, c),
        "o2": _cross(a, b, d),
        "o3": _cross(c, d, a),
        "o4": _cross(c, d, b),
    }


def segments_apart(turns: dict[str, Column]) -> Column:
    """TRUE when one segment lies wholly on one side of the other's line."""
    return (turns["o1"] * turns["o2"] > 0) | (turns["o3"] * turns["o4"] > 0)


def common_points(
    a: Column,
    b: Column,
    c: Column,
    d: Column,
    turns: dict[str, Column],
    bind: Callable[[dict[str, Column]], dict[str, Column]] = dict,
) -> Column:
    """Common points of the segments ab and cd, given that they are not ``segments_apart``.

    ``bind`` may turn intermediate values into columns of a DataFrame, so that each is computed once.
    """
    o1, o2, o3 = turns["o1"], turns["o2"], turns["o3"]
    is_point = (a["x"] == b["x"]) & (a["y"] == b["y"])
    # For both ends of cd on the line of ab: positions from a along ab, or along cd if ab is a point.
    way = bind(
        {
            f"way_{axis}": F.when(is_point, d[axis] - c[axis]).otherwise(b[axis] - a[axis])
            for axis in "xy"
        }
    )
    x, y = way["way_x"], way["way_y"]
    at = bind(
        {
            **{
                f"at_{name}": (p["x"] - a["x"]) * x + (p["y"] - a["y"]) * y
                for name, p in {"b": b, "c": c, "d": d}.items()
            },
            "square": x * x + y * y,
        }
    )
    share = bind(
        {
            "cross": o1 / F.nullif(o1 - o2, F.lit(0.0)),
            "low": F.greatest(F.lit(0.0), F.least(at["at_c"], at["at_d"]))
            / F.nullif(at["square"], F.lit(0.0)),
            "high": F.least(at["at_b"], F.greatest(at["at_c"], at["at_d"]))
            / F.nullif(at["square"], F.lit(0.0)),
        }
    )
    on_line = (o1 == 0) & (o2 == 0)
    # The one point of a crossing, or the first and last of a stretch.
    first = bind(
        {
            "first_x": F.when(on_line, a["x"] + share["low"] * x).otherwise(
                c["x"] + share["cross"] * (d["x"] - c["x"])
            ),
            "first_y": F.when(on_line, a["y"] + share["low"] * y).otherwise(
                c["y"] + share["cross"] * (d["y"] - c["y"])
            ),
            "last_x": a["x"] + share["high"] * x,
            "last_y": a["y"] + share["high"] * y,
        }
    )
    one = point(first["first_x"], first["first_y"])
    touches = ~on_line | ((share["low"] == share["high"]) & (~is_point | (o3 == 0)))
    return F.when(touches, F.array(one)).when(
        on_line & (share["low"] < share["high"]),
        F.array(one, point(first["last_x"], first["last_y"])),
    )


def segment_crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Common points of the closed segments ab and cd, as an array; NULL when there is none.

    One point for a crossing or a touch, the two ends for a stretch on one line.
    """
    turns = segment_turns(a, b, c, d)
    return F.when(~segments_apart(turns), common_points(a, b, c, d, turns))
