"""The registered queries in plain SQL, by other means: theta joins instead of grids, all vertex pairs
instead of a hull, a parametric intersection test and a mid-latitude geodesic."""

from __future__ import annotations

import re
from collections import Counter

from crosslume.plans.fixtures import PARTED_LINES, PARTED_POLYGONS

# Rounds a coordinate half up to 9 and to 6 decimals.
_SNAP9 = "floor(({}) * 1e9 + 0.5) / 1e9"
_SNAP6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def _s9(expression: str) -> str:
    return _SNAP9.format(expression)


def _s6(expression: str) -> str:
    return _SNAP6.format(expression)


def _mean9(column: str) -> str:
    """Mean of snapped coordinates, as whole billionths so that the order of the sum is no matter."""
    units = f"sum(CAST(round({column} * 1e9) AS BIGINT))"
    return f"floor((2 * {units} + count(*)) / (2e0 * count(*))) / 1e9"


_CTES = {
    "frame": """
        SELECT p_partkey AS id, p_size,
               -7.106e1 + (p_partkey // 4000000) * 5e-2 + (p_partkey % 100) * 4e-4 AS ox,
               4.236e1 + ((p_partkey // 100) % 40000) * 4e-4 AS oy,
               CASE p_size % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 8e-1 WHEN 2 THEN 6e-1 ELSE 0e0 END AS cs,
               CASE p_size % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 6e-1 WHEN 2 THEN 8e-1 ELSE 1e0 END AS sn
        FROM part""",
    "ring": """
        SELECT * FROM (VALUES (0, -6e-5, -2e-5), (1, 6e-5, -2e-5), (2, 6e-5, 2e-5),
                              (3, 0e0, 1e-5), (4, -6e-5, 2e-5), (5, -6e-5, -2e-5)) t(k, u, v)""",
    "vertex": """
        SELECT id, k, ox + u * cs - v * sn AS x, oy + u * sn + v * cs AS y
        FROM frame, ring""",
    "metre": """
        SELECT id, k, 6378137e0 * radians(x) AS mx, 6378137e0 * ln(tan(pi() / 4 + radians(y) / 2)) AS my
        FROM vertex""",
    "direction": """
        SELECT a.id, a.k AS i, b.k AS j, a.x AS x0, a.y AS y0,
               (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ux,
               (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS uy
        FROM vertex a JOIN vertex b ON a.id = b.id AND a.k < b.k AND b.k < 5""",
    "span": """
        SELECT d.id, i, j, x0, y0, ux, uy,
               min((v.x - x0) * ux + (v.y - y0) * uy) AS a0,
               max((v.x - x0) * ux + (v.y - y0) * uy) AS a1,
               min((v.y - y0) * ux - (v.x - x0) * uy) AS b0,
               max((v.y - y0) * ux - (v.x - x0) * uy) AS b1
        FROM direction d JOIN vertex v ON v.id = d.id
        GROUP BY ALL""",
    "box": """
        SELECT id, b.* FROM (
            SELECT id, unnest([arg_min({'x0': x0, 'y0': y0, 'ux': ux, 'uy': uy, 'a0': a0, 'a1': a1, 'b0': b0, 'b1': b1},
                                       (round((a1 - a0) * (b1 - b0), 14), i, j))]) AS b
            FROM span GROUP BY id)""",
    "corner": f"""
        SELECT id, c, {_s6("x0 + a * ux - b * uy")} AS x, {_s6("y0 + a * uy + b * ux")} AS y
        FROM (SELECT *, 0 AS c, a0 AS a, b0 AS b FROM box
              UNION ALL SELECT *, 1, a1, b0 FROM box
              UNION ALL SELECT *, 2, a1, b1 FROM box
              UNION ALL SELECT *, 3, a0, b1 FROM box)""",
    "rect": """
        SELECT c.id, (c.c - s.first + 4) % 4 AS pos, c.x, c.y
        FROM corner c JOIN (SELECT id, arg_min(c, (y, x)) AS first FROM corner GROUP BY id) s ON s.id = c.id""",
    "edge": """
        SELECT p.id AS cid, p.pos + 1 AS eid, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
        FROM rect p JOIN rect q ON q.id = p.id AND q.pos = (p.pos + 1) % 4""",
    "offset_point": """
        SELECT id, oneway, k, ox + u * cs - v * sn AS x, oy + u * sn + v * cs AS y
        FROM (SELECT *, (id % 7 - 3) * 5e-6 + CASE WHEN id % 11 = 0 THEN 1.8e-4 ELSE 0e0 END AS a,
                     CASE WHEN p_size % 5 <= 1 THEN 'FT' WHEN p_size % 5 = 2 THEN 'TF'
                          WHEN p_size % 5 = 3 THEN 'B' END AS oneway
              FROM frame) f,
             LATERAL (SELECT * FROM (VALUES (0, f.a, -1.6e-4), (1, f.a, -1e-4),
                                            (2, f.a + 2e-5, 1.6e-4)) t(k, u, v)) l""",
    "arterial_point": """
        SELECT 1000000000 + s_suppkey AS id, NULL AS oneway, k,
               -7.106e1 + (s_suppkey // 40000) * 5e-2 + dx AS x,
               4.236e1 + (s_suppkey % 40000) * 4e-4
                   + CASE WHEN s_suppkey % 4 = 1 THEN 3.7e-6 ELSE 2.037e-4 END AS y
        FROM supplier, (VALUES (0, -3e-4), (1, 3.99e-2)) t(k, dx)""",
    "street_point": """
        SELECT id, oneway, k, x, y FROM offset_point
        UNION ALL SELECT id, oneway, k, x, y FROM arterial_point""",
    "piece": """
        SELECT p.id AS oid, p.k AS piece, p.oneway, p.x AS cx, p.y AS cy, q.x AS dx, q.y AS dy
        FROM street_point p JOIN street_point q ON q.id = p.id AND q.k = p.k + 1""",
    "light": """
        SELECT o_orderkey AS id,
               -7.106e1 + (o_custkey // 4000000) * 5e-2 + (o_custkey % 100) * 4e-4
                   + ((o_orderkey * 37) % 41 - 20) * 1e-5 AS x,
               4.236e1 + ((o_custkey // 100) % 40000) * 4e-4 + ((o_orderkey * 53) % 37 - 18) * 1e-5 AS y
        FROM orders""",
    "meeting": """
        SELECT cid, eid, oid, piece, oneway, cx, cy, dx, dy,
               (x2 - x1) * (dy - cy) - (y2 - y1) * (dx - cx) AS det,
               (cx - x1) * (dy - cy) - (cy - y1) * (dx - cx) AS along_edge,
               (cx - x1) * (y2 - y1) - (cy - y1) * (x2 - x1) AS along_street
        FROM edge JOIN piece
          ON least(x1, x2) <= greatest(cx, dx) AND greatest(x1, x2) >= least(cx, dx)
         AND least(y1, y2) <= greatest(cy, dy) AND greatest(y1, y2) >= least(cy, dy)""",
    "hit": f"""
        SELECT cid, eid, oid, piece, oneway,
               {_s9("cx + along_street / det * (dx - cx)")} AS x,
               {_s9("cy + along_street / det * (dy - cy)")} AS y
        FROM meeting
        WHERE det <> 0 AND along_edge / det BETWEEN 0 AND 1 AND along_street / det BETWEEN 0 AND 1""",
    "first_street": "SELECT cid, eid, min(oid) AS oid FROM hit GROUP BY cid, eid",
    "crosswalk_street": "SELECT cid, max(oid) AS oid FROM first_street GROUP BY cid",
    "oneway_flag": """
        SELECT c.cid, bool_or(s.oneway = 'FT') AS oneway
        FROM crosswalk_street c JOIN street_point s ON s.id = c.oid GROUP BY c.cid""",
    "segment": """
        SELECT e.*, f.oid IS NOT NULL AS vehicle, c.oid,
               coalesce(o.oneway, FALSE) AS oneway
        FROM edge e
        LEFT JOIN first_street f ON f.cid = e.cid AND f.eid = e.eid
        LEFT JOIN crosswalk_street c ON c.cid = e.cid
        LEFT JOIN oneway_flag o ON o.cid = e.cid""",
    "crossing": "SELECT DISTINCT cid, oid, x, y FROM hit",
    "pedestrian": """
        SELECT * FROM segment WHERE NOT vehicle
        QUALIFY row_number() OVER (PARTITION BY cid ORDER BY eid) = 1""",
    "center_one": f"""
        SELECT m.cid, m.oid, 'A' AS center_id, TRUE AS oneway, m.x AS sx, m.y AS sy, m.x, m.y,
               p.x1, p.y1, p.x2, p.y2
        FROM (SELECT cid, oid, {_mean9("x")} AS x, {_mean9("y")} AS y
              FROM crossing GROUP BY cid, oid) m
        LEFT JOIN pedestrian p ON p.cid = m.cid
        WHERE m.cid IN (SELECT cid FROM segment WHERE oneway)""",
    "center_two": f"""
        SELECT cid, oid, CASE rn WHEN 1 THEN 'A' ELSE 'B' END AS center_id, FALSE AS oneway,
               sx, sy, x, y, x1, y1, x2, y2
        FROM (SELECT *, row_number() OVER (
                         PARTITION BY cid ORDER BY printf('POINT (%.9f %.9f)', x, y), eid) AS rn
              FROM (SELECT s.*, m.x AS sx, m.y AS sy,
                           {_s9("((s.x1 + s.x2) / 2 + m.x) / 2")} AS x,
                           {_s9("((s.y1 + s.y2) / 2 + m.y) / 2")} AS y
                    FROM segment s
                    JOIN (SELECT cid, {_mean9("x")} AS x, {_mean9("y")} AS y
                          FROM crossing GROUP BY cid) m ON m.cid = s.cid
                    WHERE NOT s.vehicle AND NOT s.oneway))
        WHERE rn <= 2""",
    "start": "SELECT id, x, y FROM street_point WHERE k = 0",
    "way_one": """
        SELECT c.*,
               CASE WHEN near THEN x1 ELSE x2 END AS fx, CASE WHEN near THEN y1 ELSE y2 END AS fy,
               CASE WHEN near THEN x2 ELSE x1 END AS tx, CASE WHEN near THEN y2 ELSE y1 END AS ty
        FROM (SELECT c.*, sqrt((s.x - x1) ** 2 + (s.y - y1) ** 2)
                          < sqrt((s.x - x2) ** 2 + (s.y - y2) ** 2) AS near
              FROM center_one c JOIN start s ON s.id = c.oid) c""",
    "way_two": """
        SELECT c.*, CASE WHEN f1 THEN x1 ELSE x2 END AS fx, CASE WHEN f1 THEN y1 ELSE y2 END AS fy,
                    CASE WHEN t1 THEN x1 ELSE x2 END AS tx, CASE WHEN t1 THEN y1 ELSE y2 END AS ty
        FROM (SELECT *, CASE WHEN x > sx THEN y1 < y2 WHEN x < sx THEN y1 > y2
                             WHEN y > sy THEN x1 > x2 WHEN y < sy THEN x1 < x2 END AS f1,
                        CASE WHEN x > sx THEN y1 > y2 WHEN x < sx THEN y1 < y2
                             WHEN y > sy THEN x1 < x2 WHEN y < sy THEN x1 > x2 END AS t1
              FROM center_two) c""",
    "center": """
        SELECT * EXCLUDE (near) FROM way_one
        UNION ALL BY NAME SELECT * EXCLUDE (f1, t1) FROM way_two""",
    "near_pair": """
        SELECT c.*, l.id AS light_id, l.x AS lx, l.y AS ly,
               radians((c.y + l.y) / 2) AS phi, radians(l.y - c.y) AS dphi,
               radians(l.x - c.x) AS dlam
        FROM center c JOIN light l
          ON l.x BETWEEN c.x - 4e-4 AND c.x + 4e-4 AND l.y BETWEEN c.y - 4e-4 AND c.y + 4e-4""",
    "pair": """
        SELECT * EXCLUDE (w), CAST(2 * 6371000e0 * asin(sqrt(
                   sin(dphi / 2) ** 2
                   + cos(radians(y)) * cos(radians(ly)) * sin(dlam / 2) ** 2)) AS FLOAT) AS dist
        FROM (SELECT *, 1 - (2 / 298.257223563e0 - 1 / 298.257223563e0 ** 2) * sin(phi) ** 2 AS w
              FROM near_pair)
        WHERE sqrt((6378137e0 * (1 - 1 / 298.257223563e0) ** 2 / (w * sqrt(w)) * dphi) ** 2
                   + (6378137e0 / sqrt(w) * cos(phi) * dlam) ** 2) <= 20""",
    "axis": """
        SELECT cid, arg_max(x, t) FILTER (center_id = 'A') AS ax,
               arg_max(y, t) FILTER (center_id = 'A') AS ay,
               arg_max(b_x, printf('POINT (%.9f %.9f)', b_x, b_y)) AS b_x,
               arg_max(b_y, printf('POINT (%.9f %.9f)', b_x, b_y)) AS b_y
        FROM (SELECT *, printf('POINT (%.9f %.9f)', x, y) AS t,
                     CASE WHEN center_id = 'B' THEN x WHEN oneway THEN (x1 + x2) / 2 END AS b_x,
                     CASE WHEN center_id = 'B' THEN y WHEN oneway THEN (y1 + y2) / 2 END AS b_y
              FROM center)
        GROUP BY cid""",
    "sided": """
        SELECT *, CASE WHEN sign(abx * fty - aby * ftx) = sign(abx * cly - aby * clx)
                       THEN 'to' ELSE 'from' END AS side,
               atan2(clx * aby - cly * abx + 0e0, clx * abx + cly * aby + 0e0) AS angle
        FROM (SELECT p.*, b_x - ax AS abx, b_y - ay AS aby, tx - fx AS ftx, ty - fy AS fty,
                     lx - x AS clx, ly - y AS cly
              FROM pair p JOIN axis a ON a.cid = p.cid)""",
    "side_sum": """
        SELECT cid, center_id,
               sum(CASE side WHEN 'to' THEN abs(sin(angle)) / (dist * dist) ELSE 0 END) AS tc,
               sum(CASE side WHEN 'from' THEN abs(sin(angle)) / (dist * dist) ELSE 0 END) AS fc,
               sum(CASE side WHEN 'to' THEN 1.0 / (dist * dist) ELSE 0 END) AS tb,
               sum(CASE side WHEN 'from' THEN 1.0 / (dist * dist) ELSE 0 END) AS fb
        FROM sided GROUP BY cid, center_id""",
    "score": """
        SELECT c.cid, c.center_id, coalesce(tc, 0) AS tc, coalesce(fc, 0) AS fc,
               coalesce(tb, 0) AS tb, coalesce(fb, 0) AS fb
        FROM (SELECT DISTINCT cid, center_id, x, y FROM center) c
        LEFT JOIN side_sum s ON s.cid = c.cid AND s.center_id = c.center_id""",
}

# Built once even where they are read once: folded into their reader they are computed again for each of its rows.
_ONCE = {"frame", "vertex", "direction", "span", "box", "corner", "rect"}


def _reads(body: str) -> list[str]:
    """The tables above that a query reads, as often as it names them."""
    return [w for w in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", body) if w in _CTES]


def _with(query: str) -> str:
    """``query`` with the tables it needs; one that is read more than once is built once."""
    needed, todo = Counter(_reads(query)), _reads(query)
    seen: set[str] = set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            needed.update(_reads(_CTES[name]))
            todo += _reads(_CTES[name])
    parts = [
        f"{name} AS {'MATERIALIZED ' if needed[name] > 1 or name in _ONCE else ''}({body})"
        for name, body in _CTES.items()
        if name in needed
    ]
    return "WITH " + ",\n".join(parts) + "\n" + query


# The five labels.
_LABEL = """
    CASE WHEN abs(fc - tc) <= CASE WHEN tc = 0 OR fc = 0 THEN 0.005e0 ELSE 0.0075e0 END THEN 'no contrast'
         WHEN abs(fc - tc) <= CASE WHEN tc = 0 OR fc = 0 THEN 0.0075e0 ELSE 0.01e0 END
             THEN CASE WHEN fc > tc THEN 'weak positive contrast' ELSE 'weak negative contrast' END
         WHEN fc > tc THEN 'strong positive contrast' ELSE 'strong negative contrast' END"""

_SCORES = f"""
    cid AS crosswalk_id, center_id,
    round(tc, 8) AS to_contrast_heuristic, round(fc, 8) AS from_contrast_heuristic,
    round(tb, 6) AS to_brightness_heuristic, round(fb, 6) AS from_brightness_heuristic,
    {_LABEL} AS contrast_heuristic"""

_CENTER = """
    cid AS crosswalk_id, oid AS street_segment_id, center_id,
    round(sx, 9) AS street_x, round(sy, 9) AS street_y, round(x, 9) AS x, round(y, 9) AS y,
    round(coalesce(x1, 0), 9) AS ped_x1, round(coalesce(y1, 0), 9) AS ped_y1,
    round(coalesce(x2, 0), 9) AS ped_x2, round(coalesce(y2, 0), 9) AS ped_y2"""

_WAY = """
    cid AS crosswalk_id, oid AS street_segment_id, center_id,
    round(coalesce(fx, 0), 9) AS from_x, round(coalesce(fy, 0), 9) AS from_y,
    round(coalesce(tx, 0), 9) AS to_x, round(coalesce(ty, 0), 9) AS to_y"""

_PAIR = """
    cid AS crosswalk_id, oid AS street_segment_id, center_id, light_id AS streetlight_id,
    round(CAST(dist AS DOUBLE), 4) AS dist"""

_LAYERS = """
    SELECT 'crosswalks' AS layer, id AS object_id, CAST(k AS BIGINT) AS pos, {x}, {y} FROM vertex
    UNION ALL SELECT 'street_segments', id, CAST(k AS BIGINT), {x}, {y} FROM street_point
    UNION ALL SELECT 'streetlights', id, CAST(0 AS BIGINT), {x}, {y} FROM light"""

_ALL_PAIRS = """
    SELECT c.cid AS crosswalk_id, c.oid AS street_segment_id, c.center_id,
           coalesce(p.light_id, -1) AS streetlight_id,
           round(coalesce(CAST(p.dist AS DOUBLE), -1), 4) AS streetlight_dist
    FROM center c LEFT JOIN pair p ON p.cid = c.cid AND p.oid = c.oid AND p.center_id = c.center_id"""

_CONTENTS = """
    SELECT f.format, id AS object_id, oneway, geometry
    FROM (SELECT p.id, oneway, 'LINESTRING (' || string_agg(printf('%.9f %.9f', x, y), ', ' ORDER BY k) || ')' AS geometry
          FROM street_point p GROUP BY p.id, oneway) s,
         (VALUES ('csv'), ('parquet')) f(format)"""

_LAYOUTS = """
    SELECT l.layout, s.id AS object_id, CAST(s.k AS BIGINT) AS pos,
           round(floor(s.x * 1e6 + 0.5) / 1e6, 6) AS x, round(floor(s.y * 1e6 + 0.5) / 1e6, 6) AS y,
           s.oneway, s.id % 3 = 0 AS lit, CAST(s.id % 5 AS DOUBLE) / 2 AS width
    FROM street_point s,
         (VALUES ('lines'), ('header'), ('several'), ('pretty'), ('document'), ('folder')) l(layout)
    UNION ALL
    SELECT 'multi', id, CAST(k AS BIGINT), round(floor(x * 1e6 + 0.5) / 1e6, 6), round(floor(y * 1e6 + 0.5) / 1e6, 6),
           oneway, id % 3 = 0, CAST(id % 5 AS DOUBLE) / 2
    FROM street_point"""

# The answer follows from how the layer is built, see ``queries.overlap_and_holes``.
_OVERLAPS = """
    SELECT p_partkey AS crosswalk_id, ring_id, edge_id,
           CASE p_partkey % 4
                WHEN 0 THEN ring_id = 1 AND edge_id IN (1, 2, 4)
                WHEN 1 THEN ring_id = 2 AND edge_id = 1
                WHEN 2 THEN ring_id = 1 AND edge_id IN (1, 2)
                ELSE FALSE END AS is_vehicle_edge,
           CAST(CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS n_points,
           CASE p_partkey % 4 WHEN 0 THEN 4e0 WHEN 1 THEN 4e0 WHEN 2 THEN 8e0 ELSE -1e0 END AS mean_x,
           CASE p_partkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 2e0 WHEN 2 THEN 0e0 ELSE -1e0 END AS mean_y
    FROM part, (VALUES (CAST(1 AS BIGINT)), (2)) r(ring_id),
         (VALUES (CAST(1 AS BIGINT)), (2), (3), (4)) e(edge_id)"""

# As above, see ``queries.overlap_centers``: means weighted by length, and that of two points.
_OVERLAP_CENTERS = """
    SELECT p_partkey AS crosswalk_id, center_x, center_y
    FROM part JOIN (VALUES (0, 2e0, 0e0), (1, (1.5e0 * 1 + 4 * 4) / 5, 4e0 * 4 / 5), (2, 3e0, 0e0), (3, 2e0, 2e0))
        t(kind, center_x, center_y) ON kind = p_partkey % 4"""

_DENSITY = """
    SELECT tract_id, round(area, 1) AS area_m2, round(p_size * 100 / (area / 1e6) / 1e5, 1) AS total_per_10m2,
           round(p_size % 10 * 10 / (area / 1e6) / 1e5, 1) AS seniors_per_10m2
    FROM (SELECT a.id AS tract_id,
                 abs(sum((a.mx - o.mx) * (b.my - o.my) - (b.mx - o.mx) * (a.my - o.my))) / 2 AS area
          FROM metre a JOIN metre b ON b.id = a.id AND b.k = a.k + 1 JOIN metre o ON o.id = a.id AND o.k = 0
          GROUP BY a.id) t
    JOIN part ON p_partkey = tract_id"""



def _corners(shapes: list) -> str:
    """(kind, part, ring, pos, u, v) of parts of rings."""
    rows = [
        f"({kind}, {part}, {ring}, {pos}, {u}, {v})"
        for kind, parts in enumerate(shapes)
        for part, rings in enumerate(parts)
        for ring, points in enumerate(rings)
        for pos, (u, v) in enumerate(points)
    ]
    return f"(VALUES {', '.join(rows)}) s(kind, part, ring, pos, u, v)"


def _placed(shapes: list, layer: str) -> str:
    return f"""
    SELECT '{layer}' AS layer, p_partkey AS object_id, CAST(part AS BIGINT) AS part, CAST(ring AS BIGINT) AS ring,
           CAST(pos AS BIGINT) AS pos, p_partkey % 1000 * 2e-2 + u / 1e3 AS x,
           (p_partkey // 1000) % 2000 * 2e-2 + v / 1e3 AS y
    FROM part JOIN {_corners(shapes)} ON kind = p_partkey % 4"""


_PARTED = f"""
    SELECT f.format, layer, object_id, part, ring, pos, round({_s6("x")}, 6) AS x, round({_s6("y")}, 6) AS y
    FROM ({_placed(PARTED_POLYGONS, "polygons")} UNION ALL {_placed([[[line] for line in lines] for lines in PARTED_LINES], "lines")}),
         (VALUES ('geojson'), ('csv'), ('parquet'), ('wkt'), ('any')) f(format)"""

_PARTED_DENSITY = f"""
    WITH corner AS (
        SELECT *, 6378137e0 * radians(x) AS mx, 6378137e0 * ln(tan(pi() / 4 + radians(y) / 2)) AS my
        FROM ({_placed(PARTED_POLYGONS, "polygons")})),
    ring_area AS (
        SELECT a.object_id, a.part, a.ring,
               abs(sum((a.mx - o.mx) * (b.my - o.my) - (b.mx - o.mx) * (a.my - o.my))) / 2 AS area
        FROM corner a JOIN corner b USING (object_id, part, ring) JOIN corner o USING (object_id, part, ring)
        WHERE b.pos = a.pos + 1 AND o.pos = 0 GROUP BY ALL)
    SELECT object_id AS tract_id, round(km2, 5) AS area_km2, round(p_size * 1000 / km2, 3) AS total_per_km2
    FROM (SELECT object_id, sum(CASE ring WHEN 0 THEN area ELSE -area END) / 1e6 AS km2 FROM ring_area GROUP BY object_id)
    JOIN part ON p_partkey = object_id"""

_N_STREETS = """
    (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier)"""

ORACLE = {
    "geojson_roundtrip": _with(
        _LAYERS.format(x=f"round({_s6('x')}, 6) AS x", y=f"round({_s6('y')}, 6) AS y")
    ),
    "wkt_roundtrip": _with(_LAYERS.format(x="round(x, 9) AS x", y="round(y, 9) AS y")),
    "load_many_preview": f"""
        SELECT name AS table_name, CAST(n AS BIGINT) AS n_rows, CAST(least(n, 10) AS BIGINT) AS n_preview,
               CAST(n AS BIGINT) AS n_parquet, CAST(n AS BIGINT) AS n_csv
        FROM (SELECT 'crosswalks' AS name, count(*) AS n FROM part
              UNION ALL SELECT 'streetlights', count(*) FROM orders
              UNION ALL SELECT 'street_segments', {_N_STREETS})""",
    "min_area_rectangle": _with(
        "SELECT id AS crosswalk_id, CAST(pos AS BIGINT) AS corner, round(x, 9) AS x, round(y, 9) AS y FROM rect"
    ),
    "decompose_edges": _with(
        """SELECT p.id AS crosswalk_id, CAST(1 AS BIGINT) AS ring_id, CAST(p.k + 1 AS BIGINT) AS edge_id,
                  round(p.x, 9) AS x1, round(p.y, 9) AS y1, round(q.x, 9) AS x2, round(q.y, 9) AS y2
           FROM vertex p JOIN vertex q ON q.id = p.id AND q.k = p.k + 1"""
    ),
    "segment_hits": _with(
        """SELECT cid AS crosswalk_id, CAST(eid AS BIGINT) AS edge_id, oid AS street_segment_id,
                  CAST(piece AS BIGINT) AS piece_id, round(x, 9) AS x, round(y, 9) AS y FROM hit"""
    ),
    "classify_edges": _with(
        """SELECT cid AS crosswalk_id, CAST(eid AS BIGINT) AS edge_id, vehicle AS is_vehicle_edge,
                  coalesce(oid, -1) AS street_segment_id, oneway AS is_oneway FROM segment"""
    ),
    "centers_oneway": _with(f"SELECT {_CENTER} FROM center_one"),
    "centers_twoway": _with(f"SELECT {_CENTER} FROM center_two"),
    "crosswalk_centers": _with(f"SELECT {_CENTER}, oneway AS is_oneway FROM center"),
    "direction_oneway": _with(f"SELECT {_WAY} FROM way_one"),
    "direction_twoway": _with(f"SELECT {_WAY} FROM way_two"),
    "lat_long_flip": _with(
        "SELECT id AS object_id, printf('POINT (%.9f %.9f)', y, x) AS geometry_lat_long FROM light"
    ),
    "meters_to_degrees": _with(
        """SELECT id AS object_id,
                  round(greatest((id % 500) / 111320e0,
                                 (id % 500) / (111320e0 * cos(radians(y)))), 12) AS degrees,
                  round(greatest((id % 500) / 111320e0,
                                 (id % 500) / (111320e0 * cos(radians(42.3601e0)))), 12) AS degrees_default
           FROM light"""
    ),
    "lights_within": _with(f"SELECT {_PAIR} FROM pair"),
    "lights_arrays": _with(
        f"SELECT {_PAIR}, round(CAST(dist AS DOUBLE), 4) AS looked_up, CAST(0 AS BIGINT) AS list_part FROM pair"
    ),
    "center_light_pairs": _with(_ALL_PAIRS),
    "explode_lights": _with(f"SELECT {_PAIR}, round(lx, 9) AS x, round(ly, 9) AS y FROM pair"),
    "saved_centers_lights": _with(_ALL_PAIRS),
    "saved_classified_lights": _with(
        f"""SELECT {_PAIR}, side, round(coalesce(angle, -9), 6) AS angle_rad,
                   printf('LINESTRING (%.9f %.9f, %.9f %.9f)', x, y, lx, ly) AS line_geom,
                   printf('POINT (%.9f %.9f)', lx, ly) AS geometry FROM sided"""
    ),
    "saved_streetlights": _with(
        """SELECT id AS object_id, printf('POINT (%.9f %.9f)', x, y) AS geometry,
                  printf('POINT (%.9f %.9f)', y, x) AS geometry_lat_long FROM light"""
    ),
    "csv_parquet_contents": _with(_CONTENTS),
    "geojson_layouts": _with(_LAYOUTS),
    "overlap_and_holes": _OVERLAPS,
    "overlap_centers": _OVERLAP_CENTERS,
    "tract_density": _with(_DENSITY),
    "tract_density_parts": _PARTED_DENSITY,
    "multipart_roundtrip": _PARTED,
    "place_categories": """
        SELECT s_suppkey AS place_id, r_name AS category
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
        UNION ALL SELECT s_suppkey, 'OPEN' FROM supplier WHERE s_suppkey % 3 = 0""",
    "centers_without_lights": _with(
        """SELECT cid AS crosswalk_id, oid AS street_segment_id, center_id FROM center c
           WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.cid = c.cid AND p.oid = c.oid
                                                    AND p.center_id = c.center_id)"""
    ),
    "classify_side": _with(
        f"""SELECT {_PAIR}, side, round(coalesce(angle, -9), 6) AS angle_rad,
                   round(coalesce(abs(sin(angle)), -9), 6) AS abs_sin_angle FROM sided"""
    ),
    "contrast_heuristic": _with(f"SELECT {_SCORES} FROM score"),
    "brightness": _with(
        """SELECT cid AS crosswalk_id, center_id,
                  round(CAST(CAST(fb + tb AS FLOAT) AS DOUBLE), 4) AS light_heuristic FROM score"""
    ),
    "full_contrast": _with(
        f"""SELECT {_SCORES}, round(CAST(CAST(fb + tb AS FLOAT) AS DOUBLE), 4) AS light_heuristic
            FROM score"""
    ),
}
ORACLE["files_contrast"] = ORACLE["full_contrast"]
