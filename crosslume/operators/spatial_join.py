"""The two spatial joins, both as equi-joins on grid cells with an exact test afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslume.functions.geodesy import (
    LEAST_CURVE_M,
    NEAR_M,
    SPHERE_RADIUS_M,
    curvature_24,
    ecef_axes,
    geodesic_distance,
    geodesic_from_chord,
    sphere_distance,
    vertical,
)
from crosslume.functions.geometry import (
    common_points,
    kind_of,
    parts_of,
    pieces_of,
    point,
    segment_turns,
    segments_apart,
    snap,
)
from crosslume.operators.skew import HOT_ROWS, split_join
from crosslume.sources.staging import stage

CELL_DEGREES = 0.001
# Pairs a cell may hold before it is cut into smaller ones.
CELL_PAIRS = 4096
# What tells one center row from another.
CENTER_KEY = ("crosswalk_id", "center_id", "street_segment_id")


def _with_cells(
    df: DataFrame,
    ends: Sequence[str],
    size: Column,
    names: Sequence[str] = ("gx", "gy"),
    within: Sequence[str] | None = None,
) -> DataFrame:
    """One row per grid cell a segment passes through, by number in ``names``: O(length), not O(area).

    ``ends`` names the columns x1, y1, x2, y2. Columns of cells are walked first, and the segment's
    y range inside each gives its cells. Ranges are padded so that rounding cannot lose a cell.
    ``within`` names coarser cells that rows are in already, and have ``parts`` cells of this size on a side.
    """
    x1, y1, x2, y2 = (F.col(n) for n in ends)
    pad = size * 1e-4

    def cells(low: Column, high: Column, axis: int) -> Column:
        first, last = F.floor((low - pad) / size), F.floor((high + pad) / size)
        if within is None:
            # Outer, as Spark would compute the array again to filter out empty ones; none is.
            return F.explode_outer(F.sequence(first, last))
        first = F.greatest(first, F.col(within[axis]) * F.col("parts"))
        last = F.least(last, F.col(within[axis]) * F.col("parts") + F.col("parts") - 1)
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    bounded = df.withColumns(
        {
            "_x0": F.least(x1, x2),
            "_x1": F.greatest(x1, x2),
            "_y0": F.least(y1, y2),
            "_y1": F.greatest(y1, y2),
        }
    )
    x0, xn, y0, yn = (F.col(n) for n in ("_x0", "_x1", "_y0", "_y1"))
    # Within a column the segment runs between its two clipped ends. A segment no wider than a
    # cell spans two columns at most, where its whole y range will do.
    slope = F.when(xn - x0 > size, (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0)))

    def y_at(x: Column) -> Column:
        inside = F.least(F.greatest(x, x0), xn)
        return F.least(F.greatest(y1 + (inside - x1) * F.col("_slope"), y0), yn)

    gx, gy = names
    columns = (
        bounded.withColumn("_slope", slope)
        .withColumn(gx, cells(x0, xn, 0))
        .withColumns(
            {"_ya": y_at(F.col(gx) * size - pad), "_yb": y_at((F.col(gx) + 1) * size + pad)}
        )
    )
    wide = F.col("_slope").isNotNull()
    low = F.when(wide, F.least("_ya", "_yb")).otherwise(y0)
    high = F.when(wide, F.greatest("_ya", "_yb")).otherwise(yn)
    return columns.withColumn(gy, cells(low, high, 1)).select(*df.columns, gx, gy)


def _dense_cells(left: DataFrame, right: DataFrame, cell: float, pairs: int, hot_rows: int) -> DataFrame:
    """(gx, gy, parts, hot) of cells with more than ``pairs`` pairs to test, or ``hot`` with rows of one side.

    The former is cut into ``parts`` x ``parts`` smaller ones, so many that about ``pairs`` are left in each, but none
    smaller than the segments in it are on average: long ones would only be repeated. ``parts`` is a
    power of two, so that smaller cells fit into the larger ones exactly.
    """

    def counted(df: DataFrame, ends: str, name: str) -> DataFrame:
        (x1, y1), (x2, y2) = ((F.col(f"{end}x"), F.col(f"{end}y")) for end in ends)
        extent = F.least(F.greatest(F.abs(x1 - x2), F.abs(y1 - y2)), F.lit(cell))
        return df.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias(name), F.sum(extent).alias(f"{name}_extent"))

    # Cells are many times the rows they come from; Spark takes them for fewer and would send them through the driver.
    both = counted(left, "ab", "l").join(counted(right, "cd", "r").hint("merge"), ["gx", "gy"])
    tests = F.col("l") * F.col("r")
    mean = (F.col("l_extent") + F.col("r_extent")) / (F.col("l") + F.col("r"))
    wanted = F.ceil(F.log2(tests / F.lit(float(pairs))) / 2)
    finest = F.floor(F.log2(F.lit(cell) / F.greatest(mean, F.lit(cell / (1 << 20)))))
    parts = F.pow(F.lit(2.0), F.greatest(F.least(wanted, finest), F.lit(0))).cast("long")
    parts = F.when(tests > pairs, parts).otherwise(F.lit(1).cast("long"))
    hot = F.greatest("l", "r") > hot_rows
    return both.select("gx", "gy", parts.alias("parts"), hot.alias("hot")).where("parts > 1 OR hot")


def _real(value: Column) -> Column:
    """A coordinate that is not NULL as a column of that kind, which spares the generated code its checks."""
    return F.coalesce(value, F.lit(0.0))


def _known(p: Column, q: Column) -> Column:
    """Whether both ends have coordinates; pieces that lack one meet nothing."""
    return p["x"].isNotNull() & p["y"].isNotNull() & q["x"].isNotNull() & q["y"].isNotNull()


def _vertex(line: str, index: int) -> Column:
    return F.get(line, F.lit(index))


def _end_columns(p: Column, q: Column, names: str) -> list[Column]:
    return [
        _real(end[axis]).alias(f"{name}{axis}")
        for name, end in zip(names, (p, q), strict=True)
        for axis in "xy"
    ]


class _Bound:
    """A DataFrame that takes intermediate values as columns."""

    def __init__(self, df: DataFrame):
        self.df = df

    def bind(self, values: dict[str, Column]) -> dict[str, Column]:
        self.df = self.df.withColumns({f"_{name}": value for name, value in values.items()})
        return {name: F.col(f"_{name}") for name in values}


def segment_candidates(
    edges: DataFrame,
    streets: DataFrame,
    cell: float = CELL_DEGREES,
    *,
    hot_rows: int = HOT_ROWS,
    cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """Pairs of an edge and a street piece that share a cell, once for each shared cell (sx, sy of edge ``size``)."""
    left = edges.where((F.size("geometry") == 2) & _known(_vertex("geometry", 0), _vertex("geometry", 1))).select(
        "crosswalk_id", "ring_id", "edge_id", *_end_columns(_vertex("geometry", 0), _vertex("geometry", 1), "ab")
    )
    kind = kind_of(streets.schema["geometry"].dataType) or "line"
    first_line = F.col("geometry") if kind == "line" else F.get(parts_of(F.col("geometry"), kind, "lines"), F.lit(0))
    pieces = (
        streets.select(
            F.col("OBJECTID").cast("long").alias("street_segment_id"),
            F.col("ONEWAY").alias("oneway"),
            F.get(first_line, F.lit(0)).alias("street_start"),
            F.posexplode_outer(pieces_of(F.col("geometry"), kind)).alias("piece_id", "piece"),
        )
        .where(F.col("piece_id").isNotNull() & _known(F.col("piece.p"), F.col("piece.q")))
        .select(
            "street_segment_id",
            "oneway",
            "street_start",
            "piece_id",
            *_end_columns(F.col("piece.p"), F.col("piece.q"), "cd"),
        )
    )
    ends = {"l": ("ax", "ay", "bx", "by"), "r": ("cx", "cy", "dx", "dy")}
    left = _with_cells(left, ends["l"], F.lit(cell))
    right = _with_cells(pieces, ends["r"], F.lit(cell))
    # Staged, so that the sides of the join below are not shuffled for the sake of a list that is short or empty.
    dense = stage(_dense_cells(left, right, cell, cell_pairs, hot_rows), "cells")
    found = {row["hot"] for row in dense.select("hot").distinct().collect()}

    def finer(df: DataFrame, names: Sequence[str]) -> DataFrame:
        """Rows by cell and ``cut``, the number of the smaller cell inside it."""
        if not found:
            same = {"parts": F.lit(1).cast("long"), "sx": F.col("gx"), "sy": F.col("gy"), "cut": F.lit(0).cast("long")}
            return df.withColumns(same)
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        known = df.join(dense.select("gx", "gy", "parts"), ["gx", "gy"], "left").withColumn("parts", parts)
        cut = _with_cells(known, names, F.lit(cell) / F.col("parts"), ("sx", "sy"), ("gx", "gy"))
        inside = [F.col(f"s{axis}") - F.col(f"g{axis}") * F.col("parts") for axis in "xy"]
        return cut.withColumn("cut", inside[0] * F.col("parts") + inside[1])

    # A cell that is not hot has no hot cut.
    many = True in found
    joined = split_join(
        finer(left, ends["l"]),
        finer(right, ends["r"]).drop("parts", "sx", "sy"),
        ["gx", "gy", "cut"],
        split_left=["crosswalk_id", "ring_id", "edge_id"] if many else (),
        split_right=["street_segment_id", "piece_id"] if many else (),
        hot_rows=hot_rows,
        hint="merge",
    )
    return joined.withColumn("size", F.lit(cell) / F.col("parts")).drop("gx", "gy", "cut", "parts")


def segment_hits(
    edges: DataFrame,
    streets: DataFrame,
    cell: float = CELL_DEGREES,
    *,
    hot_rows: int = HOT_ROWS,
    cell_pairs: int = CELL_PAIRS,
) -> DataFrame:
    """Intersections of crosswalk edges with street lines.

    Both sides are cut into grid cells, crowded cells into smaller ones, and joined on the cell. Of a pair that
    shares several cells, a common point is kept only in its own cell, which both segments pass through, so
    none is missed and none comes twice. The street's ``ONEWAY`` code and first vertex travel along: no
    later step has to join the streets again. Pieces are numbered on through the parts of a street; pieces and
    edges with a NULL vertex meet nothing.

    Returns crosswalk_id, ring_id, edge_id, street_segment_id, piece_id, oneway, street_start, stretch, x, y;
    two rows, with ``stretch`` TRUE, where an edge and a street piece share more than a point.
    """
    candidates = segment_candidates(edges, streets, cell, hot_rows=hot_rows, cell_pairs=cell_pairs)
    ends = [{axis: F.col(f"{name}{axis}") for axis in "xy"} for name in "abcd"]
    joined = _Bound(candidates)
    turns = joined.bind(segment_turns(*ends))
    joined.df = joined.df.where(~segments_apart(turns))
    points = common_points(*ends, turns, joined.bind)
    # The points are exploded before they are filtered: a filter on the array would put its whole
    # expression into the join, and methods of that size are never compiled by the JIT.
    spot = F.col("spot")
    return (
        joined.df.withColumn("_points", points)
        .withColumn("_many", F.size("_points") > 1)
        .withColumn("spot", F.explode_outer("_points"))
        .where(F.floor(spot["x"] / F.col("size")) == F.col("sx"))
        .where(F.floor(spot["y"] / F.col("size")) == F.col("sy"))
        .select(
            "crosswalk_id",
            "ring_id",
            "edge_id",
            "street_segment_id",
            "piece_id",
            "oneway",
            "street_start",
            F.col("_many").alias("stretch"),
            snap(spot["x"]).alias("x"),
            snap(spot["y"]).alias("y"),
        )
    )


def lights_within(
    centers: DataFrame,
    lights: DataFrame,
    radius_m: float,
    sphere_radius_m: float = SPHERE_RADIUS_M,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All (center, light) pairs at most ``radius_m`` apart on the WGS84 spheroid.

    Points become earth-centred x, y, z and fall into cubes as wide as a ball of the radius: a light into one, a center
    into those its ball reaches that the ground runs through (at most eight). A chord is never longer than the
    geodesic, so no pair is lost, each comes once, and poles and the antimeridian need no care. Both inputs are
    staged here, and bins are counted before centers are copied. Any radius
    will do; beyond ``NEAR_M`` the geodesic is found by iteration.

    Returns the columns of ``centers`` plus streetlight_id, light (point) and dist, the great-circle
    distance on a sphere as a 32-bit float.
    """
    if not 0 < radius_m < float("inf"):
        raise ValueError(f"radius_m must be a positive number, got {radius_m}")
    reach = float(radius_m) * (1 + 1e-9) + 1e-6
    # A little wider than a ball, which therefore reaches no more than two bins of an axis, however they are rounded.
    edge = 2.0 * reach * (1 + 1e-9) + 1e-5
    axes = ("x", "y", "z")

    def bin_of(value: Column) -> Column:
        # Never NULL, or Spark would compute every bin once more in a filter of its own.
        return F.coalesce(F.floor(value / edge), F.lit(0))

    def lon_lat(prefix: str) -> dict[str, Column]:
        return {"x": F.col(f"{prefix}lon"), "y": F.col(f"{prefix}lat")}

    def located(df: DataFrame, prefix: str) -> DataFrame:
        """Longitude, latitude and x, y, z of the points, as plain columns."""
        placed = df.where(F.col("geometry.x").isNotNull() & F.col("geometry.y").isNotNull())
        placed = placed.withColumns(
            {f"{prefix}lon": _real(F.col("geometry.x")), f"{prefix}lat": _real(F.col("geometry.y"))}
        )
        xyz = ecef_axes(lon_lat(prefix))
        return placed.withColumns({f"{prefix}{a}": _real(xyz[a]) for a in axes})

    steps = F.array(
        *[
            F.struct(*[F.lit(step).cast("long").alias(axis) for axis, step in zip(axes, corner)])
            for corner in product((0, 1), repeat=3)
        ]
    )
    keys = ["_bx", "_by", "_bz"]

    def spread(df: DataFrame) -> DataFrame:
        """Rows go to the bin of the lowest corner around their ball and the seven next to it."""
        moved = df.withColumn("_step", F.explode(steps))
        low = {a: bin_of(F.col(f"_c{a}") - reach) for a in axes}
        return moved.withColumns({f"_b{a}": low[a] + F.col("_step")[a] for a in axes}).drop("_step")

    def reached(moved: DataFrame) -> DataFrame:
        """Bins that the ball around a center touches, and the ground within that ball."""
        away = {a: F.col(f"_c{a}") - F.col(f"_b{a}") * edge for a in axes}  # from a bin's low corner
        outside = {a: F.greatest(-away[a], away[a] - edge, F.lit(0.0)) for a in axes}
        # The ground is the plane across the vertical, but for what the earth bends over two edges and a diagonal.
        up = {a: F.col(f"_u{a}") for a in axes}
        height = sum((up[a] * (edge / 2 - away[a]) for a in "yz"), up["x"] * (edge / 2 - away["x"]))
        half = sum((F.abs(up[a]) for a in "yz"), F.abs(up["x"])) * (edge / 2)
        bend = (4.0 * edge) ** 2 / LEAST_CURVE_M + 1e-6
        square = sum((outside[a] * outside[a] for a in "yz"), outside["x"] * outside["x"])
        return moved.where(square <= reach * reach * (1 + 1e-9) + 1e-6).where(F.abs(height) <= half + bend)

    near = located(stage(centers, "near"), "_c").withColumn("_k24", _real(curvature_24(lon_lat("_c"))))
    near = near.withColumns({f"_u{a}": _real(v) for a, v in vertical(lon_lat("_c")).items()})
    spots = stage(lights.select(F.col("OBJECTID").cast("long").alias("streetlight_id"), "geometry"), "spots")
    placed = located(spots, "_l").drop("geometry")
    placed = placed.withColumns({f"_b{a}": bin_of(F.col(f"_l{a}")) for a in axes})
    joined = split_join(
        reached(spread(near)).drop(*(f"_u{a}" for a in axes)),
        placed,
        keys,
        split_left=[c for c in CENTER_KEY if c in centers.columns] or centers.columns,
        split_right=["streetlight_id"],
        hot_rows=hot_rows,
        hint="merge",
    )
    dx, dy, dz = (F.col(f"_c{a}") - F.col(f"_l{a}") for a in axes)
    length = geodesic_from_chord(F.col("_chord"), F.col("_k24"))
    if radius_m > NEAR_M:
        far = geodesic_distance(lon_lat("_c"), lon_lat("_l"))
        length = F.when(F.col("_chord") > NEAR_M / 2, far).otherwise(length)
    return (
        joined.withColumn("_chord", F.sqrt(dx * dx + dy * dy + dz * dz))
        .where(F.col("_chord") <= reach)
        .where(length <= float(radius_m))
        .select(
            *centers.columns,
            "streetlight_id",
            point(F.col("_llon"), F.col("_llat")).alias("light"),
            sphere_distance(lon_lat("_c"), lon_lat("_l"), sphere_radius_m)
            .cast("float")
            .alias("dist"),
        )
    )
