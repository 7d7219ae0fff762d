"""Lane centers of crosswalks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslume.functions.geometry import (
    SNAP_DECIMALS,
    midpoint,
    point,
    point_n,
    snap,
    snap_point,
    to_wkt,
)
from crosslume.operators.skew import HOT_ROWS, gathered, split_join


# Coordinates are averaged as whole numbers of the snapping unit: sums are exact in any order, and
# a mean halfway between two units always goes up.
_UNITS = 10**SNAP_DECIMALS


def _units(value: Column) -> Column:
    return F.floor(value * F.lit(float(_UNITS)) + F.lit(0.5))


def _mean(sum_x: Column, sum_y: Column, n: Column) -> Column:
    def half_up(total: Column) -> Column:
        twice = 2 * total + n
        whole = twice - F.pmod(twice, 2 * n)
        return whole / (2 * n) / F.lit(float(_UNITS))

    return point(half_up(sum_x), half_up(sum_y))


def overlaps(hits: DataFrame) -> DataFrame:
    """(crosswalk_id, street_segment_id, length, length_x, length_y) where a street runs along edges.

    Stretches of an edge that several pieces of the street cover count once. ``length_x`` and ``length_y`` are the
    middles of the stretches, weighted by their length. The lists hold one street's pieces on one edge.
    """
    where = ["crosswalk_id", "street_segment_id", "ring_id", "edge_id"]
    spot = F.struct("x", "y")
    # Points of one line, ordered by x and then y, are ordered along the line.
    each = hits.where("stretch").groupBy(*where, "piece_id").agg(F.min(spot).alias("a"), F.max(spot).alias("b"))
    edges = each.groupBy(*where).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))

    def closed(so_far: Column) -> Column:
        """The sums with the open stretch added."""
        a, b = so_far["a"], so_far["b"]
        length = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        return F.struct(
            (so_far["length"] + length).alias("length"),
            (so_far["sum_x"] + length * (a["x"] + b["x"]) / 2).alias("sum_x"),
            (so_far["sum_y"] + length * (a["y"] + b["y"]) / 2).alias("sum_y"),
        )

    def opened(span: Column, sums: Column) -> Column:
        return F.struct(span["a"].alias("a"), span["b"].alias("b"), *(sums[c].alias(c) for c in ("length", "sum_x", "sum_y")))

    def add(so_far: Column, span: Column) -> Column:
        longer = F.struct(
            so_far["a"].alias("a"),
            F.greatest(so_far["b"], span["b"]).alias("b"),
            *(so_far[c].alias(c) for c in ("length", "sum_x", "sum_y")),
        )
        return F.when(span["a"] <= so_far["b"], longer).otherwise(opened(span, closed(so_far)))

    none = F.struct(*(F.lit(0.0).alias(c) for c in ("length", "sum_x", "sum_y")))
    first, rest = F.get("spans", F.lit(0)), F.slice("spans", 2, F.size("spans"))
    total = edges.select(*where[:2], F.aggregate(rest, opened(first, none), add, closed).alias("t"))
    return total.groupBy(*where[:2]).agg(
        F.sum("t.length").alias("length"), F.sum("t.sum_x").alias("length_x"), F.sum("t.sum_y").alias("length_y")
    )


def crossings(hits: DataFrame) -> DataFrame:
    """One row per (crosswalk, street): the number and sums of its distinct intersection points.

    A street through a corner hits two edges in one point, hence the set. Where it runs along an edge, the
    two ends of the whole stretch count: a vertex inside is the end of two adjoining pieces and goes. Only streets that do
    so anywhere on a crosswalk are looked at piece by piece; whether there are any is found out at once, by a job.
    The set is no larger than the vertices of one street and one crosswalk allow.
    """

    def total(axis: str) -> Column:
        return F.aggregate("points", F.lit(0).cast("long"), lambda s, p: s + p[axis])

    units = F.struct(_units(F.col("x")).alias("x"), _units(F.col("y")).alias("y"))
    key = ["crosswalk_id", "street_segment_id"]
    along = F.col("stretch").isNull() | F.col("stretch")

    def gathered_points(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy(*key).agg(F.collect_set(units).alias("points"), F.min("street_start").alias("street_start"), *more)

    if hits.where(along).isEmpty():
        every = gathered_points(hits)
    else:
        across = gathered_points(hits, F.max(along).alias("along")).where("NOT along").drop("along")
        streets = hits.where(along).select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key))
        every = across.unionByName(gathered_points(_ends_of_stretches(hits.join(streets, same, "left_semi"))))
    return every.select(
        *key,
        "street_start",
        F.size("points").cast("long").alias("n"),
        total("x").alias("sum_x"),
        total("y").alias("sum_y"),
    )


def _ends_of_stretches(hits: DataFrame) -> DataFrame:
    """The points of ``hits`` that are not vertices inside a stretch."""
    where = ["crosswalk_id", "street_segment_id", "ring_id", "edge_id", "x", "y"]
    # Each piece counts once at a point; an end of a stretch is met by an odd number of its pieces.
    pieces = hits.groupBy(*where, "piece_id").agg(
        F.max("stretch").alias("stretch"), F.min("street_start").alias("street_start")
    )
    ends = pieces.groupBy(*where).agg(
        F.sum(F.col("stretch").cast("int")).alias("n"),
        F.min("street_start").alias("street_start"),
    )
    return ends.where("n % 2 = 1 OR n = 0")


def oneway_centers(
    edges: DataFrame, hits: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Center 'A' of a one-way crosswalk on every street it meets: the centroid of what they have in common.

    That is the mean of the points, or where the street runs along edges, that of these stretches alone. The pedestrian edge is the lowest-numbered edge no street hits, NULL when there is none.
    """
    return _oneway_centers(edges, hits, gathered(hits, ["crosswalk_id"], hot_rows), hot_rows)


def _oneway_centers(edges: DataFrame, hits: DataFrame, whole: DataFrame, hot_rows: int) -> DataFrame:
    """As ``oneway_centers``; ``whole`` holds the ``hits`` of a crosswalk together, or is ``hits`` where one has too many."""
    pedestrian = F.when(~F.col("is_vehicle_edge"), F.struct("ring_id", "edge_id", "geometry"))
    crosswalks = (
        edges.where("is_oneway")
        .groupBy("crosswalk_id")
        .agg(F.min(pedestrian)["geometry"].alias("ped_edge_geom"))
    )
    common = crossings(whole)
    if hits.where("stretch").isEmpty():
        none = F.lit(None).cast("double")
        common = common.withColumns({c: none for c in ("length", "length_x", "length_y")})
    else:
        common = common.join(overlaps(whole), ["crosswalk_id", "street_segment_id"], "left")
    # A crosswalk may meet very many streets: its rows are split, its single summary row copied.
    met = split_join(
        common,
        crosswalks,
        ["crosswalk_id"],
        split_left=["street_segment_id"] if whole is hits else (),
        left_rows=hits,  # one or more for each row
        hot_rows=hot_rows,
    )
    stretch = point(*(snap(F.col(f"length_{axis}") / F.col("length")) for axis in "xy"))
    center = F.when(F.col("length") > 0, stretch).otherwise(_mean(F.col("sum_x"), F.col("sum_y"), F.col("n")))
    return met.select(
        "crosswalk_id",
        "street_segment_id",
        "ped_edge_geom",
        center.alias("street_center_point"),
        center.alias("geometry"),
        F.lit("A").alias("center_id"),
        F.lit(True).alias("is_oneway"),
        "street_start",
    )


def twoway_centers(
    edges: DataFrame, hits: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Centers 'A' and 'B' of a two-way crosswalk.

    Each lies halfway between the middle of an edge no street hits and the mean of all intersection
    points; the first two in the order of their text are kept. The window sees one ring's edges.
    """
    return _twoway_centers(edges, gathered(hits, ["crosswalk_id"], hot_rows))


def _twoway_centers(edges: DataFrame, whole: DataFrame) -> DataFrame:
    means = (
        crossings(whole)
        .groupBy("crosswalk_id")
        .agg(F.sum("sum_x").alias("sum_x"), F.sum("sum_y").alias("sum_y"), F.sum("n").alias("n"))
        .select(
            "crosswalk_id",
            _mean(F.col("sum_x"), F.col("sum_y"), F.col("n")).alias("street_center_point"),
        )
    )
    edge_middle = midpoint(point_n(F.col("geometry"), 1), point_n(F.col("geometry"), 2))
    order = Window.partitionBy("crosswalk_id").orderBy("text", "ring_id", "edge_id")
    return (
        edges.where(~F.col("is_vehicle_edge") & ~F.col("is_oneway"))
        .withColumn("edge_middle", edge_middle)
        .join(means, "crosswalk_id")
        .withColumn(
            "center", snap_point(midpoint(F.col("edge_middle"), F.col("street_center_point")))
        )
        .withColumn("text", to_wkt(F.col("center")))
        .withColumn("rn", F.row_number().over(order))
        .where("rn <= 2")
        .select(
            "crosswalk_id",
            "street_segment_id",
            F.col("geometry").alias("ped_edge_geom"),
            "street_center_point",
            F.col("center").alias("geometry"),
            F.when(F.col("rn") == 1, "A").otherwise("B").alias("center_id"),
            F.lit(False).alias("is_oneway"),
            F.lit(None).cast("struct<x:double,y:double>").alias("street_start"),
        )
    )


def find_crosswalk_centers(
    edges: DataFrame, hits: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One-way and two-way centers together."""
    whole = gathered(hits, ["crosswalk_id"], hot_rows)
    return _oneway_centers(edges, hits, whole, hot_rows).unionByName(_twoway_centers(edges, whole))
