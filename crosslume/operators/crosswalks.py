"""From crosswalk polygons to classified edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslume.functions.geometry import TEXT_DECIMALS, kind_of, min_area_rectangle, ring_edges, vertex_lists

# Fixed value: the code of a one-way street.
ONEWAY_CODES = ("FT",)


def check_unique(df: DataFrame, column: str = "OBJECTID", name: str = "table") -> DataFrame:
    """Return ``df``, or raise ``ValueError`` when an id occurs twice."""
    twice = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1)
    found = twice.collect()
    if found:
        raise ValueError(f"{name}: {column} {found[0][0]!r} occurs {found[0][1]} times")
    return df


def simplify_to_rectangle(crosswalks: DataFrame, decimals: int = TEXT_DECIMALS) -> DataFrame:
    """Replace every geometry, with all its parts, by its oriented rectangle of least area, a polygon."""
    return crosswalks.withColumn("geometry", min_area_rectangle(_rings(crosswalks), decimals))


def _rings(crosswalks: DataFrame) -> Column:
    return vertex_lists(F.col("geometry"), kind_of(crosswalks.schema["geometry"].dataType) or "polygon")


def decompose_edges(crosswalks: DataFrame) -> DataFrame:
    """One row per polygon edge: crosswalk_id, ring_id, edge_id (from 1 in each ring), geometry.

    Rings are numbered on through the parts of a geometry.
    """
    # Outer explodes, as Spark would compute an inner one's array again to filter out empty ones.
    rings = crosswalks.select(
        F.col("OBJECTID").cast("long").alias("crosswalk_id"),
        F.posexplode_outer(_rings(crosswalks)).alias("ring", "points"),
    )
    edges = rings.select(
        "crosswalk_id",
        (F.col("ring") + 1).cast("long").alias("ring_id"),
        F.posexplode_outer(ring_edges(F.col("points"))).alias("pos", "edge"),
    )
    return edges.where(F.col("pos").isNotNull()).select(
        "crosswalk_id",
        "ring_id",
        (F.col("pos") + 1).cast("long").alias("edge_id"),
        F.array("edge.p", "edge.q").alias("geometry"),
    )


def classify_edges(
    edges: DataFrame, hits: DataFrame, oneway_codes: Sequence[str] = ONEWAY_CODES
) -> DataFrame:
    """Add is_vehicle_edge, street_segment_id and is_oneway.

    An edge hit by any street is a vehicle edge. The street of a crosswalk is the highest of its
    edges' lowest street ids, and the crosswalk is one-way when that street's code says so; both are
    the same on all its edges. ``hits`` is reduced to one row per crosswalk before it meets the
    edges, so the lists below are no longer than its rings.
    """
    per_edge = hits.groupBy("crosswalk_id", "ring_id", "edge_id").agg(
        F.min(F.struct("street_segment_id", "oneway")).alias("street")
    )
    per_crosswalk = per_edge.groupBy("crosswalk_id").agg(
        F.max("street").alias("street"), F.collect_set(F.struct("ring_id", "edge_id")).alias("vehicle_edges")
    )
    return edges.join(per_crosswalk, "crosswalk_id", "left").select(
        *edges.columns,
        F.coalesce(
            F.array_contains("vehicle_edges", F.struct("ring_id", "edge_id")), F.lit(False)
        ).alias("is_vehicle_edge"),
        F.col("street.street_segment_id").alias("street_segment_id"),
        F.coalesce(F.col("street.oneway").isin(*oneway_codes), F.lit(False)).alias("is_oneway"),
    )
