"""Direction of travel at a center, as from and to points on its pedestrian edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslume.functions.geometry import planar_distance, point_n


def _ends() -> tuple[Column, Column]:
    edge = F.col("ped_edge_geom")
    return point_n(edge, 1), point_n(edge, 2)


def _oneway() -> tuple[Column, Column]:
    """The end nearer to the street's first vertex comes first; on a tie the second end does."""
    p1, p2 = _ends()
    start = F.col("street_start")
    nearer = planar_distance(start, p1) < planar_distance(start, p2)
    known = start.isNotNull()
    return (
        F.when(known, F.when(nearer, p1).otherwise(p2)),
        F.when(known, F.when(nearer, p2).otherwise(p1)),
    )


def _twoway() -> tuple[Column, Column]:
    """Traffic keeps right: the side of the street the center lies on gives the direction.

    East of the street it runs north, west of it south, else north of it west and south of it east.
    Ends on one level both give the second end; a center on the street point gives NULL.
    """
    p1, p2 = _ends()
    center, street = F.col("geometry"), F.col("street_center_point")

    def pick(first: Column) -> Column:
        return F.when(first, p1).otherwise(p2)

    def choose(up: Column, down: Column, right: Column, left: Column) -> Column:
        return (
            F.when(center["x"] > street["x"], pick(up))
            .when(center["x"] < street["x"], pick(down))
            .when(center["y"] > street["y"], pick(left))
            .when(center["y"] < street["y"], pick(right))
        )

    low, high = p1["y"] < p2["y"], p1["y"] > p2["y"]
    west, east = p1["x"] < p2["x"], p1["x"] > p2["x"]
    # Arguments: what p1 must be to come first when traffic runs north, south, east and west.
    return choose(low, high, west, east), choose(high, low, east, west)


def vehicle_direction(centers: DataFrame) -> DataFrame:
    """Set from_coord and to_coord of every center."""
    one, two = _oneway(), _twoway()
    return centers.withColumns(
        {
            "from_coord": F.when(F.col("is_oneway"), one[0]).otherwise(two[0]),
            "to_coord": F.when(F.col("is_oneway"), one[1]).otherwise(two[1]),
        }
    )


def oneway_direction(centers: DataFrame) -> DataFrame:
    """Direction at the one-way centers only."""
    return vehicle_direction(centers.where("is_oneway"))


def twoway_direction(centers: DataFrame) -> DataFrame:
    """Direction at the two-way centers only."""
    return vehicle_direction(centers.where(~F.col("is_oneway")))
