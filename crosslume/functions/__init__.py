from crosslume.functions.geodesy import (
    ecef,
    flip_lat_long,
    geodesic_from_chord,
    meters_to_degrees,
    sphere_distance,
)
from crosslume.functions.geometry import (
    from_wkt,
    min_area_rectangle,
    planar_distance,
    point,
    ring_edges,
    snap,
    to_wkt,
)

__all__ = [
    "ecef",
    "flip_lat_long",
    "from_wkt",
    "geodesic_from_chord",
    "meters_to_degrees",
    "min_area_rectangle",
    "planar_distance",
    "point",
    "ring_edges",
    "snap",
    "sphere_distance",
    "to_wkt",
]
