from crosslume.operators.centers import find_crosswalk_centers, oneway_centers, twoway_centers
from crosslume.operators.crosswalks import (
    check_unique,
    classify_edges,
    decompose_edges,
    simplify_to_rectangle,
)
from crosslume.operators.direction import oneway_direction, twoway_direction, vehicle_direction
from crosslume.operators.lighting import (
    brightness,
    center_light_pairs,
    classify_sides,
    contrast_heuristics,
    crosswalk_axes,
    explode_lights,
    light_lists,
    lookup_distance,
    with_axes,
    with_lat_long,
)
from crosslume.operators.places import place_categories, population_density
from crosslume.operators.skew import hot_keys, key_counts, split_join
from crosslume.operators.spatial_join import lights_within, segment_hits

__all__ = [
    "brightness",
    "center_light_pairs",
    "check_unique",
    "classify_edges",
    "classify_sides",
    "contrast_heuristics",
    "crosswalk_axes",
    "decompose_edges",
    "explode_lights",
    "find_crosswalk_centers",
    "hot_keys",
    "key_counts",
    "light_lists",
    "lights_within",
    "lookup_distance",
    "oneway_centers",
    "oneway_direction",
    "place_categories",
    "population_density",
    "segment_hits",
    "simplify_to_rectangle",
    "split_join",
    "twoway_centers",
    "twoway_direction",
    "vehicle_direction",
    "with_axes",
    "with_lat_long",
]
