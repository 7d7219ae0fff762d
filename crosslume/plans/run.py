"""The whole chain from three spatial tables to contrast and brightness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from crosslume.functions.geodesy import SPHERE_RADIUS_M
from crosslume.operators.centers import find_crosswalk_centers
from crosslume.operators.crosswalks import (
    ONEWAY_CODES,
    TEXT_DECIMALS,
    check_unique,
    classify_edges,
    decompose_edges,
    simplify_to_rectangle,
)
from crosslume.operators.direction import vehicle_direction
from crosslume.operators.lighting import (
    SIDE_COLUMNS,
    brightness,
    center_light_pairs,
    classify_sides,
    contrast_heuristics,
    with_axes,
    with_lat_long,
)
from crosslume.operators.skew import gathered
from crosslume.operators.spatial_join import CELL_DEGREES, lights_within, segment_hits
from crosslume.sources.publication import publish
from crosslume.sources.sinks import geometry_as_wkt, save_csv, save_parquet
from crosslume.sources.staging import stage
from crosslume.sources.tables import read_source

# Search radius in metres and contrast threshold.
RADIUS_M = 20.0
THRESHOLD = 0.01


@dataclass(frozen=True)
class Results:
    """Tables of one run."""

    crosswalk_segments: DataFrame
    crosswalk_centers: DataFrame
    center_light_pairs: DataFrame
    crosswalk_centers_lights: DataFrame
    classified_streetlights: DataFrame
    crosswalk_centers_contrast: DataFrame
    streetlights: DataFrame


def segments_and_hits(
    crosswalks: DataFrame,
    streets: DataFrame,
    *,
    decimals: int = TEXT_DECIMALS,
    cell: float = CELL_DEGREES,
    oneway_codes: Sequence[str] = ONEWAY_CODES,
) -> tuple[DataFrame, DataFrame]:
    """Classified edges and street hits, both written once and read many times."""
    edges = stage(decompose_edges(simplify_to_rectangle(crosswalks, decimals)), "edges")
    hits = stage(segment_hits(edges, streets, cell), "hits")
    return classify_edges(edges, gathered(hits, ["crosswalk_id"]), oneway_codes), hits


def run_pipeline(
    crosswalks: DataFrame,
    lights: DataFrame,
    streets: DataFrame,
    radius_m: float = RADIUS_M,
    threshold: float = THRESHOLD,
    *,
    decimals: int = TEXT_DECIMALS,
    cell: float = CELL_DEGREES,
    sphere_radius_m: float = SPHERE_RADIUS_M,
    oneway_codes: Sequence[str] = ONEWAY_CODES,
    check_ids: bool = True,
    keep_geometry: bool = False,
) -> Results:
    """Score the lighting of crosswalks.

    The inputs are read several times, so they should be tables, as ``run_files`` makes them. Edges, hits, classified segments, centers and pairs are each staged once, axes and lights by the join; the four result tables
    are lazy and start from those. The pairs carry all that classification needs, so that the
    largest table is neither joined nor shuffled again before it is summed up.
    """
    if check_ids:
        for df, name in ((crosswalks, "crosswalks"), (lights, "lights"), (streets, "streets")):
            check_unique(df, name=name)
    segments, hits = segments_and_hits(
        crosswalks, streets, decimals=decimals, cell=cell, oneway_codes=oneway_codes
    )
    segments = stage(segments, "segments")
    located = stage(vehicle_direction(find_crosswalk_centers(segments, hits)), "centers")
    centers = located.drop("street_start")
    # Every center goes to several bins and every pair repeats its center, so both take along only what is needed.
    axes = with_axes(centers).select(*SIDE_COLUMNS)
    pairs = stage(lights_within(axes, lights, radius_m, sphere_radius_m), "pairs")
    classified = classify_sides(pairs)
    contrast = contrast_heuristics(classified, centers, threshold, keep_geometry=keep_geometry)
    return Results(
        crosswalk_segments=segments,
        crosswalk_centers=centers,
        center_light_pairs=pairs,
        crosswalk_centers_lights=_centers_lights(with_lat_long(centers), pairs),
        classified_streetlights=classified,
        crosswalk_centers_contrast=brightness(contrast),
        streetlights=with_lat_long(lights),
    )


def _centers_lights(centers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Centers and their lights; geometry_lat_long is the last column. Texts of a center are made before its lights multiply it."""
    last = "geometry_lat_long"
    found = center_light_pairs(centers, pairs)
    return found.select(*(c for c in found.columns if c != last), last)


def save_results(results: Results, folder: str) -> None:
    """Write the four result sets; they replace those of ``folder`` together, or not at all."""
    centers = geometry_as_wkt(with_lat_long(results.crosswalk_centers))
    publish(
        results.streetlights.sparkSession,
        folder,
        {
            "crosswalk_centers_contrast.parquet": partial(save_parquet, results.crosswalk_centers_contrast),
            "classified_streetlights.csv": partial(save_csv, results.classified_streetlights),
            "crosswalk_centers_lights.parquet": partial(save_parquet, _centers_lights(centers, results.center_light_pairs)),
            "streetlights.parquet": partial(save_parquet, results.streetlights),
        },
    )


def run_files(
    spark: SparkSession,
    crosswalks: str | DataFrame,
    lights: str | DataFrame,
    streets: str | DataFrame,
    folder: str,
    *,
    as_given: bool = False,
    **options,
) -> Results:
    """Read three GeoJSON sources, each once, score them and write the result sets to ``folder``.

    Crosswalks and streets may have parts. Coordinates are rounded to ``decimals`` unless taken ``as_given``.
    """
    decimals = None if as_given else options.get("decimals", TEXT_DECIMALS)

    def parsed(source: str | DataFrame, kind: str) -> DataFrame:
        return stage(read_source(spark, source, kind, decimals), f"input-{kind}")

    results = run_pipeline(
        parsed(crosswalks, "multipolygon"), parsed(lights, "point"), parsed(streets, "multiline"), **options
    )
    save_results(results, folder)
    return results
