"""Context of crosswalks: population density of tracts, and categories of places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslume.functions.geodesy import mercator_area
from crosslume.functions.geometry import kind_of


def population_density(tracts: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Tracts with ``area_km2`` (planar, EPSG:3857) and ``<segment>_per_km2`` of each count column.

    Tracts may have parts and holes. A tract without area or count has NULL there.
    """
    kind = kind_of(tracts.schema["geometry"].dataType) or "polygon"
    with_area = tracts.withColumn("area_km2", mercator_area(F.col("geometry"), kind) / 1e6)
    area = F.nullif(F.col("area_km2"), F.lit(0.0))
    return with_area.withColumns({f"{s}_per_km2": F.col(s) / area for s in segments})


def place_categories(places: DataFrame, categories: DataFrame) -> DataFrame:
    """(OBJECTID, category) of places with a map ``tags``, by a table of (tag, value, category).

    A place has every category one of its tags stands for, once; a value NULL in the table fits any value.
    """
    tags = places.select("OBJECTID", F.explode("tags").alias("tag", "value"))
    exact = tags.join(categories.where("value IS NOT NULL"), ["tag", "value"])
    any_value = tags.select("OBJECTID", "tag").join(categories.where("value IS NULL").select("tag", "category"), "tag")
    columns = ["OBJECTID", "category"]
    return exact.select(*columns).unionByName(any_value.select(*columns)).distinct()
