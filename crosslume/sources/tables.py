"""Tables: load, preview, query, and geometry in and out of WKT columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslume.functions.geometry import (
    PARTS,
    TEXT_DECIMALS,
    from_wkt,
    kind_of,
    map_points,
    of_parts,
    parts_of,
    snap_point,
)
from crosslume.sources.geojson import GEOMETRY_METADATA, normalise, read_geojson

PREVIEW_ROWS = 10


def with_geometry(df: DataFrame, kind: str, decimals: int | None = None) -> DataFrame:
    """Parse the WKT column ``geometry``; a parsed one of single parts is taken as one with parts if need be."""
    if "geometry" not in df.columns:
        raise ValueError("no column named 'geometry'")
    data_type = df.schema["geometry"].dataType
    have = kind_of(data_type)
    if have == kind:
        return df
    geometry = F.col("geometry")
    if have is not None and PARTS.get(kind) == f"{have}s":
        parts = {PARTS[kind]: parts_of(geometry, have, PARTS[kind])}
        geometry = F.when(geometry.isNotNull(), of_parts(kind, F.lit(None), parts))
    elif not isinstance(data_type, T.StringType):
        raise ValueError(f"column 'geometry' is {data_type.simpleString()}, not text or a {kind}")
    else:
        geometry = from_wkt(geometry, kind)
        if decimals is not None:
            geometry = map_points(geometry, kind, lambda p: snap_point(p, decimals))
    return df.withColumn("geometry", geometry.alias("geometry", metadata=GEOMETRY_METADATA))


def read_source(
    spark: SparkSession, source: str | DataFrame, kind: str, decimals: int | None = TEXT_DECIMALS
) -> DataFrame:
    """A GeoJSON path, or a DataFrame with a WKT or parsed ``geometry`` column."""
    if isinstance(source, str):
        return read_geojson(spark, source, kind, decimals=decimals)
    if not isinstance(source, DataFrame) or "geometry" not in source.columns:
        raise ValueError("source must be a GeoJSON path or a DataFrame with a geometry column")
    rest = [
        normalise(F.col(f.name), f.dataType).alias(f.name)
        for f in source.schema.fields
        if f.name != "geometry"
    ]
    return with_geometry(source.select(*rest, "geometry"), kind, decimals)


def load_table(
    spark: SparkSession,
    source: str | DataFrame,
    table: str,
    kind: str,
    *,
    path: str | None = None,
    decimals: int | None = TEXT_DECIMALS,
) -> DataFrame:
    """Write a source to a table, unless there is one of that name, and return the table."""
    if not spark.catalog.tableExists(table):
        writer = read_source(spark, source, kind, decimals).write.mode("ignore").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def load_many(
    spark: SparkSession,
    datasets: Iterable[tuple[str | DataFrame, str, str]],
    *,
    path: str | None = None,
    decimals: int | None = TEXT_DECIMALS,
) -> dict[str, DataFrame]:
    """Load (source, table, kind) one after another; ``path`` is a folder for external tables."""
    return {
        table: load_table(
            spark, source, table, kind, path=f"{path}/{table}" if path else None, decimals=decimals
        )
        for source, table, kind in datasets
    }


def query_table(spark: SparkSession, table: str, query: str | None = None) -> DataFrame:
    """The result of ``query``, or the first rows of the table."""
    return spark.sql(query) if query is not None else spark.table(table).limit(PREVIEW_ROWS)


def query_geometry(
    spark: SparkSession, table: str, kind: str, query: str | None = None
) -> DataFrame:
    """As ``query_table``, with the column ``geometry`` parsed."""
    return with_geometry(query_table(spark, table, query), kind)
