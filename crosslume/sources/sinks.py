"""Sinks. All write a folder of part files, in parallel; one joins them to a single document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslume.functions.geometry import PARTS, kind_of, to_wkt
from crosslume.sources.publication import join_parts
from crosslume.sources.staging import stage_path


def geometry_as_wkt(df: DataFrame) -> DataFrame:
    """Every point, line and polygon column as WKT text."""
    return df.select(
        *[
            to_wkt(F.col(f.name), kind).alias(f.name) if (kind := kind_of(f.dataType)) else f.name
            for f in df.schema.fields
        ]
    )


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with geometry as WKT."""
    geometry_as_wkt(df).write.mode(mode).parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, geometry as WKT and other nested values as JSON; quotes are doubled."""
    flat = geometry_as_wkt(df)
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else f.name
            for f in flat.schema.fields
        ]
    ).write.mode(mode).option("header", True).option("escape", '"').csv(path)


# Names of the types in GeoJSON, by family: of one part, of several.
_GEOJSON_NAMES = {
    "points": ("Point", "MultiPoint"),
    "lines": ("LineString", "MultiLineString"),
    "polygons": ("Polygon", "MultiPolygon"),
}


def _pair(p: Column) -> Column:
    return F.array(p["x"], p["y"])


def _line(points: Column) -> Column:
    return F.transform(points, _pair)


def _rings(rings: Column) -> Column:
    return F.transform(rings, _line)


_COORDINATES = {"points": _pair, "lines": _line, "polygons": _rings}


def _object(type_name: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit(type_name).alias("type"), coordinates.alias("coordinates")))


def _parts_json(parts: Column, family: str, several: Column) -> Column:
    one, many = _GEOJSON_NAMES[family]
    own = _COORDINATES[family]
    single = _object(one, own(F.get(parts, F.lit(0))))
    return F.when((F.size(parts) == 1) & ~several, single).otherwise(_object(many, F.transform(parts, own)))


def geometry_json(geometry: Column, kind: str) -> Column:
    """A GeoJSON geometry as text: of many parts unless there is just one (a ``geometry`` keeps its type)."""
    if kind in PARTS:
        text = _parts_json(geometry[PARTS[kind]], PARTS[kind], F.lit(False))
    elif kind == "geometry":

        def each(family: str) -> Column:
            one = _GEOJSON_NAMES[family][0]
            return F.transform(geometry[family], lambda part: _object(one, _COORDINATES[family](part)))

        text = None
        for family, names in _GEOJSON_NAMES.items():
            own = _parts_json(geometry[family], family, geometry["type"] == names[1].upper())
            text = (F if text is None else text).when(geometry["type"].isin(*(n.upper() for n in names)), own)
        body = F.array_join(F.concat(*(each(family) for family in _GEOJSON_NAMES)), ",")
        text = text.otherwise(F.concat(F.lit('{"type":"GeometryCollection","geometries":['), body, F.lit("]}")))
    else:
        text = _object(_GEOJSON_NAMES[f"{kind}s"][0], _COORDINATES[f"{kind}s"](geometry))
    return F.when(geometry.isNotNull(), text)


def feature_json(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row as column ``value``: ``geometry`` and all else as properties."""
    if "geometry" not in df.columns:
        raise ValueError("no column named 'geometry'")
    kind = kind_of(df.schema["geometry"].dataType)
    if kind is None:
        raise ValueError("column 'geometry' is not parsed; use with_geometry first")
    properties = [
        (to_wkt(F.col(f.name), k) if (k := kind_of(f.dataType)) else F.col(f.name)).alias(f.name)
        for f in df.schema.fields
        if f.name != "geometry"
    ]
    own = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    geometry = F.coalesce(geometry_json(F.col("geometry"), kind), F.lit("null"))
    parts = [F.lit('{"type":"Feature","properties":'), own, F.lit(',"geometry":'), geometry, F.lit("}")]
    return df.select(F.concat(*parts).alias("value"))


def save_geojson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """GeoJSON, one feature per line, which ``read_geojson`` reads in splits."""
    feature_json(df).write.mode(mode).text(path)


def save_feature_collection(df: DataFrame, path: str) -> None:
    """One GeoJSON file, a FeatureCollection with a feature on each line.

    Features are written by all tasks as part files, which are then joined; if a task fails there is no file.
    """
    spark = df.sparkSession
    parts = stage_path(spark, "features")
    features = feature_json(df).select(F.concat(F.lit(",\n"), "value").alias("value"))
    features.write.option("lineSep", "\n").text(parts)
    # The first feature needs no comma before it.
    join_parts(spark, parts, path, '{"type":"FeatureCollection","features":[', "]}\n", skip=1)
