"""GeoJSON files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslume.functions.geometry import KINDS, PARTS, TEXT_DECIMALS, let, of_parts, point, snap
from crosslume.sources.json_documents import objects
from crosslume.sources.staging import stage

# Coordinates on longitude and latitude (EPSG:4326).
GEOMETRY_METADATA = {"srid": 4326}

# The types of GeoJSON, their family, and how deep their coordinates are nested.
_TYPES = {
    "Point": ("points", 1),
    "MultiPoint": ("points", 2),
    "LineString": ("lines", 2),
    "MultiLineString": ("lines", 3),
    "Polygon": ("polygons", 3),
    "MultiPolygon": ("polygons", 4),
}
_COLLECTION = "GeometryCollection"


# A feature as text: properties and coordinates are read once their types are known.
_SHAPE = "struct<type:string,coordinates:string,geometries:string>"
_FEATURE = f"struct<type:string,properties:string,geometry:{_SHAPE}>"
_DOCUMENT = f"struct<type:string,properties:string,geometry:{_SHAPE},features:array<{_FEATURE}>>"
# What may stand on a line besides features: the head and the foot of a collection.
_HEAD = r'^\s*\{(?:(?!"features").)*"features"\s*:\s*\[\s*,?'
_FOOT = r"\s*,?\s*\]\s*(?:,\s*\"(?:(?!\"features\").)*)?\}\s*$"
_NOTHING = r"^\s*(?:[\[\]{},]\s*)*$"


def _line_features(line: Column) -> Column:
    """All features of a line, none for the head or foot of a collection, NULL for anything else.

    Features may follow the head, stand several on a line, or be followed by the foot.
    """

    def whole(text: Column) -> Column:
        body = F.regexp_replace(text, r"^\s*,|,\s*$", "")
        found = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{_FEATURE}>")

        def features_only(own: Column) -> Column:
            return F.when((F.size(own) > 0) & F.forall(own, lambda f: F.coalesce(f["type"] == "Feature", F.lit(False))), own)

        return let(found, features_only)

    def without(pattern: str) -> Column:
        return F.when(line.rlike(pattern), whole(F.regexp_replace(line, pattern, "")))

    both = F.when(line.rlike(_HEAD) & line.rlike(_FOOT), whole(F.regexp_replace(F.regexp_replace(line, _HEAD, ""), _FOOT, "")))
    bare = F.regexp_replace(F.regexp_replace(line, _HEAD, ""), _FOOT, "")
    none = F.array().cast(f"array<{_FEATURE}>")
    return F.coalesce(
        whole(line), without(_HEAD), without(_FOOT), both, F.when(bare.rlike(_NOTHING), none)
    )


def _features(spark: SparkSession, path: str, again: bool) -> DataFrame:
    """Every feature of the files at ``path``, one row each, as text (see ``_FEATURE``).

    Those of documents are staged too if they are read ``again``.

    A file whose lines all hold whole features is read by line. Any other is one JSON document (or
    several, one after the other), cut into features by ``objects``. Both are read in splits; text that is not
    JSON is an error.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.select("file", _line_features(F.col("value")).alias("found"))
    lines = stage(
        lines.select("file", F.col("found").isNull().alias("other"), F.explode_outer("found").alias("f")),
        "geojson-lines",
    )
    others = lines.groupBy("file").agg(F.max("other").alias("other")).where("other").select("file")
    by_line = lines.where("f IS NOT NULL").join(others, "file", "left_anti").select("f.*")
    names = [row["file"] for row in others.collect()]  # one for each document file
    if not names:
        return by_line
    parsed = F.from_json("text", _DOCUMENT, {"mode": "FAILFAST"})
    each = objects(spark, names).select(parsed.alias("d"))
    own = F.struct("d.type", "d.properties", "d.geometry").cast(_FEATURE)
    unknown = F.raise_error(F.concat(F.lit("not a feature or collection: "), F.coalesce("d.type", F.lit("?"))))
    found = (
        F.when(F.col("d.features").isNotNull(), F.col("d.features"))
        .when(F.col("d.type") == "Feature", F.array(own))
        .otherwise(unknown.cast(f"array<{_FEATURE}>"))
    )
    features = each.select(F.explode(found).alias("f")).select("f.*")
    kind = F.when(F.col("type") == "Feature", F.col("type")).otherwise(
        F.raise_error(F.concat(F.lit("not a feature: "), F.coalesce("type", F.lit("?"))))
    )
    features = features.withColumn("type", kind)
    return by_line.unionByName(stage(features, "geojson-features") if again else features)


def _property_types(features: DataFrame) -> list[tuple[str, str]]:
    """Names of all properties and what they are read as, from all features."""
    each = features.lateralJoin(
        features.sparkSession.tvf.variant_explode(F.parse_json(F.col("properties").outer()))
    )
    types = each.groupBy("key").agg(F.collect_set(F.schema_of_variant("value")).alias("types"))
    found = []
    for row in types.orderBy("key").collect():  # a row for each property
        kinds = {t.split("(")[0].split("<")[0] for t in row["types"]} - {"VOID"}
        if kinds and kinds <= {"BIGINT"}:
            kind = "bigint"
        elif kinds and kinds <= {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}:
            kind = "double"
        else:
            kind = "boolean" if kinds == {"BOOLEAN"} else "string"
        found.append((row["key"], kind))
    return found


def _properties(features: DataFrame, schema: T.StructType | None) -> list[Column]:
    if schema is not None:
        parsed = F.from_json("properties", schema, {"mode": "FAILFAST"})
        return [normalise(parsed.getField(f.name), f.dataType).alias(f.name) for f in schema.fields]
    values = F.parse_json("properties")
    return [
        F.variant_get(values, "$['" + name.replace("'", "\\'") + "']", kind).alias(name)
        for name, kind in _property_types(features)
    ]


def _parts(text: Column, type_name: str, decimals: int | None) -> Column:
    """The parts of coordinates of this type, as an array."""
    family, nesting = _TYPES[type_name]
    spec: T.DataType = T.DoubleType()
    for _ in range(nesting):
        spec = T.ArrayType(spec)
    numbers = F.from_json(text, spec)

    def to_point(c: Column) -> Column:
        x, y = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        return point(x, y) if decimals is None else point(snap(x, decimals), snap(y, decimals))

    def to_line(line: Column) -> Column:
        return F.transform(line, to_point)

    def to_polygon(rings: Column) -> Column:
        return F.transform(rings, to_line)

    parse = {"points": to_point, "lines": to_line, "polygons": to_polygon}[family]
    return F.transform(numbers, parse) if type_name.startswith("Multi") else F.transform(F.array(numbers), parse)


def _collection(text: Column, decimals: int | None) -> Column:
    """A ``geometry`` out of the members of a collection; one inside another is an error."""
    members = F.from_json(text, "array<struct<type:string,coordinates:string>>")
    wrong = F.exists(members, lambda m: ~m["type"].isin(*_TYPES))

    def every(name: str) -> Column:
        own = F.filter(members, lambda m: m["type"] == name)
        return F.flatten(F.transform(own, lambda m: _parts(m["coordinates"], name, decimals)))

    parts: dict[str, list[Column]] = {}
    for name, (family, _) in _TYPES.items():
        parts.setdefault(family, []).append(every(name))
    whole = of_parts("geometry", F.lit(_COLLECTION.upper()), {f: F.concat(*own) for f, own in parts.items()})
    return F.when(wrong, F.raise_error(F.concat(F.lit("not a geometry: "), text)).cast(KINDS["geometry"])).otherwise(whole)


def _geometry(kind: str, decimals: int | None) -> Column:
    """Parsed geometry; a feature without geometry gives NULL, one of a type the kind has no room for an error."""
    type_name, text, members = (F.col(f"geometry.{c}") for c in ("type", "coordinates", "geometries"))
    parsed = F.when(type_name.isNull() | (text.isNull() & members.isNull()), F.lit(None).cast(KINDS[kind]))
    for name, (family, _) in _TYPES.items():
        if kind != "geometry" and family != PARTS.get(kind, f"{kind}s"):
            continue
        parts = _parts(text, name, decimals)
        if family == f"{kind}s" and not name.startswith("Multi"):
            parsed = parsed.when(type_name == name, F.get(parts, F.lit(0)))
        else:
            parsed = parsed.when(type_name == name, of_parts(kind, F.lit(name.upper()), {family: parts}))
    if kind == "geometry":
        parsed = parsed.when(type_name == _COLLECTION, _collection(members, decimals))
    return parsed.otherwise(F.raise_error(F.concat(F.lit(f"not a {kind} geometry: "), type_name)))


def normalise(column: Column, data_type: T.DataType) -> Column:
    """Numbers and booleans as they are, anything else as text (nested values as JSON)."""
    if isinstance(data_type, (T.NumericType, T.BooleanType, T.StringType)):
        return column
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def read_geojson(
    spark: SparkSession,
    path: str,
    kind: str,
    *,
    properties: T.StructType | None = None,
    decimals: int | None = TEXT_DECIMALS,
) -> DataFrame:
    """Properties as columns, then ``geometry`` parsed as one of ``KINDS``.

    Kinds with parts (``multipolygon``, ...) take features of one part too; ``geometry`` takes any. A feature of
    several parts is an error where ``line`` or ``polygon`` is asked for.

    A path may name files of different layouts: lines of whole features (one or several, inside a collection or
    without one), or JSON documents in one line or many. All are read in splits by many tasks. A bad record is
    an error. The text is parsed once and staged; types of properties come from all features unless ``properties`` gives
    them. Coordinates are rounded to ``decimals``; None keeps them as they are.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown geometry kind {kind!r}")
    # Types of properties take a pass of their own.
    features = _features(spark, path, again=properties is None)
    geometry = _geometry(kind, decimals).alias("geometry", metadata=GEOMETRY_METADATA)
    return features.select(*_properties(features, properties), geometry)
