"""Registered queries: one per operator, over the layout of ``fixtures``.

Results are long and rounded: no text geometry, no arrays.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslume.functions.geodesy import meters_to_degrees
from crosslume.functions.geometry import from_wkt, kind_of, point, point_n, to_wkt
from crosslume.operators.centers import crossings, find_crosswalk_centers, oneway_centers, twoway_centers
from crosslume.operators.crosswalks import classify_edges, decompose_edges, simplify_to_rectangle
from crosslume.operators.direction import oneway_direction, twoway_direction, vehicle_direction
from crosslume.operators.lighting import (
    SIDE_COLUMNS,
    brightness,
    center_light_pairs,
    classify_sides,
    contrast_heuristics,
    explode_lights,
    light_lists,
    lookup_distance,
    with_axes,
    with_lat_long,
)
from crosslume.operators.places import place_categories, population_density
from crosslume.operators.spatial_join import lights_within, segment_hits
from crosslume.plans import fixtures
from crosslume.plans.run import (
    RADIUS_M,
    THRESHOLD,
    run_files,
    run_pipeline,
    save_results,
    segments_and_hits,
)
from crosslume.sources.geojson import read_geojson
from crosslume.sources.sinks import (
    feature_json,
    geometry_as_wkt,
    save_csv,
    save_feature_collection,
    save_geojson,
    save_parquet,
)
from crosslume.sources.staging import stage, stage_path
from crosslume.sources.tables import load_many, query_geometry, query_table, with_geometry

_KEY = ("crosswalk_id", "street_segment_id", "center_id")


def _layers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "crosswalks": fixtures.crosswalks(spark, sf_dir),
        "streetlights": fixtures.streetlights(spark, sf_dir),
        "street_segments": fixtures.street_segments(spark, sf_dir),
    }


def _vertices(df: DataFrame, layer: str, decimals: int) -> DataFrame:
    """layer, object_id, pos, x, y of every vertex."""
    kind = kind_of(df.schema["geometry"].dataType)
    geometry = F.col("geometry")
    points = {"point": F.array(geometry), "line": geometry, "polygon": F.flatten(geometry)}[kind]
    return df.select(
        F.lit(layer).alias("layer"),
        F.col("OBJECTID").alias("object_id"),
        # Outer, or Spark would compute the points twice more to filter out empty ones.
        F.posexplode_outer(points).alias("pos", "p"),
    ).where("pos IS NOT NULL").select(
        "layer",
        "object_id",
        F.col("pos").cast("long").alias("pos"),
        F.round("p.x", decimals).alias("x"),
        F.round("p.y", decimals).alias("y"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = []
    for name, df in _layers(spark, sf_dir).items():
        path = stage_path(spark, f"{name}-geojson")
        save_geojson(df, path)
        kind = kind_of(df.schema["geometry"].dataType)
        frames.append(_vertices(read_geojson(spark, path, kind), name, 6))
    return _union(frames)


def geojson_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets with properties, written as text in every layout a reader may meet."""
    streets = fixtures.street_segments(spark, sf_dir)
    key = F.col("OBJECTID")
    streets = streets.select(
        "*", (key % 3 == 0).alias("lit"), ((key % 5).cast("double") / 2).alias("width")
    )
    group = F.floor(key / 500)
    features = feature_json(streets.withColumn("group", group)).select(
        "value", F.get_json_object("value", "$.properties.group").cast("long").alias("group")
    )
    drop_group = F.regexp_replace("value", r'"group":\d+,?', "")
    # Every layout is made of them.
    features = stage(features.select("group", F.regexp_replace(drop_group, r",\}", "}").alias("value")), "features")
    pretty = F.regexp_replace("value", r'([{,])"', '$1\n  "')
    head = F.lit('{"type":"FeatureCollection","features":[')

    def joined(value: Column, between: str) -> DataFrame:
        return features.groupBy("group").agg(F.array_join(F.collect_list(value), between).alias("value"))

    alternating = F.when(F.crc32("value") % 2 == 0, pretty).otherwise(F.col("value"))
    documents = joined(pretty, ",").select("group", F.concat(head, "value", F.lit("\n ]\n}")).alias("value"))
    multi = F.regexp_replace(
        F.regexp_replace("value", '"LineString"', '"MultiLineString"'), r'"coordinates":(\[.*\])\}', '"coordinates":[$1]}'
    )
    texts = {
        "lines": [features],
        "header": [joined(F.col("value"), ",\n").select(F.concat(head, "value", F.lit("]}")).alias("value"))],
        "several": [joined(F.col("value"), ", ")],
        "pretty": [features.select(alternating.alias("value"))],
        "document": [documents],
        "folder": [features.where("group % 2 = 0"), documents.where("group % 2 <> 0")],
        "multi": [features.select(multi.alias("value"))],
    }
    frames = []
    for layout, parts in texts.items():
        folder = stage_path(spark, f"layout-{layout}")
        for i, part in enumerate(parts):
            part.select("value").write.text(f"{folder}/{i}")
        read = read_geojson(spark, f"{folder}/*", "line")
        frames.append(
            # Outer, or Spark would parse the geometry twice more to filter out empty ones.
            read.select("*", F.posexplode_outer("geometry").alias("pos", "p")).where("pos IS NOT NULL").select(
                F.lit(layout).alias("layout"),
                F.col("OBJECTID").alias("object_id"),
                F.col("pos").cast("long").alias("pos"),
                F.round("p.x", 6).alias("x"),
                F.round("p.y", 6).alias("y"),
                F.col("ONEWAY").alias("oneway"),
                "lit",
                "width",
            )
        )
    return _union(frames)


def overlap_and_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 8 x 4 units with a hole, by turns met by a street that

    runs along the lower edge and beyond it with vertices inside, ends on the lower edge of the hole, turns at
    the lower right corner and goes on elsewhere after a NULL vertex, or touches nothing.
    """
    unit = F.lit(0.001)
    key = F.col("p_partkey")
    base = (key % 1000 * F.lit(0.02), F.floor(key / 1000) % 2000 * F.lit(0.02))

    def at(x: float, y: float) -> Column:
        return point(base[0] + F.lit(float(x)) * unit, base[1] + F.lit(float(y)) * unit)

    def ring(*corners: tuple[float, float]) -> Column:
        return F.array(*[at(*c) for c in (*corners, corners[0])])

    part = fixtures.table(spark, sf_dir, "part")
    boxes = part.select(
        key.alias("OBJECTID"),
        F.array(ring((0, 0), (8, 0), (8, 4), (0, 4)), ring((3, 2), (5, 2), (5, 3), (3, 3))).alias("geometry"),
    )
    gap = F.lit(None).cast("struct<x:double,y:double>")
    streets = part.select(
        key.alias("OBJECTID"),
        F.lit(None).cast("string").alias("ONEWAY"),
        F.when(key % 4 == 0, F.array(at(-2, 0), at(3, 0), at(6, 0), at(10, 0)))
        .when(key % 4 == 1, F.array(at(4, 1), at(4, 2)))
        .when(key % 4 == 2, F.array(at(7, -1), at(8, 0), at(9, 1), gap, at(-3, -3), at(-2, -3)))
        .otherwise(F.array(at(1, 1), at(2, 1)))
        .alias("geometry"),
    )
    edges = decompose_edges(boxes)
    hits = stage(segment_hits(edges, streets), "hits")
    found = crossings(hits)
    # Places are as many as parts, however small their file: they must not go through the driver.
    place = part.select(key.alias("crosswalk_id"), base[0].alias("bx"), base[1].alias("by")).hint("merge")

    def mean(axis: str) -> Column:
        units = (F.col(f"sum_{axis}") / F.col("n") / F.lit(1e9) - F.col(f"b{axis}")) / unit
        return F.coalesce(F.round(units, 3) + 0.0, F.lit(-1.0)).alias(f"mean_{axis}")

    return (
        classify_edges(edges, hits)
        .select("crosswalk_id", "ring_id", "edge_id", "is_vehicle_edge")
        .join(found, "crosswalk_id", "left")
        .join(place, "crosswalk_id")
        .select(
            "crosswalk_id",
            "ring_id",
            "edge_id",
            "is_vehicle_edge",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_points"),
            mean("x"),
            mean("y"),
        )
    )


def overlap_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centers of one-way crosswalks of 8 x 4 units, by turns met by a street that

    runs along 2 units of the lower edge and crosses the upper one, runs along 1 unit of the lower and 4 of the
    upper edge, runs along the lower edge and part of the way back, or crosses both edges.
    """
    unit, key = F.lit(0.001), F.col("p_partkey")
    base = (key % 1000 * F.lit(0.02), F.floor(key / 1000) % 2000 * F.lit(0.02))

    def line(*points: tuple[float, float]) -> Column:
        return F.array(*[point(base[0] + F.lit(float(x)) * unit, base[1] + F.lit(float(y)) * unit) for x, y in points])

    part = fixtures.table(spark, sf_dir, "part")
    boxes = part.select(key.alias("OBJECTID"), F.array(line((0, 0), (8, 0), (8, 4), (0, 4), (0, 0))).alias("geometry"))
    streets = part.select(
        key.alias("OBJECTID"),
        F.lit("FT").alias("ONEWAY"),
        F.when(key % 4 == 0, line((1, 0), (3, 0), (3, 6)))
        .when(key % 4 == 1, line((1, 0), (2, 0), (2, 4), (6, 4)))
        .when(key % 4 == 2, line((1, 0), (5, 0), (3, 0), (3, -2)))
        .otherwise(line((2, -1), (2, 5)))
        .alias("geometry"),
    )
    edges = stage(decompose_edges(boxes), "edges")
    hits = stage(segment_hits(edges, streets), "hits")
    centers = oneway_centers(classify_edges(edges, hits), hits)
    # As many as parts, however small their file: they must not go through the driver.
    place = part.select(key.alias("crosswalk_id"), base[0].alias("x"), base[1].alias("y")).hint("merge")
    units = [F.round((F.col(f"geometry.{a}") - F.col(a)) / unit, 3) + 0.0 for a in "xy"]
    return centers.join(place, "crosswalk_id").select("crosswalk_id", units[0].alias("center_x"), units[1].alias("center_y"))


def csv_parquet_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets with their properties, saved and read back."""
    streets = fixtures.street_segments(spark, sf_dir)
    folder = stage_path(spark, "contents")
    save_csv(streets, f"{folder}/csv")
    save_parquet(streets, f"{folder}/parquet")
    read = {
        "csv": spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv"),
        "parquet": spark.read.parquet(f"{folder}/parquet"),
    }
    return _union(
        [
            df.select(
                F.lit(name).alias("format"),
                F.col("OBJECTID").cast("long").alias("object_id"),
                F.col("ONEWAY").alias("oneway"),
                "geometry",
            )
            for name, df in read.items()
        ]
    )


def wkt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = []
    for name, df in _layers(spark, sf_dir).items():
        kind = kind_of(df.schema["geometry"].dataType)
        text = df.withColumn("geometry", to_wkt(F.col("geometry"), kind))
        parsed = text.withColumn("geometry", from_wkt(F.col("geometry"), kind))
        frames.append(_vertices(parsed, name, 9))
    return _union(frames)


def multipart_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipolygons with holes and multilines, through every format that holds geometry."""
    frames = []
    for layer, df in {
        "polygons": fixtures.parted_polygons(spark, sf_dir),
        "lines": fixtures.parted_lines(spark, sf_dir),
    }.items():
        kind = kind_of(df.schema["geometry"].dataType)
        folder = stage_path(spark, f"multipart-{layer}")
        save_geojson(df, f"{folder}/geojson")
        save_csv(df, f"{folder}/csv")
        save_parquet(df, f"{folder}/parquet")
        text = df.withColumn("geometry", to_wkt(F.col("geometry"), kind))
        read = {
            "geojson": read_geojson(spark, f"{folder}/geojson", kind),
            "csv": with_geometry(spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv"), kind),
            "parquet": with_geometry(spark.read.parquet(f"{folder}/parquet"), kind),
            "wkt": with_geometry(text, kind),
            # A column of any geometry keeps parts as well.
            "any": with_geometry(text, "geometry"),
        }
        for name, back in read.items():
            # Outer explodes: for an inner one Spark would parse the geometry twice more, to filter out empty ones.
            each = back.select(F.col("OBJECTID").cast("long").alias("object_id"), F.posexplode_outer(f"geometry.{layer}").alias("part", "g"))
            if layer == "lines":
                each = each.withColumn("g", F.array("g"))
            rings = each.select("object_id", "part", F.posexplode_outer("g").alias("ring", "points"))
            points = rings.select("object_id", "part", "ring", F.posexplode_outer("points").alias("pos", "p")).where("pos IS NOT NULL")
            frames.append(
                points.select(
                    F.lit(name).alias("format"),
                    F.lit(layer).alias("layer"),
                    "object_id",
                    *[F.col(c).cast("long").alias(c) for c in ("part", "ring", "pos")],
                    F.round("p.x", 6).alias("x"),
                    F.round("p.y", 6).alias("y"),
                )
            )
    return _union(frames)


def load_many_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = uuid.uuid4().hex[:12]
    folder = stage_path(spark, "tables")
    layers = _layers(spark, sf_dir)
    kinds = {name: kind_of(df.schema["geometry"].dataType) for name, df in layers.items()}
    load_many(
        spark,
        [(geometry_as_wkt(df), f"{name}_{tag}", kinds[name]) for name, df in layers.items()],
        path=folder,
    )
    frames = []
    for name, kind in kinds.items():
        table = f"{name}_{tag}"
        # Loading again changes nothing: the table exists.
        other = layers[name].withColumn("OBJECTID", -F.col("OBJECTID"))
        again = load_many(spark, [(geometry_as_wkt(other), table, kind)])[table]
        everything = query_geometry(spark, table, kind, f"SELECT * FROM {table}")
        save_parquet(everything, f"{folder}/out/{name}.parquet")
        save_csv(everything, f"{folder}/out/{name}.csv")
        counts = [
            again,
            query_table(spark, table),
            spark.read.parquet(f"{folder}/out/{name}.parquet"),
            spark.read.option("header", True).csv(f"{folder}/out/{name}.csv"),
        ]
        columns = ("n_rows", "n_preview", "n_parquet", "n_csv")
        frames += [
            df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("table_name"), F.lit(column).alias("what"), "n"
            )
            for df, column in zip(counts, columns, strict=True)
        ]
    return _union(frames).groupBy("table_name").agg(
        *[F.max(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in columns]
    )


def min_area_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = simplify_to_rectangle(fixtures.crosswalks(spark, sf_dir))
    return (
        boxes.select(
            F.col("OBJECTID").alias("crosswalk_id"),
            F.posexplode_outer(F.slice(F.get("geometry", F.lit(0)), 1, 4)).alias("pos", "p"),
        )
        .select(
            "crosswalk_id",
            F.col("pos").cast("long").alias("corner"),
            F.round("p.x", 9).alias("x"),
            F.round("p.y", 9).alias("y"),
        )
    )


def _end(n: int, axis: str, line: str = "geometry") -> Column:
    return F.round(point_n(F.col(line), n)[axis], 9)


def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose_edges(fixtures.crosswalks(spark, sf_dir)).select(
        "crosswalk_id",
        "ring_id",
        "edge_id",
        *[_end(n, axis).alias(f"{axis}{n}") for n in (1, 2) for axis in "xy"],
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose_edges(simplify_to_rectangle(fixtures.crosswalks(spark, sf_dir)))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment_hits(
        stage(_edges(spark, sf_dir), "edges"), fixtures.street_segments(spark, sf_dir)
    )
    return found.select(
        "crosswalk_id",
        "edge_id",
        "street_segment_id",
        F.col("piece_id").cast("long").alias("piece_id"),
        F.round("x", 9).alias("x"),
        F.round("y", 9).alias("y"),
    )


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return segments_and_hits(
        fixtures.crosswalks(spark, sf_dir), fixtures.street_segments(spark, sf_dir)
    )


def classified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = _segments(spark, sf_dir)
    return segments.select(
        "crosswalk_id",
        "edge_id",
        "is_vehicle_edge",
        F.coalesce("street_segment_id", F.lit(-1)).alias("street_segment_id"),
        "is_oneway",
    )


def _center_columns() -> list:
    def coordinate(p: str, axis: str, name: str) -> Column:
        return F.round(F.col(p)[axis], 9).alias(name)

    ends = [
        F.coalesce(_end(n, axis, "ped_edge_geom"), F.lit(0.0)).alias(f"ped_{axis}{n}")
        for n in (1, 2)
        for axis in "xy"
    ]
    return [
        *_KEY,
        coordinate("street_center_point", "x", "street_x"),
        coordinate("street_center_point", "y", "street_y"),
        coordinate("geometry", "x", "x"),
        coordinate("geometry", "y", "y"),
        *ends,
    ]


def centers_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oneway_centers(*_segments(spark, sf_dir)).select(*_center_columns())


def centers_twoway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twoway_centers(*_segments(spark, sf_dir)).select(*_center_columns())


def crosswalk_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_crosswalk_centers(*_segments(spark, sf_dir)).select(*_center_columns(), "is_oneway")


def _way_columns() -> list:
    return [
        *_KEY,
        *[
            F.coalesce(F.round(F.col(f"{end}_coord")[axis], 9), F.lit(0.0)).alias(f"{end}_{axis}")
            for end in ("from", "to")
            for axis in "xy"
        ],
    ]


def direction_oneway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oneway_direction(oneway_centers(*_segments(spark, sf_dir))).select(*_way_columns())


def direction_twoway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twoway_direction(twoway_centers(*_segments(spark, sf_dir))).select(*_way_columns())


def lat_long_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lat_long(fixtures.streetlights(spark, sf_dir)).select(
        F.col("OBJECTID").alias("object_id"), "geometry_lat_long"
    )


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    meters = F.col("OBJECTID") % 500
    return fixtures.streetlights(spark, sf_dir).select(
        F.col("OBJECTID").alias("object_id"),
        F.round(meters_to_degrees(meters, F.col("geometry.y")), 12).alias("degrees"),
        F.round(meters_to_degrees(meters), 12).alias("degrees_default"),
    )


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = vehicle_direction(find_crosswalk_centers(*_segments(spark, sf_dir)))
    return stage(centers.drop("street_start"), "centers")


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    centers = _centers(spark, sf_dir)
    lights = fixtures.streetlights(spark, sf_dir)
    axes = with_axes(centers).select(*SIDE_COLUMNS)
    return centers, lights_within(axes, lights, RADIUS_M)


def _pair_columns() -> list:
    return [*_KEY, "streetlight_id", F.round(F.col("dist").cast("double"), 4).alias("dist")]


def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    lights = fixtures.streetlights(spark, sf_dir)
    return lights_within(_centers(spark, sf_dir), lights, RADIUS_M).select(*_pair_columns())


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Centers with their lists, and the pairs these were made from."""
    centers, pairs = _pairs(spark, sf_dir)
    pairs = stage(pairs, "pairs")
    return light_lists(centers, pairs), pairs


def lights_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, dists = F.col("streetlight_id"), F.col("streetlight_dist")
    listed = _lists(spark, sf_dir)[0].select(
        *_KEY,
        "list_part",
        ids.alias("ids"),
        dists.alias("dists"),
        F.inline(F.arrays_zip("streetlight_id", "streetlight_dist")),
    )
    looked_up = lookup_distance(F.col("ids"), F.col("dists"), F.col("streetlight_id"))
    return listed.withColumnRenamed("streetlight_dist", "dist").select(
        *_pair_columns(),
        F.round(looked_up.cast("double"), 4).alias("looked_up"),
        F.col("list_part").cast("long").alias("list_part"),
    )


def centers_without_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir)[0].where(F.col("streetlight_id").isNull()).select(*_KEY)


def classify_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs = _pairs(spark, sf_dir)
    # -9 stands for the angle of a crosswalk without an axis.
    return classify_sides(pairs).select(
        *_pair_columns(),
        "side",
        *[
            F.round(F.coalesce(c, F.lit(-9.0)), 6).alias(c) for c in ("angle_rad", "abs_sin_angle")
        ],
    )


def _score_columns() -> list:
    return [
        "crosswalk_id",
        "center_id",
        *[F.round(f"{s}_contrast_heuristic", 8).alias(f"{s}_contrast_heuristic") for s in ("to", "from")],
        *[
            F.round(f"{s}_brightness_heuristic", 6).alias(f"{s}_brightness_heuristic")
            for s in ("to", "from")
        ],
        "contrast_heuristic",
    ]


def _light_heuristic() -> Column:
    return F.round(F.col("light_heuristic").cast("double"), 4).alias("light_heuristic")


def _contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers, pairs = _pairs(spark, sf_dir)
    return contrast_heuristics(classify_sides(pairs), centers, THRESHOLD)


def contrast_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contrast(spark, sf_dir).select(*_score_columns())


def perceived_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brightness(_contrast(spark, sf_dir)).select(
        "crosswalk_id", "center_id", _light_heuristic()
    )


def _all_pairs(df: DataFrame) -> DataFrame:
    """Pairs with -1 for a center without lights."""
    dist = F.coalesce(F.col("streetlight_dist").cast("double"), F.lit(-1.0))
    return df.select(
        *_KEY,
        F.coalesce("streetlight_id", F.lit(-1)).alias("streetlight_id"),
        F.round(dist, 4).alias("streetlight_dist"),
    )


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers, pairs = _pairs(spark, sf_dir)
    return _all_pairs(center_light_pairs(centers, stage(pairs, "pairs")))


def exploded_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, pairs = _lists(spark, sf_dir)
    listed = explode_lights(lists, fixtures.streetlights(spark, sf_dir), pairs)
    return listed.select(*_pair_columns(), F.round("light.x", 9).alias("x"), F.round("light.y", 9).alias("y"))


def _saved(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a run from GeoJSON files to the four saved tables."""
    folder = stage_path(spark, "results")
    layers = _layers(spark, sf_dir)
    # Full precision here: the other queries work on unrounded layers too.
    results = run_pipeline(layers["crosswalks"], layers["streetlights"], layers["street_segments"])
    save_results(results, folder)
    return folder


def saved_centers_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pairs(spark.read.parquet(f"{_saved(spark, sf_dir)}/crosswalk_centers_lights.parquet"))


def saved_streetlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = spark.read.parquet(f"{_saved(spark, sf_dir)}/streetlights.parquet")
    return saved.select(F.col("OBJECTID").alias("object_id"), "geometry", "geometry_lat_long")


def saved_classified_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_saved(spark, sf_dir)}/classified_streetlights.csv"
    saved = spark.read.option("header", True).option("escape", '"').csv(path)
    return saved.select(
        *[F.col(c).cast("long").alias(c) for c in ("crosswalk_id", "street_segment_id", "streetlight_id")],
        "center_id",
        F.round(F.col("dist").cast("float").cast("double"), 4).alias("dist"),
        "side",
        F.round(F.coalesce(F.col("angle_rad").cast("double"), F.lit(-9.0)), 6).alias("angle_rad"),
        "line_geom",
        "geometry",
    )


def full_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = spark.read.parquet(f"{_saved(spark, sf_dir)}/crosswalk_centers_contrast.parquet")
    return saved.select(*_score_columns(), _light_heuristic())


def files_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From three GeoJSON files, two of them one document each, to the saved scores."""
    folder, layers = stage_path(spark, "files"), _layers(spark, sf_dir)
    save_feature_collection(layers["crosswalks"], f"{folder}/crosswalks.geojson")
    save_feature_collection(layers["street_segments"], f"{folder}/street_segments.geojson")
    save_geojson(layers["streetlights"], f"{folder}/streetlights")
    names = [f"{folder}/{name}" for name in ("crosswalks.geojson", "streetlights", "street_segments.geojson")]
    run_files(spark, *names, f"{folder}/results", as_given=True)
    saved = spark.read.parquet(f"{folder}/results/crosswalk_centers_contrast.parquet")
    return saved.select(*_score_columns(), _light_heuristic())


def tract_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crosswalk as a tract with made-up counts of its part."""
    counts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("OBJECTID"),
        (F.col("p_size") * 100).alias("total"),
        (F.col("p_size") % 10 * 10).alias("seniors"),
    )
    tracts = fixtures.crosswalks(spark, sf_dir).join(counts.hint("merge"), "OBJECTID")
    dense = population_density(tracts, ["total", "seniors"])
    return dense.select(
        F.col("OBJECTID").alias("tract_id"),
        F.round(F.col("area_km2") * 1e6, 1).alias("area_m2"),
        *[F.round(F.col(f"{s}_per_km2") / 1e5, 1).alias(f"{s}_per_10m2") for s in ("total", "seniors")],
    )


def parted_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracts of several parts, with holes that run either way."""
    counts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("OBJECTID"), (F.col("p_size") * 1000).alias("total")
    )
    dense = population_density(fixtures.parted_polygons(spark, sf_dir).join(counts.hint("merge"), "OBJECTID"), ["total"])
    return dense.select(
        F.col("OBJECTID").alias("tract_id"),
        F.round("area_km2", 5).alias("area_km2"),
        F.round("total_per_km2", 3).alias("total_per_km2"),
    )


def categories_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as places tagged with their nation and with ``open``; regions are the categories."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    table = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("nation").alias("tag"), F.col("n_nationkey").cast("string").alias("value"), F.col("r_name").alias("category")
    )
    table = table.unionByName(
        spark.range(1).select(
            F.lit("open").alias("tag"), F.lit(None).cast("string").alias("value"), F.lit("OPEN").alias("category")
        )
    )
    nation = F.col("s_nationkey").cast("string")
    places = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("OBJECTID"),
        F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("nation"), nation, F.lit("open"), F.lit("yes")))
        .otherwise(F.create_map(F.lit("nation"), nation))
        .alias("tags"),
    )
    return place_categories(places, table).withColumnRenamed("OBJECTID", "place_id")


QUERIES = {
    "geojson_roundtrip": geojson_roundtrip,
    "geojson_layouts": geojson_layouts,
    "csv_parquet_contents": csv_parquet_contents,
    "overlap_and_holes": overlap_and_holes,
    "overlap_centers": overlap_centers,
    "wkt_roundtrip": wkt_roundtrip,
    "multipart_roundtrip": multipart_roundtrip,
    "load_many_preview": load_many_preview,
    "min_area_rectangle": min_area_rectangle,
    "decompose_edges": decomposed,
    "segment_hits": hits,
    "classify_edges": classified_edges,
    "centers_oneway": centers_oneway,
    "centers_twoway": centers_twoway,
    "crosswalk_centers": crosswalk_centers,
    "direction_oneway": direction_oneway,
    "direction_twoway": direction_twoway,
    "lat_long_flip": lat_long_flip,
    "meters_to_degrees": degrees,
    "lights_within": within,
    "lights_arrays": lights_arrays,
    "center_light_pairs": all_pairs,
    "explode_lights": exploded_lights,
    "centers_without_lights": centers_without_lights,
    "classify_side": classify_side,
    "contrast_heuristic": contrast_heuristic,
    "brightness": perceived_brightness,
    "saved_classified_lights": saved_classified_lights,
    "saved_centers_lights": saved_centers_lights,
    "saved_streetlights": saved_streetlights,
    "tract_density": tract_density,
    "tract_density_parts": parted_density,
    "place_categories": categories_of_places,
    "full_contrast": full_contrast,
    "files_contrast": files_contrast,
}
