import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from shapes import lights, rows_of

from crosslume.functions.geometry import to_wkt
from crosslume.plans import run_files
from crosslume.plans.fixtures import crosswalks, street_segments, streetlights
from crosslume.sources import (
    geometry_as_wkt,
    load_many,
    load_table,
    query_geometry,
    publish,
    query_table,
    read_geojson,
    save_csv,
    save_feature_collection,
    save_geojson,
    save_parquet,
    settle,
    stage,
    with_geometry,
)
from crosslume.sources import publication
from crosslume.sources.json_documents import objects
from crosslume.sources.staging import clear_staged
from crosslume.sources.tables import read_source

SF = "/root/testdata/sf0.001"

FEATURES = [
    {
        "type": "Feature",
        "properties": {"OBJECTID": 1, "name": "a, b", "tags": ["x"], "ok": True, "w": 1.5},
        "geometry": {"type": "Point", "coordinates": [-71.06000049, 42.36]},
    },
    {
        "type": "Feature",
        "properties": {"OBJECTID": 2, "name": None, "tags": None, "ok": False, "w": 2},
        "geometry": {"type": "Point", "coordinates": [0.000012, 1e-7, 9.0]},
    },
    {"type": "Feature", "properties": {"OBJECTID": 3, "name": "c"}, "geometry": None},
]


def write(path, text):
    path.write_text(text)
    return str(path)


def layouts(tmp_path):
    collection = {"type": "FeatureCollection", "features": FEATURES}
    lines = ",\n".join(json.dumps(f) for f in FEATURES)
    return {
        "one_line": write(tmp_path / "one.geojson", json.dumps(collection)),
        "pretty": write(tmp_path / "pretty.geojson", json.dumps(collection, indent=2)),
        "line_per_feature": write(
            tmp_path / "lines.geojson",
            '{\n"type": "FeatureCollection",\n"name": "x",\n"features": [\n' + lines + "\n]\n}\n",
        ),
        "newline_delimited": write(
            tmp_path / "nd.geojson", "\n".join(json.dumps(f) for f in FEATURES)
        ),
    }


def test_every_layout_reads_the_same(spark, tmp_path):
    for name, path in layouts(tmp_path).items():
        df = read_geojson(spark, path, "point")
        types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        assert types == {
            "OBJECTID": "bigint",
            "name": "string",
            "ok": "boolean",
            "tags": "string",
            "w": "double",
            "geometry": "struct<x:double,y:double>",
        }, name
        rows = {r["OBJECTID"]: r for r in df.collect()}
        assert tuple(rows[1]["geometry"]) == (-71.06, 42.36), name
        assert tuple(rows[2]["geometry"]) == (0.000012, 0.0)
        assert rows[3]["geometry"] is None and rows[3]["w"] is None
        assert rows[1]["tags"] == '["x"]' and rows[1]["name"] == "a, b"
        assert df.schema["geometry"].metadata == {"srid": 4326}
    exact = read_geojson(spark, path, "point", decimals=None).where("OBJECTID = 1").first()
    assert tuple(exact["geometry"]) == (-71.06000049, 42.36)


def test_given_schema_and_wrong_geometry(spark, tmp_path):
    path = layouts(tmp_path)["newline_delimited"]
    schema = T.StructType([T.StructField("OBJECTID", T.LongType())])
    assert read_geojson(spark, path, "point", properties=schema).columns == ["OBJECTID", "geometry"]
    with pytest.raises(PySparkException):
        read_geojson(spark, path, "line").collect()
    with pytest.raises(ValueError):
        read_geojson(spark, path, "solid")


def spot(i, **more):
    properties = {"OBJECTID": i, "tags": ["]}", i], **more}
    return {"type": "Feature", "properties": properties, "geometry": {"type": "Point", "coordinates": [i, 0.5]}}


def test_no_feature_is_lost(spark, tmp_path):
    one, two, three, four = (json.dumps(spot(i)) for i in (1, 2, 3, 4))
    head, pretty = '{"type": "FeatureCollection", "features": [', json.dumps(spot(2), indent=1)
    texts = {
        "on_the_head": f"{head}{one},\n{two},\n{three},\n{four}\n]}}",
        "several": f"{one},{two}\n{three}\n\n{four}\n",
        "foot": f'{head}\n{one},{two},\n{three},{four}], "crs": {{"a": [1]}}}}',
        "one_pretty": f"{one}\n{pretty}\n{three}\n{four}",
        "pretty_inside": f"{head}\n{one},\n{pretty},\n{three},\n{four}\n]}}",
    }
    for name, text in texts.items():
        path = write(tmp_path / f"{name}.json", text)
        assert rows_of(read_geojson(spark, path, "point"), "OBJECTID") == [(1,), (2,), (3,), (4,)], name
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.json", f"{one}\n{four}")
    write(folder / "b.json", json.dumps({"type": "FeatureCollection", "features": [spot(3)]}, indent=1))
    write(folder / "c.json", pretty)
    assert rows_of(read_geojson(spark, str(folder), "point"), "OBJECTID") == [(1,), (2,), (3,), (4,)]


def test_bad_records_are_errors(spark, tmp_path):
    one, two = json.dumps(spot(1)), json.dumps(spot(2))
    for i, text in enumerate([f"{one}\n{two[:-9]}\n{one}", f"{one} x", '{"type": "Point"}', f"{one}\n[1]"]):
        path = write(tmp_path / f"bad{i}.json", text)
        with pytest.raises((PySparkException, Py4JJavaError)):
            read_geojson(spark, path, "point").collect()


SQUARES = [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [9, 5], [9, 9], [5, 5]], [[6, 6], [8, 7], [8, 6], [6, 6]]]]
LINES = [[[0, 0], [1, 0]], [[2, 0], [3, 0], [4, 0]]]


def shape(i, kind, coordinates):
    return {"type": "Feature", "properties": {"OBJECTID": i}, "geometry": {"type": kind, "coordinates": coordinates}}


def saved_shapes(folder):
    """The geometries of the features in a folder of part files."""
    files = [f for f in sorted(os.listdir(folder)) if f.startswith("part-")]
    lines = [line for f in files for line in (folder / f).read_text().splitlines()]
    return {f["properties"]["OBJECTID"]: f["geometry"] for f in map(json.loads, lines)}


@pytest.mark.parametrize(
    "kind, single, many, coordinates",
    [
        ("multiline", "LineString", "MultiLineString", LINES),
        ("multipolygon", "Polygon", "MultiPolygon", SQUARES),
        ("multipoint", "Point", "MultiPoint", [[0, 0], [2.5, 1]]),
    ],
)
def test_parts_stay_apart(spark, tmp_path, kind, single, many, coordinates):
    features = [shape(1, many, coordinates), shape(2, single, coordinates[1]), shape(3, many, coordinates[:1])]
    path = write(tmp_path / "parts.json", "\n".join(json.dumps(f) for f in features))
    for own in (kind, "geometry"):
        df = read_geojson(spark, path, own)
        save_geojson(df, str(tmp_path / f"{own}-out"))
        found = saved_shapes(tmp_path / f"{own}-out")
        assert found[1] == {"type": many, "coordinates": coordinates}
        assert found[2] == {"type": single, "coordinates": coordinates[1]}
        again = read_geojson(spark, str(tmp_path / f"{own}-out"), own)
        assert rows_of(geometry_as_wkt(again), "OBJECTID", "geometry") == rows_of(geometry_as_wkt(df), "OBJECTID", "geometry")
        save_csv(df, str(tmp_path / f"{own}-csv"))
        text = spark.read.option("header", True).csv(str(tmp_path / f"{own}-csv"))
        parsed = geometry_as_wkt(with_geometry(text, own))
        assert rows_of(parsed, "geometry") == rows_of(geometry_as_wkt(df), "geometry")
    # Kinds without parts take one part and no more.
    one = kind.removeprefix("multi")
    only = write(tmp_path / "one.json", json.dumps(features[2]))
    assert read_geojson(spark, only, one).count() == 1
    with pytest.raises((PySparkException, Py4JJavaError), match=f"read it as {kind}"):
        read_geojson(spark, path, one).collect()


def test_geometry_of_any_type(spark, tmp_path):
    members = [{"type": "Point", "coordinates": [1, 2]}, {"type": "MultiLineString", "coordinates": LINES}]
    collection = {"type": "GeometryCollection", "geometries": members}
    features = [
        shape(1, "Point", [1, 2]),
        shape(2, "MultiPolygon", SQUARES),
        {"type": "Feature", "properties": {"OBJECTID": 3}, "geometry": collection},
        {"type": "Feature", "properties": {"OBJECTID": 4}, "geometry": None},
    ]
    for indent in (None, 1):
        text = json.dumps({"type": "FeatureCollection", "features": features}, indent=indent)
        df = read_geojson(spark, write(tmp_path / f"any{indent}.json", text), "geometry")
        out = dict(rows_of(geometry_as_wkt(df), "OBJECTID", "geometry"))
        assert out[1] == "POINT (1.000000000 2.000000000)" and out[4] is None
        assert out[2].startswith("MULTIPOLYGON (((0.0") and out[3].startswith("GEOMETRYCOLLECTION (POINT (1.0")
        assert out[3].count("LINESTRING") == 2
    bad = {"type": "GeometryCollection", "geometries": [collection]}
    path = write(tmp_path / "bad.json", json.dumps({"type": "Feature", "properties": {}, "geometry": bad}))
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_geojson(spark, path, "geometry").collect()


def test_staged_tables_are_removed_on_request(spark):
    kept = stage(spark.range(3), "gone")
    assert kept.count() == 3 and clear_staged(spark) > 0 and clear_staged(spark) == 0


def test_single_parts_are_taken_as_parts(spark):
    df = spark.createDataFrame([(1, "POLYGON ((0 0, 1 0, 1 1, 0 0))"), (2, None)], "OBJECTID long, geometry string")
    parsed = with_geometry(df, "polygon")
    parts = with_geometry(parsed, "multipolygon")
    assert rows_of(geometry_as_wkt(parts), "OBJECTID", "geometry") == rows_of(geometry_as_wkt(parsed), "OBJECTID", "geometry")
    with pytest.raises(ValueError):
        with_geometry(parsed, "multiline")


def test_frames_as_source(spark):
    df = spark.createDataFrame([(1, "POINT (1.23456789 2)")], "OBJECTID long, geometry string")
    assert tuple(read_source(spark, df, "point").first()["geometry"]) == (1.234568, 2)
    for bad in (spark.range(1), 5, None):
        with pytest.raises(ValueError):
            read_source(spark, bad, "point")
    with pytest.raises(ValueError):
        with_geometry(spark.range(1), "point")
    with pytest.raises(ValueError):
        with_geometry(spark.range(1).withColumnRenamed("id", "geometry"), "point")


def test_tables_are_loaded_once(spark, tmp_path):
    one = spark.createDataFrame([(1, "POINT (1 2)")], "OBJECTID long, geometry string")
    two = one.union(one)
    load_table(spark, one, "t_once", "point", path=str(tmp_path / "t_once"))
    assert load_table(spark, two, "t_once", "point").count() == 1
    loaded = load_many(spark, [(two, "t_many", "point"), (two, "t_once", "point")], path=str(tmp_path))
    assert loaded["t_many"].count() == 2 and loaded["t_once"].count() == 1


def test_preview_and_query(spark):
    geometry_as_wkt(streetlights(spark, SF)).createOrReplaceTempView("lights_text")
    assert query_table(spark, "lights_text").count() == 10
    assert query_table(spark, "lights_text", "SELECT 1 AS one").collect()[0][0] == 1
    df = query_geometry(spark, "lights_text", "point", "SELECT * FROM lights_text WHERE OBJECTID = 3")
    assert df.schema["geometry"].dataType.simpleString() == "struct<x:double,y:double>"
    with pytest.raises(ValueError):
        query_geometry(spark, "lights_text", "point", "SELECT OBJECTID FROM lights_text")


def test_sinks(spark, tmp_path):
    df = lights(spark, [(1, (1.5, 2.0)), (2, None)]).withColumn("ids", F.array(F.lit(1), F.lit(2)))
    save_parquet(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).orderBy("OBJECTID").collect()
    assert back[0]["geometry"] == "POINT (1.500000000 2.000000000)" and back[0]["ids"] == [1, 2]
    assert back[1]["geometry"] is None
    save_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("OBJECTID").collect()
    assert back[0]["ids"] == "[1,2]" and back[0]["geometry"].startswith("POINT (1.5")
    save_geojson(df, str(tmp_path / "g"))
    again = read_geojson(spark, str(tmp_path / "g"), "point")
    assert rows_of(again.where("OBJECTID = 1"), "geometry.x", "geometry.y") == [(1.5, 2.0)]
    assert again.where("geometry IS NULL").count() == 1
    with pytest.raises(ValueError):
        save_geojson(df.drop("geometry"), str(tmp_path / "x"))


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(5), "five")
    assert df.count() == 5
    folder = spark.conf.get("spark.checkpoint.dir")
    assert any(name.startswith("crosslume-five-") for name in os.listdir(folder))
    assert "Range" not in df._jdf.queryExecution().toString()


def test_files_to_result_sets(spark, tmp_path):
    paths = {}
    for name, df in {
        "crosswalks": crosswalks(spark, SF),
        "lights": streetlights(spark, SF),
        "streets": street_segments(spark, SF),
    }.items():
        paths[name] = str(tmp_path / name)
        save_geojson(df, paths[name])
    # Nine decimals, as six would move the arterials.
    out = str(tmp_path / "out")
    results = run_files(
        spark, paths["crosswalks"], paths["lights"], paths["streets"], out, decimals=9
    )
    saved = {n: spark.read.parquet(str(tmp_path / "out" / f"{n}.parquet")) for n in
             ("crosswalk_centers_contrast", "crosswalk_centers_lights", "streetlights")}
    assert saved["crosswalk_centers_contrast"].columns == [
        "crosswalk_id", "center_id", "to_contrast_heuristic", "from_contrast_heuristic",
        "to_brightness_heuristic", "from_brightness_heuristic", "contrast_heuristic", "light_heuristic",
    ]
    assert saved["crosswalk_centers_contrast"].count() == 297
    assert dict(saved["crosswalk_centers_lights"].dtypes)["streetlight_id"] == "bigint"
    assert dict(saved["crosswalk_centers_lights"].dtypes)["streetlight_dist"] == "float"
    assert saved["crosswalk_centers_lights"].where("streetlight_id IS NOT NULL").count() == 2016
    assert saved["streetlights"].first()["geometry_lat_long"].startswith("POINT (42.3")
    classified = spark.read.option("header", True).csv(str(tmp_path / "out" / "classified_streetlights.csv"))
    assert classified.count() == results.center_light_pairs.count() == 2016
    line = classified.first()
    assert line["line_geom"].startswith("LINESTRING (") and line["side"] in ("to", "from")
    text = results.crosswalk_centers.select(to_wkt(F.col("geometry"))).first()[0]
    assert text.startswith("POINT (-71.0")


NASTY = ["a}b", '{"x', "\\", '"q"', "[", "]", '"features":[', "é}\n", '\\"}', {"features": [{"b}": 1}]}, [[{}]], None, 1.5]


@pytest.fixture
def tiny_splits(spark):
    """Files are read in splits of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def test_documents_are_cut_into_objects_whatever_the_splits(spark, tmp_path, tiny_splits):
    features = [{"type": "Feature", "id": i, "properties": {"p": NASTY[i % len(NASTY)], "q": i}} for i in range(29)]
    around = {
        "crs": {"type": "name", "properties": {"n": "x}", "features": 3}},
        "other": [{"a": 1}, {}],
        "features": features,
        "tail": {"a": [{}]},
        "more": [{"b": 2}],
    }
    empty = {**around, "features": []}
    texts = {
        "line": (json.dumps({"features": features}), features),
        "pretty": (json.dumps(around, indent=2), features),
        "loose": ("\n".join(json.dumps(f, indent=1) for f in features) + "\n", features),
        "two": (json.dumps(around) + "\n" + json.dumps(empty, indent=1) + "\n" + json.dumps({"features": features[:3]}) + "\n \n", features + features[:3]),
        "empty": ("﻿" + json.dumps(empty, indent=1), []),
    }
    for name, (text, want) in texts.items():
        path = write(tmp_path / f"{name}.json", text)
        assert spark.read.text(path, lineSep="}").rdd.getNumPartitions() > 2, name
        found = [json.loads(r["text"]) for r in objects(spark, [path]).collect()]
        assert sorted(found, key=str) == sorted(want, key=str), name
    every = [str(tmp_path / f"{name}.json") for name in texts]
    assert objects(spark, every).count() == sum(len(want) for _, want in texts.values())


def test_what_is_no_whole_object_is_an_error(spark, tmp_path, tiny_splits):
    one = json.dumps({"type": "Feature", "properties": {"a": "x" * 300}})
    for i, text in enumerate([one[:-1], one + "x", one + "\n[1]", "[" + one + "]", '{"features": [' + one, one + '\n{"a": "']):
        with pytest.raises((PySparkException, Py4JJavaError)):
            objects(spark, [write(tmp_path / f"no{i}.json", text)]).collect()
    assert objects(spark, [write(tmp_path / "blank.json", " \n")]).count() == 0


def test_one_collection(spark, tmp_path):
    df = lights(spark, [(i, (i * 0.5, 2.0)) for i in range(50)]).repartition(7)
    path = tmp_path / "all.geojson"
    for rows in (df, df.where("OBJECTID < 3"), df.where("false")):  # each replaces the one before
        save_feature_collection(rows, str(path))
        document = json.loads(path.read_text())
        assert document["type"] == "FeatureCollection" and len(document["features"]) == rows.count()
        assert rows_of(read_geojson(spark, str(path), "point").select("*"), "geometry.x") == rows_of(rows, "geometry.x") if rows.count() else True
    bad = df.withColumn("x", F.when(F.col("OBJECTID") == 30, F.raise_error(F.lit("no"))).otherwise("y"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        save_feature_collection(bad, str(tmp_path / "bad.geojson"))
    assert not [n for n in os.listdir(tmp_path) if n.startswith("bad")]


def test_results_appear_together(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")

    def table(n):
        return lambda path: spark.range(n).write.parquet(path)

    def counts():
        settle(spark, folder)
        return [spark.read.parquet(f"{folder}/{name}").count() for name in ("a", "b", "c")]

    publish(spark, folder, {name: table(1) for name in ("a", "b", "c")})
    (tmp_path / "out" / "other.txt").write_text("stays")
    assert counts() == [1, 1, 1]
    bad = spark.range(2).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        publish(spark, folder, {"a": table(2), "b": table(2), "c": lambda path: bad.write.parquet(path)})
    assert counts() == [1, 1, 1] and set(os.listdir(folder)) - {"other.txt"} == {"a", "b", "c"}
    # Interrupted in the middle of the moves, the publication is ended by whoever reads next.
    move, moves = publication._Files.move, []

    def failing(self, source, target):
        moves.append(source)
        if len(moves) == 5:
            raise OSError("lost")
        move(self, source, target)

    monkeypatch.setattr(publication._Files, "move", failing)
    with pytest.raises(OSError, match="lost"):
        publish(spark, folder, {name: table(3) for name in ("a", "b", "c")})
    monkeypatch.undo()
    assert counts() == [3, 3, 3] and set(os.listdir(folder)) - {"other.txt"} == {"a", "b", "c"}
    assert (tmp_path / "out" / "other.txt").read_text() == "stays"


def test_what_is_staged_is_not_staged_again(spark):
    once = stage(spark.range(3), "once")
    assert stage(once, "twice") is once
    some = once.where("id > 0")
    assert stage(some, "some") is not some and stage(some, "some").count() == 2
