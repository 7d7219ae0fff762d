from crosslume.sources.geojson import read_geojson
from crosslume.sources.publication import publish, settle
from crosslume.sources.sinks import geometry_as_wkt, save_csv, save_feature_collection, save_geojson, save_parquet
from crosslume.sources.staging import stage, stage_dir
from crosslume.sources.tables import load_many, load_table, query_geometry, query_table, with_geometry

__all__ = [
    "geometry_as_wkt",
    "load_many",
    "load_table",
    "publish",
    "query_geometry",
    "query_table",
    "read_geojson",
    "save_csv",
    "save_feature_collection",
    "save_geojson",
    "save_parquet",
    "settle",
    "stage",
    "stage_dir",
    "with_geometry",
]
