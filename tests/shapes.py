"""Small hand-made tables, and helpers."""

import contextlib
import io
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslume.functions.geometry import LINE, POINT, POLYGON

EDGE = T.StructType(
    [
        T.StructField("crosswalk_id", T.LongType()),
        T.StructField("ring_id", T.LongType()),
        T.StructField("edge_id", T.LongType()),
        T.StructField("geometry", LINE),
    ]
)


def reals(points):
    return [(float(x), float(y)) for x, y in points]


def polygons(spark, rings_by_id):
    schema = T.StructType([T.StructField("OBJECTID", T.LongType()), T.StructField("geometry", POLYGON)])
    return spark.createDataFrame([(i, [reals(r) for r in rings]) for i, rings in rings_by_id], schema)


def streets(spark, rows):
    schema = T.StructType(
        [
            T.StructField("OBJECTID", T.LongType()),
            T.StructField("ONEWAY", T.StringType()),
            T.StructField("geometry", LINE),
        ]
    )
    return spark.createDataFrame(rows, schema)


def lights(spark, rows):
    schema = T.StructType([T.StructField("OBJECTID", T.LongType()), T.StructField("geometry", POINT)])
    return spark.createDataFrame(rows, schema)


def edges(spark, rows):
    return spark.createDataFrame([(i, 1, j, line) for i, j, line in rows], EDGE)


def square(x, y, w, h):
    """Closed ring of a box around (x, y)."""
    return [(x - w, y - h), (x + w, y - h), (x + w, y + h), (x - w, y + h), (x - w, y - h)]


def rows_of(df, *columns):
    """Sorted tuples."""
    return sorted(tuple(r) for r in df.select(*columns).collect())


def xy(df, column):
    return df.withColumns({"x": F.col(column)["x"], "y": F.col(column)["y"]})


def largest_method(spark, df):
    """Bytes of the largest method Spark generates for a plan; the JIT skips those above 8000."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))
