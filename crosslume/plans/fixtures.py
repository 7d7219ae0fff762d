"""Crosswalks, streets and lights laid out by arithmetic over the part, supplier and orders tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslume.functions.geometry import point

# Origin and spacing of the layout, in degrees.
LON0, LAT0, STEP = -71.06, 42.36, 0.0004
# Rows of 100 crosswalks; beyond so many rows (16 degrees) the layout goes on further east.
ROWS, BLOCK = 40_000, 0.05
RING = [(-6e-5, -2e-5), (6e-5, -2e-5), (6e-5, 2e-5), (0.0, 1e-5), (-6e-5, 2e-5), (-6e-5, -2e-5)]


# Geometries with parts, by the remainder of a key by 4: parts of rings or lines, in thousandths of a degree. Holes run
# with their outer ring or against it.
_SQUARE = [(0, 0), (8, 0), (8, 4), (0, 4), (0, 0)]
_OTHER = [(10, 0), (14, 0), (14, 4), (10, 4), (10, 0)]
_HOLE = [(3, 2), (5, 2), (5, 3), (3, 3), (3, 2)]
_HOLE2 = [(11, 1), (11, 2), (12, 2), (12, 1), (11, 1)]
PARTED_POLYGONS = [
    [[_SQUARE, _HOLE[::-1]], [_OTHER]],
    [[_OTHER, _HOLE2, _HOLE2[::-1]], [_SQUARE[::-1], _HOLE]],
    [[_SQUARE, _HOLE]],
    [[_SQUARE], [_OTHER[::-1]], [[(0, 6), (2, 6), (1, 8), (0, 6)]]],
]
PARTED_LINES = [
    [[(0, 0), (1, 0)], [(2, 0), (3, 0), (4, 1)]],
    [[(0, 0), (1, 2), (3, 3)]],
    [[(5, 5), (6, 6)], [(0, 0), (1, 0)], [(6, 6), (7, 5), (8, 6)]],
    [[(0, 0), (0, 1)], [(0, 1), (0, 2)]],
]


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt out to all cores.

    A table is one small file, whose row groups hold a million rows, and what is made of a row takes far longer than to
    read it. A scan that has splits for all cores already stays as it is.
    """
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _div(value: Column, by: int) -> Column:
    return F.floor(value / by)


def _east(row: Column) -> Column:
    """Longitude of the west end of a row."""
    return LON0 + _div(row, ROWS) * F.lit(BLOCK)


def _north(row: Column) -> Column:
    return LAT0 + row % ROWS * F.lit(STEP)


def _frame(u: Column, v: Column) -> Column:
    """Local (u, v) of a part's crosswalk as a point."""
    turn = F.col("p_size") % 4
    cs = F.when(turn == 0, 1.0).when(turn == 1, 0.8).when(turn == 2, 0.6).otherwise(0.0)
    sn = F.when(turn == 0, 0.0).when(turn == 1, 0.6).when(turn == 2, 0.8).otherwise(1.0)
    row = _div(F.col("p_partkey"), 100)
    ox = _east(row) + (F.col("p_partkey") % 100) * F.lit(STEP)
    oy = _north(row)
    return point(ox + u * cs - v * sn, oy + u * sn + v * cs)


def crosswalks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[_frame(F.lit(u), F.lit(v)) for u, v in RING])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("OBJECTID"), F.array(ring).alias("geometry")
    )


def street_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One in eleven passes its crosswalk by.
    aside = F.when(F.col("p_partkey") % 11 == 0, 1.8e-4).otherwise(0.0)
    a = (F.col("p_partkey") % 7 - 3) * F.lit(5e-6) + aside
    line = F.array(
        _frame(a, F.lit(-1.6e-4)), _frame(a, F.lit(-1e-4)), _frame(a + F.lit(2e-5), F.lit(1.6e-4))
    )
    code = F.col("p_size") % 5
    local = (
        table(spark, sf_dir, "part")
        .select(
            F.col("p_partkey").alias("OBJECTID"),
            F.when(code <= 1, "FT").when(code == 2, "TF").when(code == 3, "B").alias("ONEWAY"),
            line.alias("geometry"),
        )
    )
    # One in four crosses the crosswalks of its row, the others run between two rows.
    key = F.col("s_suppkey")
    y = _north(key) + F.when(key % 4 == 1, 0.0000037).otherwise(0.0002037)
    west = _east(key)
    arterials = table(spark, sf_dir, "supplier").select(
        (key + 1_000_000_000).alias("OBJECTID"),
        F.lit(None).cast("string").alias("ONEWAY"),
        F.array(point(west - F.lit(0.0003), y), point(west + F.lit(0.0399), y)).alias("geometry"),
    )
    return local.unionByName(arterials)


def streetlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    row = _div(F.col("o_custkey"), 100)
    x = _east(row) + (F.col("o_custkey") % 100) * F.lit(STEP) + ((key * 37) % 41 - 20) * F.lit(1e-5)
    y = _north(row) + ((key * 53) % 37 - 18) * F.lit(1e-5)
    return table(spark, sf_dir, "orders").select(
        key.alias("OBJECTID"), point(x, y).alias("geometry")
    )


def _corner(u: float, v: float) -> Column:
    """A point in thousandths of a degree from the place of a part."""
    key = F.col("p_partkey")
    east, north = key % 1000 * F.lit(0.02), F.floor(key / 1000) % 2000 * F.lit(0.02)
    return point(east + F.lit(u / 1000), north + F.lit(v / 1000))


def _by_key(spark: SparkSession, sf_dir: str, field: str, shapes: list, depth: int) -> DataFrame:
    def shape(x, level: int) -> Column:
        return _corner(*x) if not level else F.array(*[shape(y, level - 1) for y in x])

    kind = F.col("p_partkey") % 4
    chosen = F.coalesce(*[F.when(kind == i, shape(own, depth)) for i, own in enumerate(shapes)])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("OBJECTID"), F.struct(chosen.alias(field)).alias("geometry")
    )


def parted_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of one to three parts, some with holes."""
    return _by_key(spark, sf_dir, "polygons", PARTED_POLYGONS, 3)


def parted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(spark, sf_dir, "lines", PARTED_LINES, 2)
