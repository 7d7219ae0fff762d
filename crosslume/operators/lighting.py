"""Lights around a center: lists, side and angle, contrast and brightness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslume.functions.geodesy import flip_lat_long
from crosslume.functions.geometry import make_line, midpoint, point_n, to_wkt
from crosslume.operators.skew import HOT_ROWS, crowded_keys, key_counts, split_join
from crosslume.operators.spatial_join import CENTER_KEY

# All of a center that classifying its lights takes; pairs carry no more than this.
SIDE_COLUMNS = (*CENTER_KEY, "geometry", "from_coord", "to_coord", "a_to_b")

# A list has at most this many lights; a center with more has several.
LIST_ROWS = 100_000

# The names of the five classes of contrast.
NO_CONTRAST = "no contrast"
WEAK_POSITIVE = "weak positive contrast"
WEAK_NEGATIVE = "weak negative contrast"
STRONG_POSITIVE = "strong positive contrast"
STRONG_NEGATIVE = "strong negative contrast"


def with_lat_long(df: DataFrame) -> DataFrame:
    """Add geometry_lat_long, the point's text with latitude first."""
    return df.withColumn("geometry_lat_long", to_wkt(flip_lat_long(F.col("geometry"))))


# ---------------------------------------------------------------- lists


def center_light_pairs(centers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Centers with the id and distance of a light near them, one row for each light.

    A center without lights has one row, with NULL for both.
    """
    key = list(CENTER_KEY)
    lights = pairs.select(*key, "streetlight_id", F.col("dist").alias("streetlight_dist"))
    if crowded_keys(lights, key) is None:
        return centers.join(lights, key, "left").select(*centers.columns, "streetlight_id", "streetlight_dist")
    lit = split_join(lights, centers, key, split_left=["streetlight_id"])
    unlit = centers.join(lights.select(*key).distinct(), key, "left_anti")
    return lit.select(*centers.columns, "streetlight_id", "streetlight_dist").unionByName(
        unlit, allowMissingColumns=True
    )


def light_lists(
    centers: DataFrame, pairs: DataFrame, *, list_rows: int = LIST_ROWS
) -> DataFrame:
    """Centers with aligned lists of light ids and distances, in the order of the ids.

    Centers without lights keep NULL lists. No list is longer than ``list_rows``: a center with more lights
    has several rows, told apart by list_part, that hold all of them. ``center_light_pairs`` is the form
    whose rows do not depend on that.
    """
    key = list(CENTER_KEY)
    lights = pairs.select(*key, "streetlight_id", "dist")
    if crowded_keys(lights, key, list_rows) is None:
        dealt = lights.withColumn("list_part", F.lit(0).cast("long"))
    else:
        ways = key_counts(lights, key).withColumn("ways", F.ceil(F.col("n") / list_rows)).drop("n")
        # Lights are dealt to as many shares as lists are needed; a share that comes out too long is cut again.
        shares = lights.join(ways, key).withColumn(
            "share", F.pmod(F.xxhash64("streetlight_id"), F.col("ways")).cast("long")
        )
        order = Window.partitionBy(*key, "share").orderBy("streetlight_id")
        dealt = shares.withColumn("again", F.floor((F.row_number().over(order) - 1) / list_rows)).withColumn(
            "list_part", F.col("share") + F.col("ways") * F.col("again")
        )
    parts = dealt.groupBy(*key, "list_part").agg(
        F.array_sort(F.collect_list(F.struct("streetlight_id", "dist"))).alias("lights")
    )
    return (
        centers.join(parts, key, "left")
        .withColumn("streetlight_id", F.col("lights.streetlight_id"))
        .withColumn("streetlight_dist", F.col("lights.dist"))
        .withColumn("list_part", F.coalesce("list_part", F.lit(0)).cast("int"))
        .drop("lights")
    )


def explode_lights(
    centers_lights: DataFrame, streetlights: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """One row per center and listed light; with ``streetlights`` also the light's point.

    NULL lists give no row. ``pairs`` are the staged pairs the lists were made from, if at hand: lights are counted in them.
    """
    rest = [c for c in centers_lights.columns if c not in ("streetlight_id", "streetlight_dist")]
    listed = centers_lights.select(
        *rest, F.inline(F.arrays_zip("streetlight_id", "streetlight_dist"))
    ).withColumnRenamed("streetlight_dist", "dist")
    if streetlights is None:
        return listed
    points = streetlights.select(
        F.col("OBJECTID").cast("long").alias("streetlight_id"), F.col("geometry").alias("light")
    )
    # One light may stand near very many centers.
    return split_join(
        listed,
        points,
        ["streetlight_id"],
        split_left=[c for c in CENTER_KEY if c in rest] or rest,
        # Without pairs counted within the join: what lies before the lists is then shuffled once for both.
        left_counts=key_counts(listed, ["streetlight_id"]) if pairs is None else None,
        left_rows=pairs,
        hint=None if pairs is None else "merge",
    )


def lookup_distance(ids: Column, dists: Column, light_id: Column) -> Column:
    """Distance of one light in a center's aligned lists, NULL when it is not listed."""
    return F.try_element_at(dists, F.nullif(F.array_position(ids, light_id), F.lit(0)).cast("int"))


# ---------------------------------------------------------------- side and angle


def crosswalk_axes(centers: DataFrame) -> DataFrame:
    """Axis from A to B of every crosswalk.

    B of a one-way crosswalk is the middle of its pedestrian edge. Of several candidates the last in
    the order of their text is taken.
    """

    def last(condition: Column, p: Column) -> Column:
        return F.max(F.when(condition & p.isNotNull(), F.struct(to_wkt(p).alias("text"), p.alias("p"))))

    edge_middle = midpoint(point_n(F.col("ped_edge_geom"), 1), point_n(F.col("ped_edge_geom"), 2))
    is_b = F.coalesce(F.col("center_id") == "B", F.lit(False))
    b = F.when(is_b, F.col("geometry")).when(F.col("is_oneway"), edge_middle)
    return (
        centers.where(F.col("center_id").isNotNull() | F.col("is_oneway"))
        .groupBy("crosswalk_id")
        .agg(
            last(F.col("center_id") == "A", F.col("geometry"))["p"].alias("a"),
            last(F.lit(True), b)["p"].alias("b"),
        )
        .select("crosswalk_id", make_line(F.col("a"), F.col("b")).alias("a_to_b"))
    )


def with_axes(
    centers: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Centers with the axis of their crosswalk."""
    return split_join(
        centers,
        crosswalk_axes(centers),
        ["crosswalk_id"],
        split_left=["street_segment_id", "center_id"],
        hot_rows=hot_rows,
        # As many axes as crosswalks, however small Spark takes them for: they must not go through the driver.
        hint="merge",
    )


def _vector(line: Column) -> tuple[Column, Column]:
    p, q = point_n(line, 1), point_n(line, 2)
    return q["x"] - p["x"], q["y"] - p["y"]


def classify_sides(pairs: DataFrame) -> DataFrame:
    """Side, angle and sine of every (center, light) pair, without a shuffle.

    ``pairs`` carries geometry, from_coord, to_coord, a_to_b, light and dist. A light is on the 'to'
    side when it lies on the same side of the axis as the direction of travel, else on 'from'.
    """
    ab_x, ab_y = _vector(F.col("a_to_b"))
    ft_x, ft_y = _vector(make_line(F.col("from_coord"), F.col("to_coord")))
    cl_x, cl_y = F.col("light.x") - F.col("geometry.x"), F.col("light.y") - F.col("geometry.y")
    same = F.signum(ab_x * ft_y - ab_y * ft_x) == F.signum(ab_x * cl_y - ab_y * cl_x)
    angle = F.atan2(cl_x * ab_y - cl_y * ab_x, cl_x * ab_x + cl_y * ab_y)
    return (
        pairs.withColumn("angle_rad", angle)
        .withColumn("side", F.when(same, "to").otherwise("from"))
        .select(
            *CENTER_KEY,
            "streetlight_id",
            make_line(F.col("geometry"), F.col("light")).alias("line_geom"),
            F.col("light").alias("geometry"),
            "side",
            "angle_rad",
            F.abs(F.sin("angle_rad")).alias("abs_sin_angle"),
            "a_to_b",
            "dist",
        )
    )


# ---------------------------------------------------------------- scores


def contrast_label(to_side: Column, from_side: Column, threshold: float) -> Column:
    """Contrast in five classes; the limits are lower when one side has no light at all."""
    diff = F.abs(from_side - to_side)
    dark_side = (to_side == 0) | (from_side == 0)
    none = F.when(dark_side, F.lit(threshold / 2)).otherwise(F.lit(threshold * 3 / 4))
    weak = F.when(dark_side, F.lit(threshold * 3 / 4)).otherwise(F.lit(float(threshold)))
    brighter = from_side > to_side
    return (
        F.when(diff <= none, NO_CONTRAST)
        .when((diff <= weak) & brighter, WEAK_POSITIVE)
        .when(diff <= weak, WEAK_NEGATIVE)
        .when(brighter, STRONG_POSITIVE)
        .otherwise(STRONG_NEGATIVE)
    )


def contrast_heuristics(
    classified: DataFrame,
    centers: DataFrame,
    threshold: float,
    *,
    keep_geometry: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Contrast and brightness of both sides per (crosswalk, center), 0 where no light is near.

    Distances are 32-bit floats, and so are their squares and inverse squares. A light at distance 0
    gives the values of IEEE division: infinite brightness, NaN contrast.
    """
    square = F.col("dist") * F.col("dist")
    sine = F.col("abs_sin_angle")
    glare = (
        F.when(square != 0, sine / F.nullif(square, F.lit(0.0)))
        .when(sine == 0, F.lit(float("nan")))
        .when(sine > 0, F.lit(float("inf")))
    )
    light = (
        F.when(square != 0, 1.0 / F.nullif(square, F.lit(0.0)))
        .when(square == 0, F.lit(float("inf")))
        .cast("float")
        .cast("double")
    )

    def side_sum(side: str, value: Column) -> Column:
        return F.sum(F.when(F.col("side") == side, value).otherwise(F.lit(0.0)))

    sums = {
        "to_contrast_heuristic": side_sum("to", glare),
        "from_contrast_heuristic": side_sum("from", glare),
        "to_brightness_heuristic": side_sum("to", light),
        "from_brightness_heuristic": side_sum("from", light),
    }
    raw = classified.groupBy("crosswalk_id", "center_id").agg(
        *[value.alias(name) for name, value in sums.items()]
    )
    every = centers.select("crosswalk_id", "center_id", "geometry").distinct()
    # A one-way crosswalk has as many rows here as it meets streets.
    scored = split_join(
        every,
        raw,
        ["crosswalk_id", "center_id"],
        "left",
        split_left=["geometry"],
        left_rows=centers,  # one or more for each row
        hot_rows=hot_rows,
    )
    return scored.select(
        "crosswalk_id",
        "center_id",
        *(["geometry"] if keep_geometry else []),
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in sums],
    ).withColumn(
        "contrast_heuristic",
        contrast_label(
            F.col("to_contrast_heuristic"), F.col("from_contrast_heuristic"), float(threshold)
        ),
    )


def brightness(contrast: DataFrame) -> DataFrame:
    """Add light_heuristic, the brightness of both sides together."""
    total = F.col("from_brightness_heuristic") + F.col("to_brightness_heuristic")
    return contrast.withColumn("light_heuristic", total.cast("float"))
