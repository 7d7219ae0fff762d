"""JSON objects out of large documents, by many tasks.

The text source cuts a file at every ``}``, in as many splits as the file has. Whether a place lies inside a string,
and how deep, depends on all text before it; but what a stretch of text does to that state can be told without
knowing it: it turns "inside a string" over once for each quote, and changes the depth by one number if it
began outside a string and by another if it began inside. So every split sums up what it does for
either beginning, the sums of the splits (one row each) are added up in order, and then every piece
knows its own state. The same is done once more to number the objects, as an object may begin in one
split and end in another. All steps are window functions within a split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslume.sources.staging import stage

_END = "}"
_SPLIT = ["file", "block"]


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _deeper(text: Column) -> Column:
    """How much deeper text goes that begins outside a string."""
    bare = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return _count(bare, "{[") - _count(bare, "]}")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\.", "")


def _before(*order: str) -> Window:
    return Window.partitionBy(*_SPLIT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _so_far(value: Column, window: Window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0).cast("long"))


def _pick(state: Column, if_true: str, if_false: str) -> Column:
    return F.when(state, F.col(if_true)).otherwise(F.col(if_false))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pieces up to each ``}`` with what they do to the state, and what comes before them in their split."""
    read = spark.read.text(paths, lineSep=_END).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
    )
    bare = read.withColumn("bare", _unescaped(F.col("value")))
    begun_inside = F.regexp_replace("bare", r'^[^"]*("|$)', "")
    # The brace that ends a piece counts where it lies outside a string.
    bare = bare.withColumn("quotes", _count(F.col("bare"), '"').cast("long"))
    bare = bare.withColumns(
        {
            "out": (_deeper(F.col("bare")) - (F.col("quotes") % 2 == 0).cast("int")).cast("long"),
            "in": (_deeper(begun_inside) - (F.col("quotes") % 2 == 1).cast("int")).cast("long"),
        }
    ).drop("bare")
    before = _before("at")
    seen = bare.withColumn("odd", _so_far(F.col("quotes"), before) % 2 == 1)
    # "a": if the split begins outside a string, "b": if inside.
    seen = seen.withColumns({"a": _pick(F.col("odd"), "in", "out"), "b": _pick(F.col("odd"), "out", "in")})
    return seen.withColumns({"depth_a": _so_far(F.col("a"), before), "depth_b": _so_far(F.col("b"), before)})


def _in_order(splits: DataFrame, value: Column) -> Column:
    """Sum of ``value`` over the earlier splits of a file; there is one row for each split."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0).cast("long"))


def _with_depth(pieces: DataFrame) -> DataFrame:
    """Adds ``inside`` (a piece begins inside a string) and its depth at begin and end."""
    sums = pieces.groupBy(*_SPLIT).agg(F.sum("quotes").alias("n"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))
    sums = sums.withColumn("begun", _in_order(sums, F.col("n")) % 2 == 1)
    sums = sums.withColumn("base", _in_order(sums, _pick(F.col("begun"), "sum_b", "sum_a")))
    known = pieces.join(sums.select(*_SPLIT, "begun", "base"), _SPLIT)
    known = known.withColumns(
        {
            "inside": F.col("odd") != F.col("begun"),
            "depth": F.col("base") + _pick(F.col("begun"), "depth_b", "depth_a"),
            "change": _pick(F.col("begun"), "b", "a"),
        }
    )
    known = known.withColumn("ended_inside", F.col("inside") != (F.col("quotes") % 2 == 1))
    return known.select(*_SPLIT, "at", "value", "inside", "depth", (F.col("depth") + F.col("change")).alias("end"), "ended_inside")


def objects(spark: SparkSession, paths: list[str], member: str = "features") -> DataFrame:
    """(file, text) of every object in the files.

    An object is an element of the list ``member`` of a top-level object, or else a top-level object itself. What
    else stands in the head or foot of a list's owner is left out. Text that is no whole object is an error.
    """
    pieces = _with_depth(stage(_pieces(spark, paths), "json-pieces"))
    opening = rf'(?s)^(.*?)"{member}"\s*:\s*\['
    head = _unescaped(F.regexp_extract("value", opening, 1))
    opens = (
        ~F.col("inside")
        & (F.col("depth") <= 2)  # at 2 where another list ends first
        & F.col("value").rlike(opening)
        & (F.col("depth") + _deeper(head) == 1)
        & (_count(head, '"') % 2 == 0)
    )
    closes = ~F.col("inside") & (F.col("depth") == 2) & F.col("value").rlike(r"^\s*\]")
    # Whether a piece ends within the list is told by the last event before its end.
    filled = opens & ~F.col("value").rlike(opening + r"\s*\]")
    known = pieces.withColumn("opens", opens).withColumn("event", F.when(filled, True).when(opens | closes, False))
    upto = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("within", F.last("event", ignorenulls=True).over(upto))
    top = ~F.col("ended_inside") & (F.col("end") == 0)
    element = ~F.col("ended_inside") & (F.col("end") == 2)
    # "a": if the split begins outside the list, "b": if within.
    known = known.withColumns(
        {
            "a": (top | (element & F.coalesce("within", F.lit(False)))).cast("long"),
            "b": (top | (element & F.coalesce("within", F.lit(True)))).cast("long"),
        }
    )
    before = _before("at")
    known = known.withColumns({"ends_a": _so_far(F.col("a"), before), "ends_b": _so_far(F.col("b"), before)})
    known = stage(known, "json-states")
    sums = known.groupBy(*_SPLIT).agg(
        F.max_by("within", F.when(F.col("within").isNotNull(), F.col("at"))).alias("last"),
        F.sum("a").alias("sum_a"),
        F.sum("b").alias("sum_b"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("begun", F.coalesce(F.last("last", ignorenulls=True).over(earlier), F.lit(False)))
    sums = sums.withColumn("base", _in_order(sums, _pick(F.col("begun"), "sum_b", "sum_a")))
    placed = known.join(sums.select(*_SPLIT, "begun", "base"), _SPLIT)
    placed = placed.select(
        "file",
        (F.col("base") + _pick(F.col("begun"), "ends_b", "ends_a")).alias("number"),
        F.struct(
            "block",
            "at",
            "depth",
            "opens",
            F.coalesce("within", "begun").alias("within"),
            (_pick(F.col("begun"), "b", "a") > 0).alias("ends"),
            F.when(F.col("opens"), F.regexp_replace("value", opening, "")).otherwise(F.col("value")).alias("text"),
        ).alias("p"),
    )
    # The pieces of one object, at most with the head or foot of its list.
    each = placed.groupBy("file", "number").agg(F.array_sort(F.collect_list("p")).alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    listed = F.filter("p", lambda x: x["within"])
    whole = F.concat(F.array_join("p.text", _END), F.lit(_END))
    text = (
        F.when(~last["ends"], F.when(F.array_join("p.text", "").rlike(r"^\s*$"), None).otherwise(
            F.raise_error(F.concat(F.lit("not a whole JSON object: "), F.substring(whole, 1, 200)))
        ))
        .when(last["within"] & (F.size(listed) > 0) & ~_foot(last), F.concat(F.array_join(listed["text"], _END), F.lit(_END)))
        .when((first["depth"] == 0) & ~F.exists("p", lambda x: x["opens"]), whole)
    )
    found = each.select("file", F.regexp_replace(text, r"^[\s,]+", "").alias("text")).where(F.col("text").isNotNull())
    # A file has to end outside of everything; blanks may follow.
    blank = (F.col("depth") == 0) & F.col("value").rlike(r"^\s*$")
    final = known.groupBy("file").agg(F.max_by((F.col("end") == 0) | blank, F.struct("block", "at")).alias("closed"))
    cut_off = F.raise_error(F.concat(F.lit("the JSON text is cut off: "), F.col("file"))).cast("string")
    return found.unionByName(final.where(~F.col("closed")).select("file", cut_off.alias("text")))


def _foot(piece: Column) -> Column:
    """Whether a piece within the list closes it right away."""
    return piece["text"].rlike(r"^\s*\]")
