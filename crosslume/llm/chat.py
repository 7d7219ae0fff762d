"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A turn is written ``<|role|>text</s>``. In roles and texts a backslash is doubled and one is put after the first
sign of every control string, so no control string is left inside, and dropping backslashes restores
the text. An example is the conversation up to and with one assistant turn, and only that reply is
trained on (``loss_start``, ``loss_length`` in code points). All are expressions of Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as a control string in texts.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>"]

_STARTS = "(?s)(?=" + "|".join("\\Q" + c + "\\E" for c in CONTROL) + ")(.)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _STARTS, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row for each turn of ``trained_role``, and one for turns that no such turn follows.

    ``conv_id``, ``target`` (place of the reply, from 0; NULL for the latter, which trains on nothing), ``last``
    (it holds the whole conversation), ``text``, ``loss_start``, ``loss_length``. Rows of a conversation are
    ordered by turn, then role and text, so repeated turns stay in a defined order; null roles and
    texts are empty; rows without conv_id are one conversation; other columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    rows = conversations.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("part", F.concat("head", "body", F.lit("</s>")))
    stop = F.sum(F.char_length("part")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turns = rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("place"),
        (F.col("role") == trained_role).alias("trained"),
        "part",
        stop.alias("stop"),
        F.char_length("body").cast("long").alias("size"),
    )
    talk = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "trained", "part", "stop", "size"))).alias("turns"))
    talk = talk.select("conv_id", "turns", F.array_join("turns.part", "").alias("whole"), F.size("turns").alias("n"))
    ends = F.filter("turns", lambda t: t["trained"] | (t["place"] == F.col("n") - 1))
    ends = F.transform(
        ends, lambda t: F.struct(t["place"].alias("place"), t["trained"].alias("trained"), t["stop"].alias("stop"), t["size"].alias("size"))
    )
    each = talk.select("conv_id", "whole", "n", F.explode(ends).alias("t"))
    loss = F.when(F.col("t.trained"), F.col("t.size")).otherwise(F.lit(0))
    return each.select(
        "conv_id",
        F.when(F.col("t.trained"), F.col("t.place")).alias("target"),
        (F.col("t.place") == F.col("n") - 1).alias("last"),
        F.substring("whole", F.lit(1), F.col("t.stop").cast("int")).alias("text"),
        (F.col("t.stop") - 4 - loss).alias("loss_start"),
        loss.alias("loss_length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, ``turns`` (role and text of each), ``loss`` (texts under the mask in order) and ``formatted_chars``."""
    loss = unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_length as int))"))
    each = formatted.select(
        "conv_id",
        F.char_length("text").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("text")).alias("whole"),
        F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("text"))).alias("loss"),
    )
    talk = each.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.collect_list("whole").alias("whole"),
        F.array_sort(F.collect_list("loss")).alias("loss"),
    )
    parts = F.slice(F.split(F.col("whole")[0], "</s>", -1), F.lit(1), F.size(F.split(F.col("whole")[0], "</s>", -1)) - 1)
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, 3, 1 << 30), "|>", 1)).alias("role"),
            unescape(F.substring(p, F.locate("|>", p) + 2, F.lit(1 << 30))).alias("text"),
        ),
    )
    return talk.select("conv_id", turns.alias("turns"), F.col("loss.text").alias("loss"), "formatted_chars")
