"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer texts are not used for fitting (they are scored like all others).
LONGEST = 1 << 16


def fold(doc_id: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most ``rows[value]`` documents of each label value, the first by a hash of doc_id.

    ``held_out`` is a condition on doc_id; such rows give no label. Of several labels of a document the
    greatest counts; rows without label or doc_id are ignored.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.dropna().filter(~held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = []
    for value, n in rows.items():
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked += [(r["doc_id"], r["label"]) for r in some.collect()]
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(
        F.octet_length("text").between(1, LONGEST)
    )
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")


def fit_in_task(sample: DataFrame, train: Callable[[pa.Table], Any]) -> Any:
    """``train`` of the (text, label) of a bounded sample, in a task of its own; only the model reaches the driver."""

    def run(table: pa.Table) -> pa.Table:
        model = train(table.sort_by("doc_id").select(["text", "label"]))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    rows = sample.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    none = pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})
    return pickle.loads(rows[0]["model"]) if rows else train(none)
