"""Language ID: multinomial naive Bayes over hashed character n-grams.

The matrix of log probabilities (n-gram bucket x language) is fitted on a bounded sample and broadcast; it has
``BUCKETS`` rows and a column for each language. Texts are scored in batches: the rows of all their n-grams are
gathered and summed by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslume.llm.tokens import _LETTER, _kinds
from crosslume.llm.words import buffers, mix, slices

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
PER_LANGUAGE = 2000
LONGEST = 1 << 16


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray
    weights: np.ndarray  # languages x buckets


def grams(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n-gram size the buckets of a text column and where each text's begin; and its letters.

    Letters are lower-cased; everything else counts as a blank, and of several blanks one is kept.
    """
    data, offsets = buffers(pc.utf8_lower(column.fill_null("") if column.null_count else column))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    letter = _kinds()[points] == _LETTER
    doc = np.zeros(len(points) + 1, np.int32)
    np.add.at(doc, first[1:-1], 1)
    doc = doc[:-1].cumsum(dtype=np.int32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    value = np.where(letter, points, 32).astype(np.uint64)[keep]
    owner = doc[keep]
    out = []
    for n in SIZES:
        size = max(0, len(value) - n + 1)
        key = np.zeros(size, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C55) + value[i : i + size]
        inside = owner[:size] == owner[len(value) - size :] if size else np.zeros(0, bool)
        bucket = (mix(key + np.uint64(n)) >> np.uint64(48)).astype(np.int64)[inside]
        out.append((bucket, np.searchsorted(owner[:size][inside], np.arange(len(first)))))
    letters = np.concatenate([[0], letter.cumsum()])
    return out, letters[first[1:]] - letters[first[:-1]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        found, _ = grams(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            total = sums.setdefault(lang, np.zeros(BUCKETS))
            for buckets, first in found:
                mine = np.repeat(langs == lang, np.diff(first))
                total += np.bincount(buckets[mine], minlength=BUCKETS)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [total.tobytes()]})


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in table.column("counts").to_pylist())
    return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the rows for which ``learn`` holds: about ``per_language`` of each language, chosen by hash.

    Only doc_id (for the choice), text and lang are read; rows without lang or text, and texts of over
    ``LONGEST`` bytes, teach nothing. Languages are as frequent as among all rows that may teach.
    """
    rows = docs.select("doc_id", "text", "lang").filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))))
    draw = F.xxhash64("doc_id", F.lit("language")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(2.0**53)
    sample = rows.filter((draw < shares[F.col("lang")]) & (F.octet_length("text") <= LONGEST)).select("text", "lang")
    sums = sample.mapInArrow(_counts, "lang string, counts binary")
    sums = sums.groupBy("lang").applyInArrow(_add, "lang string, counts binary").collect()
    counted = {r["lang"]: np.frombuffer(r["counts"], np.float64) for r in sums}
    languages = sorted(counts)
    table = np.array([counted.get(lang, np.zeros(BUCKETS)) for lang in languages]) + 0.1
    prior = np.array([counts[lang] for lang in languages], float)
    return Model(
        languages,
        np.log(prior / prior.sum()),
        np.log(table / table.sum(1, keepdims=True)).astype(np.float32),
    )


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for batch in slices(batches, "text"):
            found, letters = grams(batch.column("text"))
            n = batch.num_rows
            score = np.tile(fitted.prior, (n, 1))
            for buckets, first in found:
                for i, weights in enumerate(fitted.weights):
                    total = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
                    score[:, i] += total[first[1:]] - total[first[:-1]]
            if fitted.languages:
                best = score.argmax(1)
                share = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
                names = np.array(fitted.languages, object)[best]
            else:
                share, names = np.zeros(n), np.full(n, "und", object)
            names[letters == 0] = "und"
            share[letters == 0] = 0.0
            new = {"lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(share, pa.float64())}
            yield pa.RecordBatch.from_arrays(
                [new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (probability of that language), from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, and so is any if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score").withColumns(
        {"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}
    )
    return rows.mapInArrow(_predict(shared), rows.schema)
