"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by ``CHUNK - HOP`` and cover all of it. ``FILTERS``
learned filters of ``WIDTH`` bytes (one weight for each byte value and place, and one for whether a byte
lies in a word that repeats a word just before) slide over a chunk and are rectified; their means are the chunk's
features. The document takes the greatest and the mean of each feature over its chunks, and a logistic
layer turns them into one probability. Filters and layer are trained together by Adam.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslume.llm.columns import set_aside
from crosslume.llm.labelled import fit_in_task, fold, labelled_sample
from crosslume.llm.words import LOWER, NOT_SPACE, buffers, find_words, slices, word_hashes

CHUNK, HOP, WIDTH, STRIDE, FILTERS = 256, 192, 5, 2, 12
SAMPLE = {0: 1500, 1: 3000}  # labelled documents to fit on, at most
STEPS, BATCH, RATE, CHUNKS = 560, 64, 0.02, 6
THRESHOLD = 0.3
TRAIN_SLICE, SCORE_SLICE = 1 << 17, 1 << 18  # bytes of text looked at together
PLACES = (CHUNK - WIDTH) // STRIDE + 1


class Network(NamedTuple):
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    repeat: np.ndarray  # FILTERS
    bias: np.ndarray
    layer: np.ndarray  # 2 * FILTERS + 1


class Chunks(NamedTuple):
    """Bytes and repeat marks of chunks (padded), their number of places, and the first chunk of each text."""

    data: np.ndarray
    marks: np.ndarray
    places: np.ndarray
    first: np.ndarray


def _count(size: np.ndarray) -> np.ndarray:
    """Chunks of texts of so many bytes."""
    return np.maximum(1, -(-np.maximum(size - (CHUNK - HOP), 0) // HOP))


def chunks(column: pa.Array) -> Chunks:
    data, offsets = buffers(column)
    words = find_words(LOWER[data], offsets, NOT_SPACE)
    hashes, doc = word_hashes(words), words.doc()
    again = np.zeros(len(hashes), bool)
    for back in (1, 2):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.starts[again]] += 1
    edge[words.ends[again]] -= 1
    marks = edge[:-1].cumsum(dtype=np.int8)
    count = _count(np.diff(offsets))
    first = np.concatenate([[0], count.cumsum()])
    begin = np.repeat(offsets[:-1] - first[:-1] * HOP, count) + np.arange(first[-1]) * HOP
    left = np.repeat(offsets[1:], count) - begin
    at = begin[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < left[:, None]
    at[~inside] = len(data)
    places = np.clip((np.minimum(left, CHUNK) - WIDTH) // STRIDE + 1, 1, PLACES)
    return Chunks(np.append(data, 0)[at], np.append(marks, 0)[at], places, first)


def _all_chunks(sample: pa.Table) -> Chunks:
    """Chunks of a whole sample, put where they belong slice by slice: no part is held twice."""
    size = np.asarray(pc.fill_null(pc.binary_length(sample.column("text")), 0)).astype(np.int64)
    first = np.concatenate([[0], _count(size).cumsum()])
    out = Chunks(*(np.empty((first[-1], CHUNK), t) for t in (np.uint8, np.int8)), np.empty(first[-1], np.int64), first)
    at = 0
    for batch in slices(sample.to_batches(), "text", TRAIN_SLICE):
        part = chunks(batch.column("text"))
        to = at + len(part.data)
        out.data[at:to], out.marks[at:to], out.places[at:to] = part[:3]
        at = to
    return out


def _windows(x: np.ndarray, i: int) -> np.ndarray:
    return x[:, i::STRIDE][:, :PLACES]


def _features(net: Network, data: np.ndarray, marks: np.ndarray, places: np.ndarray):
    """Rectified filters at all places, and their means over the places of each chunk."""
    z = _windows(marks, WIDTH // 2)[:, :, None] * net.repeat + net.bias
    for i in range(WIDTH):
        z += net.filters[i][_windows(data, i)]
    np.maximum(z, 0, out=z)
    z *= (np.arange(PLACES) < places[:, None])[:, :, None]
    return z, z.sum(1) / places[:, None]


def _pool(means: np.ndarray, first: np.ndarray) -> np.ndarray:
    count = np.diff(first)[:, None]
    return np.hstack(
        [np.maximum.reduceat(means, first[:-1]), np.add.reduceat(means, first[:-1]) / count, np.ones((len(count), 1))]
    )


def score(net: Network, column: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text."""
    c = chunks(column)
    means = np.empty((len(c.data), FILTERS), np.float32)
    for at in range(0, len(c.data), 512):
        part = slice(at, at + 512)
        means[part] = _features(net, c.data[part], c.marks[part], c.places[part])[1]
    x = _pool(means, c.first).astype(np.float64) @ net.layer
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(sample: pa.Table, seed: int = 1) -> Network:
    """Fit to (text, label); each time a text shows up to ``CHUNKS`` random chunks."""
    random = np.random.default_rng(seed)
    parts = [
        random.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
        random.normal(0, 0.1, FILTERS).astype(np.float32),
        np.full(FILTERS, 0.1, np.float32),
        random.normal(0, 0.1, 2 * FILTERS + 1),
    ]
    net = Network(*parts)
    label = np.asarray(sample.column("label")).astype(float)
    if not len(label):
        return net._replace(layer=np.append(np.zeros(2 * FILTERS), 1.0))
    c = _all_chunks(sample)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    step = 0
    while step < STEPS:
        order = random.permutation(len(label))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            picks = [
                c.first[d] + random.choice(n, min(n, CHUNKS), replace=False)
                for d, n in ((d, c.first[d + 1] - c.first[d]) for d in docs)
            ]
            first = np.concatenate([[0], np.cumsum([len(p) for p in picks])])
            pick = np.concatenate(picks)
            data, marks, places = c.data[pick], c.marks[pick], c.places[pick]
            z, means = _features(net, data, marks, places)
            x = _pool(means, first)
            error = (1 / (1 + np.exp(-np.clip(x @ net.layer, -30, 30))) - label[docs]) / len(docs)
            back = error[:, None] * net.layer[None, :-1]
            owner = np.repeat(np.arange(len(docs)), np.diff(first))
            top = means >= x[owner, :FILTERS] - 1e-9
            d_mean = back[owner, :FILTERS] * top + back[owner, FILTERS:] / np.diff(first)[owner][:, None]
            dz = ((z > 0) * (d_mean / places[:, None])[:, None, :]).astype(np.float32)
            flat = dz.reshape(-1, FILTERS)
            gradients = [
                np.stack(
                    [
                        np.stack(
                            [np.bincount(_windows(data, i).ravel(), flat[:, f], 256) for f in range(FILTERS)], axis=1
                        )
                        for i in range(WIDTH)
                    ]
                ),
                (dz * _windows(marks, WIDTH // 2)[:, :, None]).sum((0, 1)),
                dz.sum((0, 1)),
                x.T @ error + 1e-4 * net.layer,
            ]
            step += 1
            rate = RATE * max(0.05, 1 - step / STEPS)
            for p, g, (m, v) in zip(net, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    return net


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Network:
    """Train on at most ``SAMPLE`` documents of each label, none of the fold ``held_out`` of doc_id."""
    sample = labelled_sample(docs, labels, "quality", fold("doc_id", folds) == held_out, SAMPLE)
    return fit_in_task(sample, train)


def _score(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SCORE_SLICE):
            own = score(net.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own) if c == "score" else batch.column(c) for c in batch.schema.names], batch.schema.names
            )

    return run


def with_score(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``score`` (probability of good quality, from the text alone) and ``predicted`` (0 or 1).

    Null and empty texts have the score of a chunk without content.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.drop("score", "predicted").withColumn("score", F.lit(None).cast("double"))
    rows = rows.mapInArrow(_score(shared), rows.schema)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier does not reject."""
    rows, restore = set_aside(docs, "score", "predicted")
    return restore(with_score(rows, fit(docs, labels, **options)).filter("predicted = 1"))
