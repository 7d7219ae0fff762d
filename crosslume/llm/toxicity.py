"""Toxicity by compression distance: two trained zstandard dictionaries, one of ordinary and one of toxic text.

Both are trained by ``zstandard.train_dictionary`` on a labelled sample. A sample of the ordinary one is the words
of an ordinary text. A sample of the toxic one is those words of a toxic text that no ordinary text has and
at least a share of ``SHARED`` of the toxic texts do: toxic texts mostly consist of
ordinary words, and a dictionary trained on all of them learns those. A window of ``WINDOW`` words is compressed
with the ordinary dictionary alone and with the toxic one before it, so all that differs is what the toxic one
saves. How many bytes it saves says how much likelier such a window is in a toxic text (log odds by saved
bytes); the odds of a text's windows are calibrated to a probability for the labelled share of toxic texts.
Odds and calibration come from texts that the dictionaries have not seen: each of ``FOLDS`` parts of the sample is
compressed with dictionaries trained on the others. The dictionaries that are kept are trained on all of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslume.llm.labelled import fit_in_task, fold, labelled_sample
from crosslume.llm.words import LOWER, buffers, find_words, slices

WINDOW = 12
LEVEL = 9
SAMPLE = {0: 6000, 1: 3000}  # labelled documents to fit on, at most
SHARED, FOLDS = 0.015, 3
ORDINARY = {"dict_size": 8192, "k": 64, "d": 8}  # sizes of the dictionaries, and of the segments they are made of
TOXIC = {"dict_size": 4096, "k": 48, "d": 6}
THRESHOLD = 0.3
LOW, HIGH = -3, 12  # saved bytes beyond these count as these

#: Letters (ASCII) and all other text beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    odds: np.ndarray
    layer: np.ndarray


def windows(column: pa.Array, width: int = WINDOW) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one blank around each, begin and end of windows, and each text's first window."""
    data, offsets = buffers(pc.utf8_lower(column.fill_null("") if column.null_count else column))
    words = find_words(LOWER[data], offsets, _WORD)
    size = words.ends - words.starts
    stop = np.cumsum(size + 1) + 1  # behind the blank after each word; one blank stands before all
    flat = np.full(int(stop[-1]) if len(stop) else 1, 32, np.uint8)
    begin = stop - size - 1
    at = np.arange(int(size.sum())) + np.repeat(begin - (size.cumsum() - size), size)
    source = np.arange(int(size.sum())) + np.repeat(words.starts - (size.cumsum() - size), size)
    flat[at] = words.data[source]
    count = -(-np.diff(words.first) // width)
    first = np.concatenate([[0], count.cumsum()])
    head = np.repeat(words.first[:-1] - first[:-1] * width, count) + np.arange(first[-1]) * width
    tail = np.minimum(head + width, np.repeat(words.first[1:], count)) - 1
    if not len(head):
        return flat.tobytes(), head, head, first
    return flat.tobytes(), begin[head] - 1, stop[tail], first


class Distance:
    """Compressors of a model's dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        self.lib = zstandard
        self.pair = []
        for content in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.pair.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False
                )
            )

    def saved(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes the toxic dictionary saves on each window, from 0 for LOW on."""
        if not len(begin):
            return np.zeros(0, np.int64)
        places = np.stack([begin, end - begin], axis=1).astype(np.uint64).tobytes()
        text = self.lib.BufferWithSegments(data, places)
        a, b = (np.array([len(x) for x in c.multi_compress_to_buffer(text, threads=1)]) for c in self.pair)
        return np.clip(a - b, LOW, HIGH) - LOW


def _word_sets(texts: pa.Array) -> Iterator[set[bytes]]:
    """The different words of each text, with their blanks."""
    for batch in slices(pa.table({"text": texts}).to_batches(), "text"):
        data, begin, end, first = windows(batch.column("text"), 1)
        for a, b in zip(first[:-1], first[1:]):
            yield {data[begin[i] : end[i]] for i in range(a, b)}


def _dictionary(samples: list[bytes], options: dict) -> bytes:
    """What zstandard learns from the samples; those of too few bytes to learn from are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(samples=samples, level=LEVEL, **options).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-options["dict_size"] :]


def dictionaries(ordinary: pa.Array, toxic: pa.Array) -> tuple[bytes, bytes]:
    """The ordinary dictionary, and the toxic one with the ordinary one behind it."""
    known: set[bytes] = set()
    samples = []
    for words in _word_sets(ordinary):
        known |= words
        samples.append(b"".join(sorted(words)))
    common = _dictionary([x for x in samples if x], ORDINARY) or b" "
    own = [words - known for words in _word_sets(toxic)]
    counts = Counter(w for words in own for w in words)
    least = max(2, SHARED * len(own))
    samples = [b"".join(sorted(w for w in words if counts[w] >= least)) for words in own]
    samples = [x for x in samples if x]
    return common, (_dictionary(samples, TOXIC) if samples else b"") + common


def _features(saved: np.ndarray, first: np.ndarray, odds: np.ndarray) -> np.ndarray:
    n = np.maximum(np.diff(first), 1)
    each = odds[saved]
    total = np.concatenate([[0.0], np.cumsum(each)])
    total = total[first[1:]] - total[first[:-1]]
    most = np.zeros(len(n))
    some = np.diff(first) > 0
    if some.any():
        most[some] = np.maximum.reduceat(each, first[:-1][some])
    parts = [np.clip(total / np.sqrt(n), -5, 5), np.clip(total, -10, 20), np.clip(total / n, -2, 2), most]
    return np.stack([*parts, np.log(n), np.ones(len(n))], axis=1)


def train(sample: pa.Table, prior: float | None = None) -> Model:
    """Dictionaries, window odds and calibration from (text, label); equal texts count once.

    ``prior`` is the share of toxic texts to calibrate for, that of the sample if not given.
    """
    sample = sample.group_by(["text"], use_threads=False).aggregate([("label", "max")]).rename_columns(["text", "label"])
    label = np.asarray(sample.column("label"))
    text = sample.column("text")
    if prior is None:
        prior = float((label == 1).mean()) if len(label) else 0.0
    turn = np.where(label == 1, np.cumsum(label == 1), np.cumsum(label == 0)) % FOLDS

    def trained(which: np.ndarray) -> tuple[bytes, bytes]:
        return dictionaries(*(text.filter(pa.array(which & (label == v))) for v in (0, 1)))

    saved, firsts, labels = [], [], []
    seen = np.ones((2, HIGH - LOW + 1))
    for fold_ in range(FOLDS):
        distance, rest = Distance(*trained(turn != fold_)), np.flatnonzero(turn == fold_)
        labels.append(label[rest])
        at = 0
        for batch in slices(pa.table({"text": text.take(pa.array(rest))}).to_batches(), "text"):
            data, begin, end, first = windows(batch.column("text"))
            x = distance.saved(data, begin, end)
            owner = np.repeat(label[rest[at : at + batch.num_rows]], np.diff(first))
            seen += [np.bincount(x[owner == v], minlength=HIGH - LOW + 1) for v in (0, 1)]
            saved.append(x)
            firsts.append(first)
            at += batch.num_rows
    ordinary, toxic = trained(np.ones(len(label), bool))
    label = np.concatenate(labels)
    odds = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    x = np.concatenate([np.zeros((0, 6))] + [_features(s, f, odds) for s, f in zip(saved, firsts)])
    total = [max(int((label == v).sum()), 1) for v in (0, 1)]
    weight = np.where(label == 1, prior / total[1], (1 - prior) / total[0]) * len(label)
    layer = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(layer))
        layer += np.linalg.solve(hessian, x.T @ (weight * (label - p)) - 1e-2 * layer)
    return Model(ordinary, toxic, odds, layer)


def score(model: Model, distance: Distance, column: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text."""
    data, begin, end, first = windows(column)
    x = _features(distance.saved(data, begin, end), first, model.odds) @ model.layer
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Train on at most ``SAMPLE`` documents of each label, none of the fold ``held_out`` of doc_id."""
    aside = fold("doc_id", folds) == held_out
    sample = labelled_sample(docs, labels, "toxic", aside, SAMPLE)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    share = known.filter(~aside).agg(F.avg((F.col("toxic") == 1).cast("int"))).first()[0]
    return fit_in_task(sample, lambda table: train(table, share))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.value.ordinary, model.value.toxic)
        for batch in slices(batches, "text"):
            own = score(model.value, distance, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own) if c == "score" else batch.column(c) for c in batch.schema.names], batch.schema.names
            )

    return run


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (probability of toxicity, from the text alone) and ``predicted`` (0 or 1).

    Null texts and texts without words have the score of no window at all; repeated rows have the same score.
    Columns of ``docs`` named like these give way to them, others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("score", "predicted").withColumn("score", F.lit(None).cast("double"))
    rows = rows.mapInArrow(_score(shared), rows.schema)
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
