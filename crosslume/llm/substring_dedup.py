"""Substring dedup: word windows that occur twice, found with one FM-index per shard.

1. Every window of ``window`` words is keyed by the least hash of its ``GRAM``-word pieces. Consecutive
   windows with one key form a segment, so equal windows always have the same key. Windows whose key
   occurs once in the corpus are unique; only segments of repeated keys go on.
2. Equal segments are merged to one with a weight. Segments are sharded by key; keys with more than
   ``HOT`` different segments (a passage in very many documents) are cut into single windows, merged and
   sharded by the window itself, so no shard grows with one passage.
3. Each shard is indexed and its segments are streamed through backward search (``fm_index``), which
   reports the intervals of windows that occur twice or more.
4. The intervals go back to the places of the segments, and the covered words of each text are removed.

Texts are read twice; only documents with repeated keys take part in a shuffle of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslume.llm.columns import set_aside
from crosslume.llm.fm_index import FMIndex
from crosslume.llm.words import NOT_SPACE, buffers, find_words, gram_hashes, mix, slices, span_hashes, word_hashes
from crosslume.sources.staging import stage

WINDOW = 35
GRAM = 8
RUN = 32  # windows of a segment at most
SHARD = 4_000  # segments of a shard, on average; its index is what takes most memory here
HOT = 50_000

#: Tells rows apart: the id and two hashes of the text. Rows that agree in all hold the same words.
SLICE = 1 << 19  # bytes of text looked at together
_ROW = ["id", "text_key", "text_key2"]
_ROW_TYPES = "id long, text_key long, text_key2 long"


def _segments(words, window: int):
    """First window, number of windows, key, hash and document of every segment.

    And whether its key occurs twice in it, so that it may hold equal windows by itself.
    """
    none = (np.zeros(0, np.int64),) * 5 + (np.zeros(0, bool),)
    hashes = word_hashes(words)
    n = len(hashes) - window + 1
    if n <= 0:
        return none
    gram = min(GRAM, window)
    pieces = gram_hashes(hashes, gram)
    low, span, width = pieces, 1, window - gram + 1
    while span < width:  # least hash of the pieces of each window, by doubling
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    doc = words.doc()
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(inside):
        return none
    low, owner = low[inside], doc[inside]
    head = np.ones(len(inside), bool)
    head[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(head)
    since = np.arange(len(inside)) - np.repeat(begins, np.diff(np.append(begins, len(inside))))
    begins = np.flatnonzero(since % RUN == 0)
    count = np.diff(np.append(begins, len(inside)))
    first = inside[begins]
    content = span_hashes(mix(hashes), first, first + count + window - 1)
    key, size = low[begins], count + width - 1
    at = np.cumsum(size) - size
    own = pieces[np.repeat(first - at, size) + np.arange(size.sum())] == np.repeat(key, size)
    twice = np.add.reduceat(own, at, dtype=np.int64) > 1
    return first, count, key.view(np.int64), content.view(np.int64), owner[begins], twice


def _places(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = find_words(*buffers(batch.column("text")), NOT_SPACE)
            first, count, key, content, owner, twice = _segments(words, window)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(rows) for c in _ROW),
                    pa.array((first - words.first[owner]) * (RUN + 1) + count, pa.int64()),
                    pa.array(key),
                    pa.array(content),
                    pa.array(twice),
                ],
                [*_ROW, "place", "key", "content", "twice"],
            )

    return run


def _cut(window: int):
    """Texts of the asked places; those of hot keys in single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = find_words(*buffers(batch.column("text")), NOT_SPACE)
            rows = []
            for first, last, asked in zip(words.first.tolist(), words.first[1:].tolist(), batch.column("asked").to_pylist()):
                for a in asked:
                    at, count = divmod(a["place"], RUN + 1)
                    if first + at + count + window - 1 > last:
                        raise ValueError("a place lies outside of its text")
                    steps = range(count) if a["hot"] else [None]
                    for i in steps:
                        begin = first + at + (i or 0)
                        end = begin + window + (count - 1 if i is None else 0)
                        text = b" ".join(words.word(w) for w in range(begin, end))
                        rows.append((a["key"], a["content"], a["weight"], -1 if i is None else i, text.decode()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in rows], t)
                    for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))
                ],
                ["key", "content", "weight", "step", "text"],
            )

    return run


def _index(window: int):
    """Intervals of repeated windows of the segments of a shard."""

    def run(table: pa.Table) -> pa.Table:
        words = find_words(*buffers(table.column("text")), NOT_SPACE)
        _, symbols = np.unique(word_hashes(words), return_inverse=True)
        weights = np.asarray(table.column("weight"))
        marks = FMIndex(symbols + 1, words.first, weights).repeated(window)
        edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(words.first, begins, "right") - 1
        rows = pa.array(owner)
        return pa.table(
            {
                "key": table.column("key").take(rows),
                "content": table.column("content").take(rows),
                "begin": pa.array((begins - words.first[owner]).astype(np.int32)),
                "windows": pa.array((ends - begins).astype(np.int32)),
            }
        )

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(id, text_key, text_key2, spans): runs of words of the text that repeated windows cover, for rows with any.

    ``docs`` has id, text_key, text_key2 (which tell rows apart) and text. ``spans`` may overlap and come in any order.
    """
    places = docs.mapInArrow(
        _places(window), f"{_ROW_TYPES}, place long, key long, content long, twice boolean"
    )
    keys = places.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    keys = keys.filter("n > 1 OR twice").select("key")
    # Rows that are equal in all of ``_ROW`` are one from here on, with their number as weight.
    places = places.drop("twice").join(keys, "key").groupBy(*_ROW, "place", "key", "content").agg(F.count("*").alias("n"))
    places = stage(places, "substring-places")
    segments = places.groupBy("key", "content").agg(
        F.sum("n").alias("weight"), F.min(F.struct(*_ROW, "place")).alias("at")
    )
    segments = stage(segments, "substring-segments")
    shards = -(-segments.count() // SHARD) or 1
    crowded = segments.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    crowded = crowded.select("key", F.lit(True).alias("hot"))
    asked = (
        segments.join(crowded, "key", "left")
        .select(*(f"at.{c}" for c in _ROW), F.struct("key", "content", "weight", "at.place", F.coalesce("hot", F.lit(False)).alias("hot")).alias("a"))
        .groupBy(*_ROW)
        .agg(F.collect_list("a").alias("asked"))
    )
    pieces = docs.dropDuplicates(_ROW).join(asked, _ROW).mapInArrow(
        _cut(window), "key long, content long, weight long, step int, text string"
    )
    pieces = stage(pieces, "substring-pieces")
    whole = pieces.filter("step < 0").select("key", "content", "weight", "text")
    single = pieces.filter("step >= 0").withColumns({"inner": F.xxhash64("text"), "inner2": F.xxhash64(F.lit(1), "text")})
    merged = single.groupBy("inner", "inner2").agg(F.sum("weight").alias("weight"), F.first("text").alias("text"))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    found = (
        whole.unionByName(merged.select(F.col("inner").alias("key"), F.col("inner2").alias("content"), "weight", "text"))
        .groupBy(shard.alias("shard"))
        .applyInArrow(_index(window), "key long, content long, begin int, windows int")
    )
    found = stage(found, "substring-found")
    hits = found.join(pieces.filter("step < 0").select("key", "content"), ["key", "content"], "left_semi")
    inner = (
        found.select(F.col("key").alias("inner"), F.col("content").alias("inner2"), "windows")
        .join(single, ["inner", "inner2"])
        .select("key", "content", F.col("step").alias("begin"), "windows")
    )
    hits = hits.unionByName(inner)
    start = (F.col("place") / (RUN + 1)).cast("long") + F.col("begin")
    return (
        places.join(hits, ["key", "content"])
        .select(*_ROW, F.struct(start.alias("start"), (F.col("windows") + window - 1).cast("long").alias("length")).alias("span"))
        .groupBy(*_ROW)
        .agg(F.collect_list("span").alias("_repeat_spans"))
    )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        words = find_words(*buffers(batch.column("text")), NOT_SPACE)
        marks = np.zeros(len(words.starts) + 1, np.int64)
        for first, last, spans in zip(words.first.tolist(), words.first[1:].tolist(), batch.column("_repeat_spans").to_pylist()):
            for s in spans or ():
                if first + s["start"] + s["length"] > last:
                    raise ValueError("a place lies outside of its text")
                marks[first + s["start"]] += 1
                marks[first + s["start"] + s["length"]] -= 1
        gone = marks.cumsum()[:-1] > 0
        n = np.concatenate([[0], gone.cumsum()])
        n_removed = n[words.first[1:]] - n[words.first[:-1]]
        kept, ends = np.flatnonzero(~gone), words.first
        at = np.searchsorted(kept, ends)
        texts = [b" ".join([words.word(w) for w in kept[a:b].tolist()]) for a, b in zip(at[:-1], at[1:])]
        new = {
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array([t.decode() for t in texts], pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Rows of ``docs`` with ``n_words``, ``n_removed``, ``kept`` (words left, one space between) and ``kept_sha256``.

    A word goes if a window of ``window`` words that covers it occurs at another place too, in this or
    any other row; all copies go. Null and empty texts have no words; equal rows count as many places;
    rows without id take part like any other. Columns of these names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept", "kept_sha256")
    none = F.lit(None)
    own = [f"_repeat_{c}" for c in _ROW]
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.withColumns(dict(zip(own, (name, F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))))
    spans = repeated_intervals(rows.select(*(F.col(o).alias(c) for o, c in zip(own, _ROW)), "text"), window, hot)
    spans = spans.select(*(F.col(c).alias(o) for o, c in zip(own, _ROW)), "_repeat_spans")
    rows = rows.join(spans, own, "left").select(
        *docs.columns,
        "_repeat_spans",
        none.cast("long").alias("n_words"),
        none.cast("long").alias("n_removed"),
        none.cast("string").alias("kept"),
        none.cast("string").alias("kept_sha256"),
    )
    return rows.mapInArrow(_remove, rows.schema).drop("_repeat_spans")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without repeated passages: texts that had any are their kept words, joined by one space.

    A row all of whose words are repeated keeps an empty text. ``n_chars`` follows the text.
    """
    rows, restore = set_aside(docs, "n_words", "n_removed", "kept", "kept_sha256")
    shorter = F.col("n_removed") > 0
    changed = {"text": F.when(shorter, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(shorter, F.char_length("kept")).otherwise(F.col("n_chars"))
    return restore(remove_repeats(rows, window).withColumns(changed))
