"""Benchmark decontamination: Wu-Manber search for the word windows of test items.

Patterns are windows of ``window`` consecutive words (an item of fewer words is one window). For every
length of pattern, the last ``block`` words at a place give its shift: how far the search may move on
without passing an occurrence. Where the shift is 0, the bucket of that block names the patterns with
this suffix, and they are compared word by word, then byte by byte.

The texts of a batch are searched in lanes of ``LANE`` words that advance together, so each step is an
array operation. Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text: every row meets
every block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslume.llm.columns import set_aside
from crosslume.llm.words import ALNUM, LOWER, Words, buffers, find_words, mix, slices, word_hashes
from crosslume.sources.staging import stage

BLOCK_BYTES = 16 << 20
LANE = 512
BITS = 20
SLICE = 1 << 19  # bytes of text looked at together


class Patterns(NamedTuple):
    """All patterns of one length: shifts by block, and the buckets of their last block."""

    length: int
    block: int
    shift: np.ndarray
    keys: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    texts: list[tuple[bytes, ...]]
    items: list[list[str]]


def _normal(column) -> Words:
    data, offsets = buffers(column)
    return find_words(LOWER[data], offsets, ALNUM)


def _blocks(hashes: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Hash of the ``block`` words that end with each of ``ends``."""
    key = np.zeros(len(ends), np.uint64)
    for back in range(block - 1, -1, -1):
        key = key * np.uint64(0x9E3779B97F4A7C55) + hashes[ends - back]
    return mix(key)


def compile_patterns(items: list[tuple[str, str]], window: int = 13, block: int = 3) -> list[Patterns]:
    """Tables for the search, one for each length of pattern; ``items`` are (name, text)."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    words = _normal(pa.array([text or "" for _, text in items], pa.string()))
    hashes = word_hashes(words)
    value = {}
    for (name, _), a, b in zip(items, words.first[:-1], words.first[1:]):
        text = [words.word(i) for i in range(a, b)]
        value.update(zip(text, hashes[a:b]))
        for i in range(max(1, len(text) - window + 1) if text else 0):
            found[tuple(text[i : i + window])].add(name)
    tables = []
    for length in sorted({len(p) for p in found}):
        texts = [p for p in found if len(p) == length]
        own = np.array([[value[w] for w in p] for p in texts], np.uint64)
        size = min(block, length)
        shift = np.full(1 << BITS, length - size + 1, np.int32)
        for end in range(size - 1, length):
            flat = _blocks(own.ravel(), np.arange(len(texts)) * length + end, size)
            np.minimum.at(shift, (flat >> np.uint64(64 - BITS)).astype(np.int64), length - 1 - end)
        order = np.argsort(flat, kind="stable")
        keys, begins = np.unique(flat[order], return_index=True)
        tables.append(
            Patterns(
                length,
                size,
                shift,
                keys,
                np.append(begins, len(order)),
                own[order],
                [texts[i] for i in order],
                [sorted(found[texts[i]]) for i in order],
            )
        )
    return tables


def search(words: Words, hashes: np.ndarray, table: Patterns) -> list[tuple[int, int]]:
    """(last word, pattern) of every occurrence inside a document."""
    n, length = len(hashes), table.length
    if n < length:
        return []
    begins = np.arange(length - 1, n, LANE)
    at, stop = begins.copy(), np.minimum(begins + LANE, n)
    zero = []
    while len(at):
        key = _blocks(hashes, at, table.block)
        step = table.shift[(key >> np.uint64(64 - BITS)).astype(np.int64)]
        hit = step == 0
        if hit.any():
            zero.append((at[hit], key[hit]))
        at = at + np.maximum(step, 1)
        left = at < stop
        at, stop = at[left], stop[left]
    if not zero:
        return []
    at, key = (np.concatenate(x) for x in zip(*zero))
    bucket = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
    same = table.keys[bucket] == key
    at, bucket = at[same], bucket[same]
    doc = words.doc()
    same = doc[at] == doc[at - length + 1]
    at, bucket = at[same], bucket[same]
    many = table.bounds[bucket + 1] - table.bounds[bucket]
    at = np.repeat(at, many)
    pattern = np.repeat(table.bounds[bucket], many) + np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
    for back in range(length):
        same = hashes[at - back] == table.hashes[pattern, length - 1 - back]
        at, pattern = at[same], pattern[same]
    return [
        (a, p)
        for a, p in zip(at.tolist(), pattern.tolist())
        if all(words.word(a - length + 1 + i) == w for i, w in enumerate(table.texts[p]))
    ]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _scan(tables):
    """Adds what a block of items hits: items and runs of hit words, besides what is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            words = _normal(batch.column("text"))
            hashes = word_hashes(words)
            marks = np.zeros(len(hashes) + 1, np.int64)
            names = [set(x or ()) for x in batch.column("items").to_pylist()]
            known = batch.column("hits").to_pylist()
            for first, spans in zip(words.first, known):
                for s in spans or ():
                    marks[first + s["start"]] += 1
                    marks[first + s["start"] + s["length"]] -= 1
            doc = words.doc()
            for table in tables.value:
                for at, pattern in search(words, hashes, table):
                    marks[at - table.length + 1] += 1
                    marks[at + 1] -= 1
                    names[doc[at]].update(table.items[pattern])
            covered = marks.cumsum()[:-1] > 0
            hits = [[] for _ in names]
            edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                while a < b:  # a run may go on in the next document
                    d = doc[a]
                    to = min(b, int(words.first[d + 1]))
                    hits[d].append({"start": a - int(words.first[d]), "length": to - a})
                    a = to
            new = {
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "hits": pa.array(hits, pa.list_(_SPAN)),
                "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays(
                [new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names
            )

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Rows of ``docs`` with ``n_words``, ``hits``, ``items`` and ``contaminated``.

    ``hits`` are runs of words (start, length) inside occurrences, ``items`` the names of items with an
    occurring window as sorted strings (an item without id is called ``null``). A text is contaminated
    if at least one in ``share`` of its words is hit. Null and empty texts have no words and no hits;
    repeated rows are judged each; columns of these names are replaced; null items have no window.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // block_bytes) or 1
    out = docs.drop("n_words", "hits", "items", "contaminated").withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "hits": F.lit(None).cast(SPANS),
            "items": F.lit(None).cast("array<string>"),
        }
    )
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i) if n > 1 else items
        tables = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in part.toLocalIterator()], window))
        out = out.mapInArrow(_scan(tables), out.schema)
        if i + 1 < n:
            out = stage(out, "decontaminate")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return out.withColumn("contaminated", (n_hit > 0) & (n_hit * share >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    rows, restore = set_aside(docs, "n_words", "hits", "items", "contaminated")
    return restore(decontaminate(rows, benchmark, **options).filter(~F.col("contaminated")))
