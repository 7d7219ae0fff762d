"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into blocks of about ``BLOCK``; a block
is packed by ``ISLANDS`` populations that evolve in tasks of their own and, between epochs, send their
best packing to the next island. A child takes a random half of the well-filled bins of one parent
into the other; bins that held one of these pieces dissolve, and what they lose is placed best-fit. A packing
counts by the mean square fill of its bins. Pieces of equal length are alike, so packings hold lengths only
and blocks, islands and results have a bounded size, whatever documents look like.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslume.llm.tokens import TOKENIZER, encoder, forget_pieces
from crosslume.llm.words import slices
from crosslume.sources.staging import stage

CAPACITY = 2048
BLOCK = 4096
ISLANDS, EPOCHS, POPULATION, CHILDREN = 2, 2, 4, 8
SLICE = 1 << 18  # bytes of text looked at together
FULL = 0.98  # a well-filled bin


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cut(NamedTuple):
    """Pieces of the texts of a slice: their ids (end ids included), document, number, start and length."""

    ids: np.ndarray
    owner: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def raw(self) -> list[bytes]:
        data = self.ids.view(np.uint8).data
        at = 4 * (self.first[self.owner] + self.start)
        return [bytes(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * self.length).tolist())]


def cut(path: str, column: pa.Array, capacity: int, end: int) -> Cut:
    ids, first = encoder(path).encode(column)
    ids = np.insert(ids, first[1:], end).astype("<u4")
    first = first + np.arange(len(first))
    size = np.diff(first)
    count = -(-size // capacity)
    owner = np.repeat(np.arange(len(size)), count)
    piece = np.arange(len(owner)) - np.repeat(count.cumsum() - count, count)
    short = (size - (count - 1) * capacity)[owner]
    start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
    return Cut(ids, owner, piece, start, np.where(piece == 0, short, capacity), first)


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = cut(path, batch.column("text"), capacity, end)
            raw = found.raw()
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(found.owner)),
                "piece": pa.array(found.piece.astype(np.int32)),
                "start": pa.array(found.start),
                "length": pa.array(found.length),
                "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)
        forget_pieces()

    return run


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False, path: str | None = None
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces, and on wish their ids (little-endian uint32).

    A document is the ids of its text and ``end``; a null text is empty. Only a longer one is cut, into
    pieces of ``capacity`` tokens, of which the first may be shorter. Every row counts, rows without doc_id too.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_pieces(path or tokenizer_path(), capacity, end, with_ids), schema)


def best_fit(lengths: list[int], owner: np.ndarray, items: list[int], free: list[tuple[int, int]], capacity: int, bins: int) -> int:
    """Place ``items``, in this order, into the fullest bin of ``free`` that has room, or a new one."""
    free.sort()
    for item in items:
        size = lengths[item]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, number = free.pop(at)
        else:
            room, number, bins = capacity, bins, bins + 1
        owner[item] = number
        if room > size:
            insort(free, (room - size, number))
    return bins


def fitness(sizes: np.ndarray, owner: np.ndarray, capacity: int) -> float:
    return float(np.mean((np.bincount(owner, sizes) / capacity) ** 2))


def cross(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, lengths: list[int], capacity: int, random) -> np.ndarray:
    """A child of ``a`` with well-filled bins of ``b``."""
    load_a, load_b = np.bincount(a, sizes), np.bincount(b, sizes)
    taken = ((load_b >= FULL * capacity) & (random.random(len(load_b)) < 0.5))[b]
    broken = np.zeros(len(load_a), bool)
    broken[a[taken]] = True
    # Some of the emptiest bins dissolve as well, so that a child can be better than both.
    broken[np.argsort(load_a)[: random.integers(1, 4 + len(load_a) // 50)]] = True
    lost = broken[a] & ~taken
    child = np.where(taken, b + len(load_a), a)
    bins = len(load_a) + len(load_b)
    free = [(int(capacity - load_a[i]), int(i)) for i in np.flatnonzero(~broken & (load_a < capacity))]
    items = np.flatnonzero(lost)
    items = items[np.argsort(-sizes[items] * random.uniform(0.9, 1.0, len(items)))]
    best_fit(lengths, child, items.tolist(), free, capacity, bins)
    return np.unique(child, return_inverse=True)[1]


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, random) -> list[np.ndarray]:
    """The best of ``population`` (filled up by best-fit packings) after some children."""
    lengths = sizes.tolist()
    while len(population) < POPULATION:
        noise = random.uniform(0.8, 1.0, len(sizes)) if population else 1.0
        owner = np.zeros(len(sizes), np.int64)
        best_fit(lengths, owner, np.argsort(-sizes * noise).tolist(), [], capacity, 0)
        population.append(owner)
    ranked = sorted(((fitness(sizes, x, capacity), i, x) for i, x in enumerate(population)), key=lambda x: -x[0])
    for turn in range(CHILDREN):
        i, j = random.choice(len(ranked), 2, replace=False)
        child = cross(ranked[i][2], ranked[j][2], sizes, lengths, capacity, random)
        ranked.append((fitness(sizes, child, capacity), POPULATION + turn, child))
        ranked = sorted(ranked, key=lambda x: -x[0])[:POPULATION]
    return [x for _, _, x in ranked]


def _epoch(capacity: int, epoch: int):
    def run(table: pa.Table) -> pa.Table:
        block, island = (table.column(c)[0].as_py() for c in ("block", "island"))
        sizes = np.frombuffer(table.column("sizes")[0].as_py(), "<i4").astype(np.int64)
        packings = sorted(x for x in table.column("packing").to_pylist() if x)
        random = np.random.default_rng([block, island, epoch])
        population = [np.frombuffer(x, "<i4").astype(np.int64) for x in packings]
        population = evolve(sizes, population[: 2 * POPULATION], capacity, random)
        n = len(population)
        return pa.table(
            {
                "block": pa.array([block] * n, pa.int32()),
                "island": pa.array([island] * n, pa.int32()),
                "place": pa.array(range(n), pa.int32()),
                "fitness": pa.array([fitness(sizes, x, capacity) for x in population], pa.float64()),
                "packing": pa.array([x.astype("<i4").tobytes() for x in population], pa.binary()),
            }
        )

    return run


def _lengths(table: pa.Table) -> pa.Table:
    """The lengths of a block in ascending order, as one value."""
    sizes = np.sort(np.asarray(table.column("length"))).astype("<i4")
    return pa.table({"block": table.column("block")[:1], "sizes": pa.array([sizes.tobytes()], pa.binary())})


def _assign(capacity: int):
    def run(rows: pa.Table, best: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = np.asarray(rows.column("length"))
        part = sizes < capacity
        owner = np.full(len(sizes), -1)
        if best.num_rows:
            owner[part] = np.frombuffer(best.column("packing")[0].as_py(), "<i4")
        owner[~part] = owner.max(initial=-1) + 1 + np.arange((~part).sum())
        order = np.argsort(owner, kind="stable")
        stop = np.cumsum(sizes[order])
        head = np.ones(len(order), bool)
        head[1:] = owner[order][1:] != owner[order][:-1]
        begin = stop - sizes[order]
        offset = np.empty_like(sizes)
        offset[order] = begin - np.maximum.accumulate(np.where(head, begin, 0))
        block = np.asarray(rows.column("block")).astype(np.int64)
        columns = [c for c in rows.column_names if c not in ("block", "sequence_id", "offset")]
        return rows.select(columns).append_column("sequence_id", pa.array((block << 32) + owner)).append_column(
            "offset", pa.array(offset.astype(np.int64))
        )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and others) with ``sequence_id`` and ``offset``.

    No sequence is longer than ``capacity``; its pieces stand one after the other from 0. All rows of
    the input are packed, equal ones as often as they occur.
    """
    # Rows are numbered as they are written, so that equal rows, however many, spread over all blocks.
    numbered = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    blocks = -(-numbered.filter(F.col("length") < capacity).count() // BLOCK) or 1
    rows = numbered.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).drop("_row")
    some = rows.filter(F.col("length") < capacity).select("block", "length")
    sizes = stage(some.groupBy("block").applyInArrow(_lengths, "block int, sizes binary"), "packing-sizes")
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))
    state = None
    for epoch in range(EPOCHS):
        own = sizes.withColumn("island", islands)
        if state is None:
            own = own.withColumn("packing", F.lit(None).cast("binary"))
        else:
            away = state.filter("place = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
            own = own.join(state.unionByName(away).select("block", "island", "packing"), ["block", "island"])
        state = own.groupBy("block", "island").applyInArrow(
            _epoch(capacity, epoch), "block int, island int, place int, fitness double, packing binary"
        )
        state = stage(state, "packing-islands")
    best = state.groupBy("block").agg(F.max_by("packing", F.struct("fitness", -F.col("island"))).alias("packing"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return (
        rows.groupBy("block")
        .cogroup(best.groupBy("block"))
        .applyInArrow(_assign(capacity), f"{schema}, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens."""
    return pack(token_pieces(docs, capacity, path=path), capacity)
