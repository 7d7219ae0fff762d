"""The trie of all conversations: a node for each distinct sequence of first turns.

Turns become 128-bit digests; a pass over each conversation's turns in order chains them, so a prefix is a digest
too. A count-min sketch of all prefix digests is made by the tasks in part, merged piece by piece and broadcast
(``MOST_CELLS`` cells in each of two rows, two bits a cell: counts beyond two are all the same here). It never
counts too low, so an estimate of one proves that a prefix has one conversation, and so have all prefixes that
go on from it: such tails are emitted where they are. Only prefixes that may be shared are shuffled and grouped
exactly. When there are more prefixes than cells, more of them are shuffled; the result is the same.

Subtree sums need no walk level by level. A node belongs to its smallest member; going down a conversation
the owner never gets smaller, so what a conversation owns is the end of its own path, a chain. A chain's
sums go to every owner above it once, at the depth where its path leaves that owner, and a
running sum from the bottom of each chain gives the sums of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslume.llm.words import NOT_SPACE, buffers, find_words, slices
from crosslume.operators.skew import split_join
from crosslume.sources.staging import stage

FEWEST_CELLS, MOST_CELLS = 1 << 16, 1 << 26
PIECE = 1 << 13  # cells of the sketch that are merged together
IDS = 256  # ids joined into one piece of text before it is hashed

_TURN = "conv_id long, turn long, digest binary, words long"
_PATH = "conv_id long, depth long, key binary, parent binary, words long, ends boolean"
_ROOT = b"\0" * 16


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and number of words of every turn."""
    for batch in slices(batches, "text"):
        words = np.diff(find_words(*buffers(batch.column("text")), NOT_SPACE).first)
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        digest = []
        for role, text in zip(roles, texts):
            r, t = role.encode(), text.encode()
            digest.append(hashlib.blake2b(b"%d\n%b%b" % (len(r), r, t), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(digest, pa.binary()), pa.array(words.astype(np.int64))],
            ["conv_id", "turn", "digest", "words"],
        )


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words) of all turns with a conv_id, placed from 1 by turn (null first), then digest."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = rows.mapInArrow(_digests, _TURN).withColumn("place", F.row_number().over(order).cast("long"))
    return stage(placed.select("conv_id", "place", "digest", "words"), "trie-turns")


def rebuilt(placed: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """``placed`` with the head of each conversation taken from the first one of its group.

    Conversation c has h = crc32(decimal c) % ``heads`` first turns of c - c % ``group`` (those there are; none if
    there is no such conversation), then its own after the first h. ``place`` 0 is a row for every conversation without a turn.
    """
    skip = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    base = F.col("conv_id") - F.col("conv_id") % group
    heads_ = placed.filter((F.col("place") < heads) & (F.col("conv_id") % group == 0)).select(
        F.col("conv_id").alias("base"), "place", "digest", "words"
    )
    each = placed.filter("place = 1").select("conv_id", skip.alias("skip"), base.alias("base"))
    lent = each.join(heads_, "base").filter(F.col("place") <= F.col("skip")).select("conv_id", "place", "digest", "words")
    none = F.lit(None)
    start = each.select("conv_id", F.lit(0).cast("long").alias("place"), none.cast("binary").alias("digest"), none.cast("long").alias("words"))
    # Own turns keep their places: behind what was lent, wherever that ends.
    own = placed.filter(F.col("place") > skip)
    return start.unionByName(lent).unionByName(own)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place: a row for each prefix, the empty one included."""
    last, key, depth = None, _ROOT, 0
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["conv_id", "depth", "key", "parent", "words", "ends"]
        )

    for batch in batches:
        for conv, place, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "digest", "words"))):
            if last is not None:
                out.append((*last, conv != last[0]))
            if place == 0:
                key, depth, last = _ROOT, 0, (conv, 0, _ROOT, None, 0)
            else:
                above, depth = key, depth + 1
                key = hashlib.blake2b(above + digest, digest_size=16).digest()
                last = (conv, depth, key, above, words)
        if out:
            yield emit()
    if last is not None:
        out.append((*last, True))
        yield emit()


def prefixes(whole: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, words, ends) of every prefix of every conversation of ``rebuilt``."""
    ordered = whole.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return stage(ordered.mapInArrow(_chain, _PATH), "trie-prefixes")


def cells(keys: np.ndarray, size: int) -> np.ndarray:
    """The cell of each key (16 bytes as two numbers) in both rows of the sketch, one behind the other."""
    return np.concatenate([keys[:, 0] % np.uint64(size), keys[:, 1] % np.uint64(size) + np.uint64(size)])


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def sketch(keys: DataFrame, size: int) -> np.ndarray:
    """Counts (0, 1 or 2 for more) of the keys of the column ``key``, by cell: 2 rows of ``size``, packed four to a byte."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(2 * size, np.uint8)
        for batch in batches:
            at, n = np.unique(cells(_numbers(batch.column("key")), size), return_counts=True)
            count[at] = np.minimum(count[at] + np.minimum(n, 2), 2)
        pieces = count.reshape(-1, min(PIECE, size))
        for piece in np.flatnonzero(pieces.any(1)):
            once, more = (np.packbits(pieces[piece] == v) for v in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array([piece], pa.int32()), pa.array([once.tobytes()]), pa.array([more.tobytes()])], ["piece", "once", "more"]
            )

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """One piece out of those of the tasks, each of ``PIECE`` cells."""
        once = more = np.uint8(0)
        for a, b in zip(table.column("once").to_pylist(), table.column("more").to_pylist()):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            more = more | b | (once & a)
            once = once | a
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "once": [(once & ~more).tobytes()], "more": [more.tobytes()]})

    schema = "piece int, once binary, more binary"
    merged = keys.select("key").mapInArrow(part, schema).groupBy("piece").applyInArrow(merge, schema)
    bits = np.zeros((2, 2 * size // 8), np.uint8)  # bounded, see MOST_CELLS
    wide = min(PIECE, size) // 8
    for row in merged.toLocalIterator():
        for i, c in enumerate(("once", "more")):
            bits[i, row["piece"] * wide : (row["piece"] + 1) * wide] = np.frombuffer(row[c], np.uint8)
    return bits


def several(bits: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Whether the estimate of each key (the least of its two cells) is more than one."""
    at = cells(keys, size)
    byte, bit = (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)
    more = (bits[1, byte] >> (np.uint8(7) - bit)) & 1
    return more[: len(keys)].astype(bool) & more[len(keys) :].astype(bool)


def _screen(shared, size: int):
    """Adds whether a prefix, and the one before it, may have several conversations (the empty one always may)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = several(bits, _numbers(batch.column("key")), size)
            above = several(bits, _numbers(batch.column("parent")), size)
            top = np.asarray(batch.column("depth")) == 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own), pa.array(above | top)], [*batch.schema.names, "shared", "shared_above"]
            )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by key: pieces of joined text."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        out, at = ([], [], []), 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and to - at < IDS and keys[to] == keys[at]:
                to += 1
            for column, value in zip(out, (keys[at], ids[at], ",".join(map(str, ids[at:to])))):
                column.append(value)
            at = to
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["key", "conv_id", "text"]
            )


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first id: one digest for each key."""
    key, state, out = None, None, []
    for batch in batches:
        for own, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if own != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], ["key", "ends_sha256"])
            out = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def id_lists(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the ascending conv_ids of each key, comma-joined.

    Sorting by key and id splits a key's ids over tasks; the digest of a key, which has to be made in
    order, then reads long pieces of text.
    """
    ordered = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    text = ordered.mapInArrow(_pieces, "key binary, conv_id long, text string")
    return text.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hash, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, most_cells: int = MOST_CELLS, group: int = 20, heads: int = 4) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (see ``rebuilt``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Null roles and texts are empty; turns that are equal in
    place are ordered by digest, repeated ones count as several; rows without conv_id are left out, other
    columns ignored. Without conversations there is no node, not even the root.
    """
    spark = conversations.sparkSession
    paths = prefixes(rebuilt(turns(conversations), group, heads))
    root = paths.filter("depth = 0")
    found = paths.agg(F.count("*"), F.count(F.when(F.col("depth") == 0, 1)), F.min("conv_id")).first()
    total, n_convs, least = found
    size = FEWEST_CELLS
    while size < min(8 * total, most_cells):
        size *= 2
    below = paths.filter("depth > 0")
    bits = sketch(below, size)
    shared = spark.sparkContext.broadcast(bits)
    flagged = below.mapInArrow(_screen(shared, size), _PATH + ", shared boolean, shared_above boolean")
    flagged = stage(flagged, "trie-flagged")
    shared.destroy()

    maybe, alone = flagged.filter("shared"), flagged.filter("not shared")
    nodes = maybe.groupBy("key").agg(
        F.min("conv_id").alias("owner"),
        F.count("*").alias("n_convs"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("words").alias("words"),
        F.max("shared_above").alias("shared_above"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"),
    )
    nodes = stage(nodes, "trie-nodes")

    # Children that are known by their parent's digest: nodes, and tops of tails.
    tops = alone.filter("shared_above")
    kids = nodes.select("parent").unionByName(tops.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    grown = nodes.join(kids.withColumnRenamed("parent", "key"), "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))
    )
    grown = grown.withColumns(
        {"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    )
    grown = stage(grown, "trie-grown")

    # A chain's own sums: its nodes that may be shared, and the leaf at the end of its tail.
    own = grown.groupBy("owner").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    tails = alone.filter("ends").select(
        F.col("conv_id").alias("owner"), "depth", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")
    )
    chains = own.unionByName(tails.drop("depth")).groupBy("owner").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    # Where the path of each chain leaves the owners above it.
    walked = split_join(
        maybe.select("conv_id", "key", "depth"), nodes.select("key", "owner"), ["key"], split_left=["conv_id"], hint="merge"
    )
    leaving = (
        walked.filter("owner <> conv_id")
        .groupBy("conv_id", "owner")
        .agg(F.max("depth").alias("depth"))
        .join(chains.select(F.col("owner").alias("conv_id"), "leaves", "saved"), "conv_id")
        .groupBy("owner", "depth")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    # One row for each owner and depth; what hangs off counts there and above.
    at = grown.select("owner", "depth", "key", F.col("leaf").alias("leaves"), "saved")
    at = at.unionByName(leaving.unionByName(tails).withColumn("key", F.lit(None).cast("binary")))
    at = at.groupBy("owner", "depth").agg(F.max("key").alias("key"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = at.select("key", F.sum("leaves").over(up).alias("n_leaves"), F.sum("saved").over(up).alias("saved_tokens"))
    summed = summed.filter(F.col("key").isNotNull())

    empty = F.lit(hashlib.sha256(b"").hexdigest())
    root_owner = F.lit(least).cast("long")
    owners = nodes.select(F.col("key").alias("parent"), F.col("owner").alias("above"))
    ends = id_lists(maybe.filter("ends"))
    inner = grown.join(summed, "key").join(owners, "parent", "left").join(ends, "key", "left")
    # A parent that is no node of its own is a prefix of the same single conversation.
    inner = inner.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 1, root_owner).otherwise(F.coalesce("above", "owner")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )

    def single(rows: DataFrame, above) -> DataFrame:
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        return rows.select(
            "conv_id",
            "depth",
            above.alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(F.col("ends"), zero).otherwise(one).alias("n_children"),
            one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
        )

    rest = single(alone.filter("not shared_above"), F.col("conv_id"))
    first = single(tops.filter("depth = 1"), root_owner)
    later = split_join(tops.filter("depth > 1"), owners, ["parent"], "left", split_left=["conv_id"], hint="merge")
    later = single(later, F.coalesce("above", "conv_id"))

    children = flagged.filter("depth = 1")
    children = nodes.filter("depth = 1").select("key").unionByName(children.filter("not shared").select("key")).agg(
        F.count("*").alias("n_children")
    )
    whole = chains.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ending = id_lists(root.filter("ends")).agg(F.max("ends_sha256").alias("ends_sha256"))
    zero = F.lit(0).cast("long")
    top = children.crossJoin(whole).crossJoin(ending)  # one row each
    top = top.select(
        root_owner.alias("conv_id"),
        zero.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(n_convs).cast("long").alias("n_convs"),
        "n_children",
        # Without any turn the root itself is the only leaf.
        F.greatest(F.coalesce("n_leaves", zero), F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    ).filter(F.lit(n_convs) > 0)
    return inner.unionByName(rest).unionByName(first).unionByName(later).unionByName(top)
