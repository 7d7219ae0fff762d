"""MinHash near-dedup with SetSketch registers.

A set is sketched by ``M`` registers. Every element throws points at rate ``RATE`` on the line, each into a
random register; a register keeps its least point x as ``floor(1 - log(x) / log(BASE))``, cut to 0..255. Registers
of a union are the greater ones of both, so sketches merge, and equal registers grow likelier with
the share of common elements. Points beyond the largest register do not matter: an element of a large
set throws few.

``BANDS`` groups of ``ROWS`` registers name candidates: texts of similarity 0.8 share a band with a
probability of 1 - 1e-5 or more. The registers of a pair give the likeliest similarity; pairs far below the
threshold go, all others are confirmed on their full sets. Sets that are equal are one class from
the start.

Nothing lists the pairs of a bucket. First every member meets the pivot of its bucket, and links give labels.
Then only members of different labels that share a pivot can still be linked: the main label of a pivot
meets all others in blocks, whose tasks count common shingles exactly and return the links. Components of all
links are found at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslume.llm.bitmaps import maybe_in
from crosslume.llm.components import connect
from crosslume.llm.words import LOWER, NOT_SPACE, buffers, find_words, gram_hashes, mix, slices, word_hashes
from crosslume.sources.staging import stage

BANDS, ROWS = 40, 6
M = BANDS * ROWS
BASE, RATE = 1.09, 20.0
MARGIN = 0.15
BLOCK = 200_000  # shingles of one side of a block
SLICE = 1 << 19  # bytes of text looked at together


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in ascending order, and where each set begins."""
    data, offsets = buffers(column)
    words = find_words(LOWER[data], offsets, NOT_SPACE)
    hashes = word_hashes(words)
    counts = np.diff(words.first)
    many = np.maximum(counts - size + 1, 0)
    grams = gram_hashes(hashes, size)
    doc = words.doc()
    full = doc[: len(grams)] == doc[len(hashes) - len(grams) :] if len(grams) else np.zeros(0, bool)
    values, owner = grams[full], doc[: len(grams)][full]
    short = np.flatnonzero((many == 0) & (counts > 0))
    if len(short):  # the whole sequence is the one shingle
        own = [gram_hashes(hashes[words.first[d] : words.first[d + 1]], int(counts[d]))[0] for d in short]
        values = np.concatenate([values, mix(np.array(own, np.uint64) + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SetSketch registers (documents x M) of sets of hashes; empty sets have zeros."""
    size = np.diff(first)
    docs = len(size)
    least = np.full(docs * M, np.inf)
    reach = np.log(M) + 7.0
    todo = size > 0
    while todo.any():
        # Points of an element come at rate M (in units of the register's own rate).
        owner = np.repeat(np.arange(docs), size)
        bound = np.where(todo, reach / np.maximum(size, 1), -1.0)
        live = np.flatnonzero(todo[owner])
        seed, owner, at = values[live], owner[live], np.zeros(len(live))
        turn = 0
        while len(owner):
            turn += 1
            draw = mix(seed + np.uint64(0x9E3779B97F4A7C15 * turn & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log(_uniform(draw)) / M
            near = at <= bound[owner]
            seed, owner, at, draw = seed[near], owner[near], at[near], draw[near]
            slot = (mix(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(M)).astype(np.int64)
            np.minimum.at(least, owner * M + slot, at)
        # A document with an empty register has to look further.
        todo &= np.isinf(least.reshape(docs, M)).any(axis=1)
        reach *= 2
    with np.errstate(divide="ignore"):
        level = np.floor(1 - (np.log(least) + np.log(RATE)) / np.log(BASE))
    level = np.where(np.isinf(least), 0, level + OFFSET)
    return np.clip(level, 0, 255).astype(np.uint8).reshape(docs, M)


#: Moves the levels of sets of 1 to some 10^8 shingles into one byte.
OFFSET = 60


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs, from their registers and sizes.

    Both registers are kept by one element with a chance that depends on the similarity; the counts of
    registers that are greater, less and equal are multinomial, with the chances of SetSketch.
    """
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    grid = np.linspace(0.0, 1.0, 201)[None, :] * np.minimum(u / v, v / u)

    def chance(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    up, down = (np.maximum(chance(np.clip(x - y * grid, 0, 1)), 1e-12) for x, y in ((u, v), (v, u)))
    even = np.maximum(1 - up - down, 1e-12)
    best = (more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(even)).argmax(1)
    return grid[np.arange(len(best)), best]


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            values, first = shingle_sets(batch.column("text"), size)
            n = np.diff(first)
            sums = np.zeros((2, len(values) + 1), np.uint64)
            np.cumsum(mix(values), out=sums[0, 1:])
            np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
            sums = (sums[:, first[1:]] - sums[:, first[:-1]]).view(np.int64)
            sketch = registers(values, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.array([r.tobytes() for r in sketch], pa.binary()),
                ],
                ["id", "n", "set_a", "set_b", "registers"],
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, _ = buffers(batch.column("registers"))
        grid = data.reshape(-1, BANDS, ROWS)
        key = np.zeros(grid.shape[:2], np.uint64)
        for i in range(ROWS):
            key = key * np.uint64(0x9E3779B97F4A7C55) + grid[:, :, i] + np.uint64(1)
        key = mix(key + (np.arange(BANDS, dtype=np.uint64) << np.uint64(48)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(batch.column("id")), BANDS)), pa.array(key.ravel().view(np.int64))],
            ["id", "bucket"],
        )


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                a, b = (buffers(rows.column(c))[0].reshape(-1, M) for c in ("a_registers", "b_registers"))
                like = similarity(a, b, *(np.asarray(rows.column(c)).astype(float) for c in ("a_n", "b_n")))
                keep = pa.array(like >= threshold - MARGIN)
                yield rows.select(["a", "b"]).filter(keep)

    return run


def _confirm(size: int, percent: int):
    """Keeps pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for outer in slices(batches, "a_text", SLICE):
            for batch in slices([outer], "b_text", SLICE):
                pivots, pivot = np.unique(np.asarray(batch.column("a")), return_index=True)
                left, la = shingle_sets(batch.column("a_text").take(pa.array(pivot)), size)
                right, ra = shingle_sets(batch.column("b_text"), size)
                which = np.searchsorted(pivots, np.asarray(batch.column("a")))
                keep = []
                for i, w in enumerate(which.tolist()):
                    x, y = left[la[w] : la[w + 1]], right[ra[i] : ra[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = [[np.searchsorted(shared, x[np.isin(x, shared, assume_unique=True)]) for x in side] for side in (left, right)]
    for at in range(0, len(shared), 4096):
        tables = []
        for side in places:
            table = np.zeros((len(side), 4096), np.float32)
            for row, x in zip(table, side):
                row[x[np.searchsorted(x, at) : np.searchsorted(x, at + 4096)] - at] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def spanning(linked: np.ndarray) -> np.ndarray:
    """Links (row, column) that connect all that the links of a matrix connect, no more than it has rows and columns."""
    free = [np.ones(n, bool) for n in linked.shape]
    both, out = (linked, linked.T), []
    for start in np.flatnonzero(linked.any(1)).tolist():
        if not free[0][start]:
            continue
        free[0][start] = False
        todo = [(0, start)]
        while todo:
            side, i = todo.pop()
            found = np.flatnonzero(both[side][i] & free[1 - side]).tolist()
            free[1 - side][found] = False
            todo += [(1 - side, j) for j in found]
            out += [(j, i) if side else (i, j) for j in found]
    return np.array(out, np.int64).reshape(-1, 2)


def _compare(size: int, percent: int):
    """Links between the two sides of a block, where labels differ: as many as connect what all of them connect."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        values, first = shingle_sets(table.column("text"), size)
        ids, label = (np.asarray(table.column(c)) for c in ("id", "label"))
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs = np.zeros((0, 2), np.int64)
        if len(rows) and len(columns):
            n = np.diff(first)
            common = common_counts(*([values[first[i] : first[i + 1]] for i in x] for x in (rows, columns)))
            union = n[rows][:, None] + n[columns][None, :] - common
            linked = (100 * common >= percent * union) & (label[rows][:, None] != label[columns][None, :])
            x, y = spanning(linked).T
            pairs = np.sort(np.stack([ids[rows[x]], ids[columns[y]]], axis=1), axis=1)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return run


def _pivot_links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are linked."""

    def side(name: str) -> DataFrame:
        return sketches.select(*(F.col(c).alias(name if c == "id" else f"{name}_{c}") for c in sketches.columns))

    near = pairs.join(side("b"), "b").join(side("a"), "a")
    near = near.filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    near = near.mapInArrow(_likely(percent / 100), "a long, b long")
    both = near.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a"
    )
    return stage(both.mapInArrow(_confirm(size, percent), "a long, b long"), "setsketch-links")


def _labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): ids with one label are linked, by some steps; others may be or not."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("label")).union(links.select("b", "a"))
    step = both.groupBy("id").agg(F.least(F.min("label"), F.col("id")).alias("label"))
    step = stage(step, "setsketch-labels")
    for _ in range(2):
        further = step.select(F.col("id").alias("label"), F.col("label").alias("least"))
        step = step.join(further, "label").select("id", F.col("least").alias("label"))
    return ids.join(step, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _block_links(groups: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members (pivot, id, label) of a pivot that differ in label; all pairs are compared, and of the
    links of a block those are returned that connect its members."""
    rows = groups.join(sketches.select("id", "n"), "id")
    parts = rows.groupBy("pivot", "label").agg(F.sum("n").alias("n"))
    main = parts.groupBy("pivot").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")
    )
    main = main.filter(F.col("most") < F.col("all"))

    def blocks(n: Column) -> Column:
        return F.ceil(n / F.lit(float(BLOCK))).cast("int")

    main = main.select("pivot", "main", blocks(F.col("most")).alias("m"), blocks(F.col("all") - F.col("most")).alias("o"))
    rows = rows.join(main, "pivot").withColumn("other", F.col("label") != F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("other"), F.col("o")).otherwise(F.col("m"))).cast("int")
    rows = rows.withColumn("own", own)
    left = rows.select(
        "pivot",
        "id",
        "label",
        F.when(F.col("other"), F.col("m") + F.col("own")).otherwise(F.col("own")).alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("o") - 1)).alias("j"),
        F.lit(0).alias("side"),
    )
    right = rows.filter("other").select(
        "pivot",
        "id",
        "label",
        F.explode(F.sequence(F.lit(0), F.col("m") + F.col("o") - 1)).alias("i"),
        F.col("own").alias("j"),
        F.lit(1).alias("side"),
    )
    both = left.unionByName(right).join(texts, "id")
    links = both.groupBy("pivot", "i", "j").applyInArrow(_compare(size, percent), "a long, b long")
    return stage(links.distinct(), "setsketch-block-links")


def _survivors(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """row, id, n and ``best`` of staged ``rows`` (row, id, text, linked).

    ``best`` holds the ``id`` and the ``row`` that stand for all rows that links reach: those of least id (rows
    without id come last), and of the least row number among them. It is null where ``linked`` is not
    true or the text has no words.
    """
    texts = rows.select(F.col("row").alias("id"), "text")
    sketches = texts.mapInArrow(_sketch(size), "id long, n long, set_a long, set_b long, registers binary")
    sketches = stage(sketches, "setsketch")
    key = ["set_a", "set_b", "n"]
    names = rows.select("row", F.col("id").alias("name"), "linked")
    known = sketches.select(F.col("id").alias("row"), *key).join(names, "row")
    known = stage(known, "setsketch-names")
    # The registers of equal sets are equal.
    first = sketches.select("id", "registers")
    classes = known.filter("n > 0 AND linked").groupBy(*key).agg(
        F.min("row").alias("rep"), F.min(F.struct(F.col("name").isNull().alias("nameless"), "name", "row")).alias("best")
    )
    classes = stage(classes, "setsketch-classes")
    sets = stage(classes.select(F.col("rep").alias("id"), "n").join(first, "id"), "setsketch-sets")
    members = sets.select("id", "registers").mapInArrow(_bands, "id long, bucket long")
    pivots = members.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last"))
    pivots = pivots.filter("pivot <> last").select("bucket", "pivot")
    groups = stage(members.join(pivots, "bucket").select("pivot", "id").distinct(), "setsketch-groups")
    ids = groups.select("id").distinct()
    texts = maybe_in(texts, ids, "id", "maybe").filter("maybe").drop("maybe")
    texts = stage(texts.join(ids, "id", "left_semi"), "setsketch-texts")
    pairs = groups.filter("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = _pivot_links(pairs, sets, texts, size, percent)
    groups = groups.join(_labels(ids, links), "id")
    links = links.unionByName(_block_links(groups, sets, texts, size, percent))
    labels = connect(links).select(F.col("id").alias("rep"), "component")
    classes = classes.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    best = classes.groupBy("component").agg(F.min("best").alias("best"))
    classes = classes.select(*key, "component").join(best, "component").withColumn("linked", F.lit(True))
    found = known.join(classes.select(*key, "linked", "best"), [*key, "linked"], "left")
    return found.select("row", F.col("name").alias("id"), "n", F.struct(F.col("best.name").alias("id"), F.col("best.row").alias("row")).alias("best"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Texts are lower-cased (A-Z) and split at white space; a set is the distinct shingles of ``size`` words
    (fewer words are one shingle). Texts are linked if the common shingles are ``percent`` of all or
    more. ``component_id`` is the least doc_id that links reach; of the rows of a component one is ``kept``, one
    of that doc_id. Null and empty texts have no set and stay alone. A row without doc_id links nothing
    and is kept. Rows that share a doc_id are told apart: each is linked by its own text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows = rows.withColumns({"row": F.monotonically_increasing_id(), "linked": F.col("id").isNotNull()})
    found = _survivors(stage(rows, "setsketch-rows"), size, percent)
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("best.id", "id").alias("component_id"),
        F.coalesce(F.col("best.row") == F.col("row"), F.lit(True)).alias("kept"),
    )


def clean(docs: DataFrame, size: int = 5, percent: int = 80, nameless: bool = False) -> DataFrame:
    """One row of each group of near copies, of those with the least doc_id, and all others.

    Rows without doc_id stay as they are, or with ``nameless`` take part like any other, after all doc_ids.
    """
    rows = stage(docs.withColumn("_near_row", F.monotonically_increasing_id()), "setsketch-rows")
    name = F.col("doc_id").cast("long")
    linked = F.lit(True) if nameless else name.isNotNull()
    numbered = rows.select(F.col("_near_row").alias("row"), name.alias("id"), "text", linked.alias("linked"))
    gone = _survivors(numbered, size, percent).filter("best.row <> row").select(F.col("row").alias("_near_row"))
    gone = stage(gone, "setsketch-gone")
    rows = maybe_in(rows, gone, "_near_row", "_maybe_gone")
    some = rows.filter("_maybe_gone").join(gone, "_near_row", "left_anti").select(docs.columns)
    return rows.filter("NOT _maybe_gone").select(docs.columns).unionByName(some)
