"""Decontamination, substring dedup and near-dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import decontaminated, docs, groups, sha, without_repeats, words
from pyspark.sql import functions as F

import corpus_pipeline
from crosslume.llm import decontaminate, fm_index, setsketch, substring_dedup
from crosslume.llm.components import connect

SF = "/root/testdata/sf0.001"


def sentence(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


ODD = [None, "", " \t\n", "x", "a" * 5000, "é ü ß", "... --- ...", "The THE the"]


# ---------------------------------------------------------------- decontamination


def judged(df):
    return {
        r["doc_id"]: (
            r["n_words"],
            sum(h["length"] for h in r["hits"] or []),
            r["items"],
            r["contaminated"],
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("block_bytes", [1 << 24, 6000])
def test_decontamination_equals_brute_force(spark, block_bytes):
    some, items = table(spark, "documents"), table(spark, "benchmark")
    got = judged(decontaminate.decontaminate(some, items, block_bytes=block_bytes))
    want = decontaminated(pairs_of(some), [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want and any(w[3] for w in want.values())


def test_decontamination_of_odd_rows(spark):
    rng = random.Random(4)
    long = sentence(rng, 60)
    items = spark.createDataFrame(
        [(1, long), (10, "one two"), (2, "one two"), (None, "Three"), (3, None), (4, ""), (1, long)],
        "item_id long, text string",
    )
    texts = [*ODD, long, long[:40], f"{sentence(rng, 500)} {long}", "one, two! three", "one", "three three", long]
    some = docs(spark, texts)
    got = judged(decontaminate.decontaminate(some, items))
    names = [(1, long), (10, "one two"), (2, "one two"), ("null", "Three")]
    assert got == decontaminated(pairs_of(some), names)
    empty = decontaminate.decontaminate(some.limit(0), items)
    assert empty.count() == 0
    none = judged(decontaminate.decontaminate(some, items.limit(0)))
    assert not any(v[1] or v[3] for v in none.values())


def test_windows_do_not_cross_documents(spark):
    text = sentence(random.Random(1), 13)
    some = docs(spark, [text[:30], text[30:]])
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert not any(v[1] for v in judged(decontaminate.decontaminate(some, items)).values())


def test_clean_keeps_columns(spark):
    text = sentence(random.Random(2), 40)
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    left = decontaminate.clean(docs(spark, [text, "clean", None]), items)
    assert left.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2]


# ---------------------------------------------------------------- substring dedup


def test_fm_index_counts_windows():
    rng = np.random.default_rng(1)
    for _ in range(150):
        k, n = int(rng.integers(1, 6)), int(rng.integers(1, 25))
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 15, n))])
        if not first[-1]:
            continue
        symbols = rng.integers(1, int(rng.integers(2, 5)), first[-1])
        weights = rng.integers(1, 3, n)
        counts = Counter()
        spots = [(i, j) for i in range(n) for j in range(first[i], first[i + 1] - k + 1)]
        for i, j in spots:
            counts[tuple(symbols[j : j + k])] += int(weights[i])
        want = np.zeros(len(symbols), bool)
        for _, j in spots:
            want[j] = counts[tuple(symbols[j : j + k])] >= 2
        assert (fm_index.FMIndex(symbols, first, weights).repeated(k) == want).all()


def removed(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("hot", [50_000, 1])
def test_substring_dedup_equals_brute_force(spark, hot):
    some = table(spark, "documents")
    got = removed(substring_dedup.remove_repeats(some, hot=hot))
    want = without_repeats(pairs_of(some))
    assert got == want and any(w[1] for w in want.values())


def test_substring_dedup_of_odd_rows(spark):
    rng = random.Random(6)
    passage = sentence(rng, 55)
    texts = [
        *ODD,
        f"{sentence(rng, 70)} {passage}",
        f"{passage} {sentence(rng, 90)}",
        "again " * 200,
        sentence(rng, 34),
        sentence(rng, 35),
        passage,
        passage,
        " ".join([sentence(rng, 20)] * 4),
    ]
    some = docs(spark, texts)
    got = removed(substring_dedup.remove_repeats(some))
    assert got == without_repeats(pairs_of(some))
    assert removed(substring_dedup.remove_repeats(some.limit(0))) == {}


def test_passage_in_many_documents(spark):
    rng = random.Random(8)
    passage = sentence(rng, 50)
    texts = [f"{sentence(rng, 45)} {passage} {sentence(rng, 45)}" for _ in range(60)]
    some = docs(spark, texts)
    want = without_repeats(pairs_of(some))
    assert all(w[1] >= 50 for w in want.values())
    assert removed(substring_dedup.remove_repeats(some, hot=5)) == want


def test_work_does_not_grow_with_equal_rows(spark):
    text = sentence(random.Random(8), 400)
    for n in (2, 2000):
        rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
        keys = rows.select(F.lit(0).cast("long").alias("id"), F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(1), "text").alias("text_key2"), "text")
        found = substring_dedup.repeated_intervals(keys).collect()
        assert len(found) == 1 and len(found[0]["_repeat_spans"]) < 40
    left = substring_dedup.remove_repeats(rows)
    assert left.groupBy("n_words", "n_removed", "kept").count().collect() == [(400, 400, "", 2000)]


def test_rows_that_share_an_id_and_text_that_stays(spark):
    rng = random.Random(9)
    text = sentence(rng, 40) + "\n  end"
    some = docs(spark, [(1, text), (1, "other"), (None, text), (None, "x  y"), (2, "kept  as\tit is")])
    rows = substring_dedup.clean(some).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == [
        (0, ""), (0, "x  y"), (1, ""), (1, "other"), (2, "kept  as\tit is"),
    ]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_texts_of_equal_hash_are_told_apart(spark):
    rng = random.Random(10)
    passage, tail = sentence(rng, 60), sentence(rng, 40)
    some = spark.range(400_000).select(
        (F.col("id") % 2 == 0).alias("repeats"),
        F.concat(F.when(F.col("id") % 2 == 0, F.lit(passage)).otherwise(F.lit(tail)), F.lit(" "), "id").alias("text"),
    )
    pairs = some.groupBy(F.hash("text").alias("h")).agg(
        F.min(F.when(F.col("repeats"), F.col("text"))).alias("x"), F.min(F.when(~F.col("repeats"), F.col("text"))).alias("y")
    )
    pair = pairs.filter("x IS NOT NULL AND y IS NOT NULL").orderBy("h").first()
    rows = docs(spark, [(None, pair["x"]), (None, pair["y"]), (1, f"{passage} other")])
    got = sorted(r["text"] for r in substring_dedup.clean(rows).collect())
    assert got == sorted([pair["x"].split()[-1], pair["y"], "other"])


# ---------------------------------------------------------------- near-dedup


def grouped(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    some = table(spark, "documents")
    found = setsketch.near_duplicates(some, size)
    want = groups(pairs_of(some), size)
    assert grouped(found) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())


def family(rng, n, edits, length=120):
    base = sentence(rng, length).split()
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_groups_of_near_copies_around_the_threshold(spark):
    rng = random.Random(12)
    texts = family(rng, 150, 14) + family(rng, 20, 30) + [sentence(rng, 120) for _ in range(30)]
    # A chain whose ends are far from each other.
    chain = sentence(rng, 150).split()
    for i in range(12):
        texts.append(" ".join(chain))
        chain = chain[12:] + sentence(rng, 12).split()
    rng.shuffle(texts)
    some = docs(spark, texts)
    assert grouped(setsketch.near_duplicates(some, 2)) == groups(pairs_of(some), 2)


def test_near_duplicates_of_odd_rows(spark):
    texts = [*ODD, "x", "X", "one two", "ONE  two", "the the the", "a" * 5000]
    some = docs(spark, texts)
    want = groups(pairs_of(some), 2)
    assert grouped(setsketch.near_duplicates(some, 2)) == want
    assert want[1] == (0, 1)
    more = some.unionByName(docs(spark, [(None, "one two"), (None, None)]))
    rows = setsketch.near_duplicates(more, 2).collect()
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)] * 2
    assert len(rows) == len(texts) + 2
    left = setsketch.clean(more)
    assert left.columns == some.columns and left.count() == sum(i == c for i, (_, c) in want.items()) + 2
    assert setsketch.near_duplicates(some.limit(0), 2).count() == 0


def test_rows_are_told_apart_not_ids(spark):
    rng = random.Random(15)
    one, two, three, four = (sentence(rng, 80) for _ in range(4))
    some = docs(spark, [(1, one), (1, one), (2, two), (5, f"{two} end"), (5, three), (7, f"{three} end"), (8, four)])
    rows = setsketch.near_duplicates(some, 2).collect()
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows)
    assert got == [
        (1, 1, False), (1, 1, True), (2, 2, True), (5, 2, False), (5, 5, True), (7, 5, False), (8, 8, True),
    ]
    more = some.unionByName(docs(spark, [(None, f"{four} end"), (None, "x y z"), (None, "x y z"), (None, None), (None, "")]))
    left = corpus_pipeline.near_dedup(spark, more, "").collect()
    want = [(1, one), (2, two), (5, three), (8, four), (None, "x y z"), (None, None), (None, "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left))) == sorted(map(str, want))
    left = corpus_pipeline.repeated_passages(spark, docs(spark, [(r["doc_id"], r["text"]) for r in left]), "")
    assert one in {r["text"] for r in left.collect()}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    for n in (40, 900):
        for share in (0.5, 0.8, 0.95):
            found = []
            for _ in range(40):
                common = round(2 * n * share / (1 + share))
                pool = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
                a, b = pool[:n], pool[n - common :]
                values = np.concatenate([a, b, pool])
                r = setsketch.registers(values, np.array([0, n, 2 * n, len(values)]))
                assert (np.maximum(r[0], r[1]) == r[2]).all()
                sizes = np.array([float(n)])
                found.append(setsketch.similarity(r[:1], r[1:2], sizes, sizes)[0])
            assert abs(np.mean(found) - share) < 0.04


def test_common_counts():
    rng = np.random.default_rng(4)
    sides = [[np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 5, 3000, 6000)] for _ in range(2)]
    got = setsketch.common_counts(*sides)
    want = [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]
    assert (got == np.array(want)).all()


def test_spanning_links_connect_the_same():
    random_ = np.random.default_rng(4)
    for share in (0.0, 0.02, 0.1, 1.0):
        linked = random_.random((30, 40)) < share
        chosen = setsketch.spanning(linked)
        assert len(chosen) <= 70 and all(linked[i, j] for i, j in chosen)

        def parts(pairs):
            root = list(range(70))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for i, j in pairs:
                root[find(i)] = find(30 + j)
            return {frozenset(k for k in range(70) if find(k) == r) for r in map(find, range(70))}

        assert parts(chosen) == parts(zip(*np.nonzero(linked)))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in connect(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_sets_of_shingles_fit_the_definition():
    column = pa.array(["a b a b", "a", None, "A b"])
    values, first = setsketch.shingle_sets(column, 2)
    assert np.diff(first).tolist() == [2, 1, 0, 1] and values[first[3]] in values[: first[1]]
    assert words("a b c") == ["a b", "c"] and sha("") == sha("")


def test_powers_are_kept_for_the_longest_slice_only(monkeypatch):
    from crosslume.llm import words as texts

    monkeypatch.setattr(texts, "_powers", [])
    rows = pa.RecordBatch.from_arrays([pa.array(["one two three"] * 2000)], ["text"])
    hashes = []
    for batch in texts.slices(iter([rows]), "text", 1 << 12):
        hashes += texts.word_hashes(texts.find_words(*texts.buffers(batch.column("text")), texts.NOT_SPACE)).tolist()
    assert len(hashes) == 6000 and len(set(hashes)) == 3
    assert sum(x.nbytes for x in texts._powers) < 1 << 18


def test_the_index_of_a_shard_takes_little_memory():
    import tracemalloc

    draw, n = np.random.default_rng(3), substring_dedup.SHARD
    half = [" ".join(f"w{i}" for i in draw.integers(0, 5000, 45)) for _ in range(n // 2)]
    numbers = pa.array(range(n), pa.int64())
    shard = pa.table({"key": numbers, "content": numbers, "weight": pa.array([1] * n, pa.int64()), "text": half + half})
    tracemalloc.start()
    try:
        found = substring_dedup._index(35)(shard)
        assert found.num_rows == n and tracemalloc.get_traced_memory()[1] < 128 << 20
    finally:
        tracemalloc.stop()
