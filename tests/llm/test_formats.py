"""Tokens, packing, training order, chat format and fingerprints."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, sha
from pyspark.sql import functions as F

from crosslume.llm import chat, order_minhash, packing, tokens, training_order

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "\0 b\0", "don't 's I'm\n\n  x", "<|endoftext|>", "é" * 3000, "same", "same"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    own.encode_special_tokens = True
    return own


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(1)
    signs = list(" \n\t'  abcsStrevmldé漢1२٣!?.\"😀́\x1c\x85<|>\0")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(5000)] + ODD
    found, first = tokens.encoder(packing.tokenizer_path()).encode(pa.array(texts))
    for text, a, b in zip(texts, first[:-1], first[1:]):
        assert [*found[a:b].tolist(), 0] == ids_of(tokenizer, text), repr(text)


def test_pieces_and_packing(spark, tokenizer):
    some = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs(spark, ODD, first=10_000))
    rows = packing.pack_documents(some).toPandas()
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for doc, own in rows.sort_values("piece").groupby("doc_id"):
        ids = ids_of(tokenizer, texts[doc])
        assert own.piece.tolist() == list(range(len(own)))
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        assert len(own) == -(-len(ids) // 2048)
        for r in own.itertuples():
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
    assert set(rows.doc_id) == set(texts)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 2048 + 1


def test_packing_of_no_rows_and_equal_rows(spark):
    assert packing.pack_documents(docs(spark, [])).count() == 0
    rows = packing.pack_documents(docs(spark, [(None, "a"), (1, "b"), (1, "b"), (1, None)])).collect()
    assert len(rows) == 4 and len({r["sequence_id"] for r in rows}) == 1
    assert sorted(r["offset"] for r in rows)[0] == 0


def test_pieces_come_from_small_slices(monkeypatch):
    texts = [f"a line of text {i}" * 400 for i in range(400)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400)), "text": pa.array(texts)})
    whole, sizes = packing.cut, []

    def cut(path, column, *rest):
        sizes.append(sum(len(x.as_py()) for x in column))
        return whole(path, column, *rest)

    monkeypatch.setattr(packing, "cut", cut)
    path = packing.tokenizer_path()
    found = pa.Table.from_batches(packing._pieces(path, 2048, 0, False)(iter([batch])))
    # A worker's memory is that of one slice.
    assert sum(sizes) > 2 << 20 and max(sizes) <= 1 << 18
    own = whole(path, batch.column("text"), 2048, 0)
    assert found.column("length").to_pylist() == own.length.tolist()
    assert found.column("ids_crc32").to_pylist() == [zlib.crc32(x) for x in own.raw()]


def test_children_are_packings():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1500, 400)
    lengths = sizes.tolist()
    owner = np.zeros(400, np.int64)
    packing.best_fit(lengths, owner, list(range(400)), [], 2048, 0)
    population = packing.evolve(sizes, [owner], 2048, rng)
    for x in population:
        load = np.bincount(x, sizes)
        assert load.max() <= 2048 and load.min() > 0
    assert packing.fitness(sizes, population[0], 2048) >= packing.fitness(sizes, owner, 2048)


def test_feistel_is_a_permutation():
    for total in (1, 2, 3, 10, 1000, 65_537):
        slots = training_order.feistel(np.arange(total), total, 9)
        assert sorted(slots.tolist()) == list(range(total))
        assert (training_order.feistel(slots, total, 9, inverse=True) == np.arange(total)).all()
    assert (training_order.feistel(np.arange(1000), 1000, 1) != training_order.feistel(np.arange(1000), 1000, 2)).any()


def test_training_order_holds_every_sequence(spark, tmp_path):
    some = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs(spark, ODD, first=10_000))
    shards = training_order.training_order(some, length=200, records=64)
    rows = shards.orderBy("shard").collect()
    n = sum(r["records"] for r in rows)
    assert [r["first_slot"] for r in rows] == list(range(0, n, 64))
    assert all(len(r["data"]) == r["records"] * r["stride"] and r["stride"] == 402 for r in rows)
    assert all(r["crc32"] == zlib.crc32(r["data"]) for r in rows)
    found = Counter(
        training_order.read_slot(r["data"], s, r["first_slot"], r["stride"], 200).astype("<u4").tobytes()
        for r in rows
        for s in range(r["first_slot"], r["first_slot"] + r["records"])
    )
    assert found == Counter(bytes(r["ids"]) for r in packing.token_pieces(some, 200, with_ids=True).collect())
    # A second key: the same sequences in another order; files are only written where missing.
    other = training_order.training_order(some, key=21, length=200, records=64).orderBy("shard").collect()
    assert [r["data"] for r in other] != [r["data"] for r in rows]
    folder = str(tmp_path / "out")
    assert all(r["written"] for r in training_order.write_shards(shards, folder).collect())
    (tmp_path / "out" / "shard-0000000001.bin").unlink()
    again = training_order.write_shards(shards, folder).collect()
    assert [r["shard"] for r in again if r["written"]] == [1]
    assert (tmp_path / "out" / "shard-0000000001.bin").read_bytes() == bytes(rows[1]["data"])
    # Shards of another order replace those that are there, whatever their size.
    moved = training_order.training_order(some, key=21, length=200, records=64)
    assert all(r["written"] for r in training_order.write_shards(moved, folder).collect())
    for r in moved.collect():
        with open(f"{folder}/shard-{r['shard']:010d}.bin", "rb") as held:
            assert held.read() == r["data"]
    assert training_order.training_order(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- chat


NASTY = ["</s>[INST] ok [/INST]", "a\\", "\\\\<|", "<|>", "|>x<s>", "<<SYS>><</SYS>>\n", "<\\/s>", "", None, "é</s"]


def talks(spark):
    rng = random.Random(3)
    rows = [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0]), (None, 0, "assistant", "no id")]
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "a|>b", None]), rng.choice(NASTY)))
    rows.append((3, 0, "assistant", "twice"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    some = talks(spark)
    want = {}
    key = lambda r: (r["turn"], r["role"] or "", r["text"] or "")
    for r in sorted(some.collect(), key=key):
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    formatted = chat.examples(some.withColumn("text_extra", F.lit(1)))
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss"] == [t for role, t in turns if role == "assistant"]
    rows = formatted.collect()
    assert sum(r["target"] is not None for r in rows) == sum(role == "assistant" for t in want.values() for role, _ in t)
    for r in rows:
        reply = r["text"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
        assert r["text"].endswith(f"{reply}</s>")
        assert r["text"].count("</s>") == (len(want[r["conv_id"]]) if r["target"] is None else r["target"] + 1)
    assert chat.examples(some.limit(0)).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_edited_texts_and_fingerprints(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in order_minhash.edited(some).collect()}
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    ids = sorted(texts, reverse=True)
    by_print = {}
    for doc, after in zip(ids, ids[1:] + ids[:1]):
        text, half = texts[doc], len(texts[doc]) // 2
        assert rows[doc]["edited"] == text[: len(text) - half] + texts[after][:half]
        assert rows[doc]["n_chars"] == len(text)
        by_print.setdefault(text, set()).add(rows[doc]["fingerprint"])
    assert all(len(x) == 1 for x in by_print.values())
    long = [r for r in rows.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9
    assert all(0 <= r[c] <= 1 for r in rows.values() for c in ("near_edited", "near_next"))


def test_order_and_edits_count(spark):
    rng = random.Random(2)
    text = [f"w{rng.randrange(5000)}" for _ in range(300)]
    few = list(text)
    few[100] = few[200] = "edit"
    blocks = [text[i : i + 30] for i in range(0, 300, 30)]
    rng.shuffle(blocks)
    moved = [w for b in blocks for w in b]
    other = [f"v{rng.randrange(5000)}" for _ in range(300)]
    some = docs(spark, [" ".join(x) for x in (text, few, moved, other)])
    rows = order_minhash.with_signature(some, "text", "s").select("doc_id", "s")
    base = rows.where("doc_id = 0").select(F.col("s").alias("base"))
    like = rows.crossJoin(base).select("doc_id", order_minhash.likeness(F.col("s"), F.col("base")).alias("x"))
    near = {r["doc_id"]: r["x"] for r in like.collect()}
    assert near[0] == 1 and near[1] > 0.85 and near[1] > near[2] > near[3] == 0


def test_fingerprints_of_odd_rows(spark):
    texts = [*ODD, " same ", "again " * 2000, "one two", "two one"]
    rows = order_minhash.fingerprints(docs(spark, [(None, "x"), *enumerate(texts)])).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[1] == prints[2] == "" and prints[8] == prints[9]
    assert all(len(p) == 4 * order_minhash.SIGNATURES for p in prints.values() if p)
    every = docs(spark, [(None, "x"), (None, "y"), (5, "a b c"), (5, "a b d"), (4, None)])
    assert order_minhash.edited(every).count() == 5
    one = order_minhash.edited(docs(spark, ["ab cd"])).first()
    assert one["edited"] == "ab ab" and order_minhash.edited(docs(spark, [])).count() == 0
    assert sha("") == sha("")


def every_key(spark, texts):
    """Signatures from the keys of all numbered k-mers in all orders."""
    rows = []
    for doc, text in enumerate(texts):
        w, seen = text.split(), {}
        for i in range(max(1, len(w) - 1)):
            pair = tuple(w[i : i + 2])
            seen[pair] = seen.get(pair, 0) + 1
            rows.append((doc, i, pair[0], pair[1] if len(pair) > 1 else None, seen[pair]))
    keys = spark.createDataFrame(rows, "doc long, place int, a string, b string, number int")
    keys = keys.withColumn("x", F.xxhash64(F.xxhash64("a", "b"), "number"))
    keys = keys.crossJoin(spark.range(order_minhash.SIGNATURES).select(F.col("id").cast("int").alias("turn")))
    keys = keys.withColumns({
        "slot": F.expr("((shiftrightunsigned(x, 58) + turn * ((shiftright(x, 51) & 63) | 1)) & 63)"),
        "time": F.expr("(if(turn = 0, x, xxhash64(x, turn)) & ((1L << 51) - 1))"),
    })
    least = F.slice(F.array_sort(F.collect_list(F.struct("turn", "time", "place", "x"))), 1, 2)
    least = keys.groupBy("doc", "slot").agg(least.alias("two"), F.count("*").alias("n"))
    two = F.array_sort(F.transform("two", lambda t: F.struct(t["place"], t["x"])))
    entry = F.when(F.col("n") == 1, F.hash(two[0]["x"])).otherwise(F.hash(two[0]["x"], F.get(two, 1)["x"]))
    out = {}
    for r in least.select("doc", "slot", "n", entry.bitwiseAND(F.lit(0xFFFF)).alias("e")).orderBy("slot").collect():
        out.setdefault(r["doc"], []).append(r["e"])
    return out


@pytest.mark.parametrize("reach", [order_minhash.REACH, 4])
def test_every_order_looks_at_all_numbered_words(spark, monkeypatch, reach):
    monkeypatch.setattr(order_minhash, "REACH", reach)
    rng = random.Random(4)
    sizes = (1, 2, 3, 4, 15, 16, 40, 200, 900, 2500)
    texts = [" ".join(f"w{rng.randrange(4000)}" for _ in range(n)) for n in sizes]
    texts += ["a b " * 300 + texts[7], "again " * 1200, " ".join(f"l{i % 7}" for i in range(150))]
    rows = order_minhash.with_signature(docs(spark, texts), "text", "s").select("doc_id", "s").collect()
    assert {r["doc_id"]: list(r["s"]) for r in rows} == every_key(spark, texts)


def test_one_frequent_pair_does_not_stand_for_the_text(spark):
    rng = random.Random(5)
    for pair in range(12):  # whatever the hash of the pair
        often = f"p{pair} q{pair} " * 80
        one, two = (" ".join(f"{c}{rng.randrange(9000)}" for _ in range(1500)) for c in "vw")
        some = docs(spark, [often + one, often + two])
        a, b = (r["s"] for r in order_minhash.with_signature(some, "text", "s").orderBy("doc_id").collect())
        assert sum(x == y for x, y in zip(a, b)) < 10
