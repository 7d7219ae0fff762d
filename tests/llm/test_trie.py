"""The trie of conversations against one that is built in memory."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import words

from crosslume.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def built(rows):
    """conv_id: its rebuilt turns."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    talks = {c: [t[1:] for t in sorted(own, key=lambda t: t[0])] for c, own in said.items()}
    out = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = talks.get(base, [])[:h] + talks[c][h:]
    return out


def nodes(rows):
    talks = built(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[tuple(talks[c][:d])].append(c)
        ends[tuple(talks[c])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        own = (len(members[key]) - 1) * len(words(key[-1][1])) if key else 0
        saved[key] = own + sum(saved[k] for k in kids[key])
    return sorted(
        (
            (
                members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k],
                saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest(),
            )
            for k in members
        ),
        key=str,
    )


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    trie = prefix_trie.trie(df, **options)
    assert trie.columns == COLUMNS
    return sorted((tuple(r) for r in trie.collect()), key=str)


def talks(seed, n, vocabulary, longest=6):
    random = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(random.integers(1, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "word " * int(random.integers(0, vocabulary))))
    return rows


@pytest.mark.parametrize("vocabulary", [2, 4, 50])
def test_trie_equals_one_in_memory(spark, vocabulary):
    rows = talks(vocabulary, 120, vocabulary)
    assert found(spark, rows) == nodes(rows)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    rows = talks(9, 90, 5)
    monkeypatch.setattr(prefix_trie, "FEWEST_CELLS", 8)
    for cells in (8, 64, 1 << 12):
        assert found(spark, rows, most_cells=cells) == nodes(rows)


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "no id"), (0, 1, "user", "b"), (0, None, "user", "first"), (20, 0, None, None), (20, 1, "", ""),
        (21, 0, "user", "x"), (41, 0, "user", "own only"), (-7, 0, "user", "low"), (-7, 1, "a", "low"), (-20, 0, "u", "base"),
        (65, 0, "u", "turn"), (62, 0, "u", "alone without a base"), (3, 0, "a,b", "\x00"), (3, 2, "é", "long " * 30000),
        (4, 1, "u", "same"), (4, 1, "u", "same"), (5, 1, "u", "same"), (2**62, 0, "u", "big"),
    ]
    assert found(spark, rows) == nodes(rows)
    assert found(spark, []) == found(spark, rows[:1]) == []


def test_a_group_of_equal_talks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(4)]
    rows += [(c, 0, "user", "short") for c in range(300, 340)]
    got = found(spark, rows)
    assert got == nodes(rows) and max(r[3] for r in got) == 340


def test_a_conversation_of_many_turns(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2, 3) for t in range(700 + c)]
    assert found(spark, rows) == nodes(rows)


def test_estimates_never_miss(spark):
    keys = [hashlib.blake2b(str(i % 700).encode(), digest_size=16).digest() for i in range(1000)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    size = 1 << 10
    bits = prefix_trie.sketch(df, size)
    numbers = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    several = prefix_trie.several(bits, numbers, size)
    assert all(several[i] for i in range(1000) if i % 700 < 300)
    assert not several.all()
