"""Token ids of the texts of a batch, by the byte-level BPE of a ``tokenizers`` file.

Byte-level BPE works on pieces of text that a fixed pattern cuts; equal pieces have equal ids. The pieces
of a batch are found with array operations, each different piece is encoded once (and kept by the worker),
and the ids of the texts are gathered.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

from crosslume.llm.words import buffers, mix, release, span_hashes

TOKENIZER = "byte_bpe_50k.json"

# White space in the sense of Unicode, the endings the pattern keeps with an apostrophe.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KEEP = 1 << 17  # pieces a worker remembers within a task
_tables: dict[str, np.ndarray] = {}
_encoders: dict[str, Encoder] = {}


def _kinds() -> np.ndarray:
    """Kind of every code point."""
    if "kinds" not in _tables:
        first = {"L": _LETTER, "N": _NUMBER}
        kinds = np.array([first.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)], np.uint8)
        kinds[_WHITE] = _SPACE
        _tables["kinds"] = kinds
    return _tables["kinds"]


def pieces(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of documents that begin at ``first``.

    A piece is an apostrophe with an ending, a run of letters, of numbers or of other signs (each with one
    blank before it), or white space but for the last sign before something else.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head = head[:n]
    begin = head.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(begin & ~head & (kind != _SPACE))
    after = after[kind[after - 1] == _SPACE]
    begin[after - 1] = True
    begin[after[points[after - 1] == 32]] = False
    at = np.flatnonzero(begin & (points == 39))
    at = at[at + 1 < n]
    at = at[~head[at + 1] & (kind[at + 1] == _LETTER)]
    if len(at):
        padded = np.append(points, 0)
        one, two = padded[at + 1], np.where(np.append(head, True)[at + 2], 0, padded[np.minimum(at + 2, n)])
        length = np.zeros(len(at), np.int64)
        for ending in reversed(_ENDINGS):
            same = one == ord(ending[0])
            if len(ending) == 2:
                same &= two == ord(ending[1])
            length[same] = len(ending) + 1
        at, length = at[length > 0], length[length > 0]
        begin[at + 1] = False
        stop = at + length
        begin[stop[stop < n]] = True
    return np.flatnonzero(begin)


def _ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary, whose files write every byte as a printable sign."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(0x100) if b not in set(plain))}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


class Encoder:
    """A byte-level BPE file of ``tokenizers`` with the ids of pieces met so far.

    The file is read by ``tokenizers``; as its ids are in the order of the merges, ``tiktoken`` gives the
    same ids from its vocabulary, several times as fast. Pieces are encoded joined by zero bytes.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ranks = _ranks(self.tokenizer.get_vocab(with_added_tokens=False))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        for token in special:
            ranks.pop(token.encode(), None)
        self.zero = ranks[b"\0"]
        self.merges = tiktoken.Encoding("pieces", pat_str="[^\0]+|\0", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _learn(self, keys: list[int], texts: list[str]) -> None:
        joined = "\0".join(texts)
        if joined.count("\0") == len(texts) - 1:
            ids = np.array(self.merges.encode_ordinary(joined) + [self.zero], np.uint32)
            stop = np.flatnonzero(ids == self.zero)
            size = np.diff(stop, prepend=-1) - 1
            ids = np.delete(ids, stop)
        else:  # texts with zero bytes
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            size = np.array([len(x) for x in found], np.int64)
            ids = np.array([i for x in found for i in x], np.uint32)
        known = len(self.place)
        while known + len(keys) > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.begin[known : known + len(keys)] = self.used + np.cumsum(size) - size
        self.size[known : known + len(keys)] = size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(keys, range(known, known + len(keys))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, and where each text's ids begin (null is empty)."""
        import pandas as pd

        data, offsets = buffers(column)
        text = data.tobytes().decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # The code points before a byte are the bytes before it that begin one.
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = leads[offsets]
        begins = pieces(points, first[:-1][first[1:] > first[:-1]])
        ends = np.append(begins[1:], len(points))
        hashes = span_hashes(mix(points.astype(np.uint64)), begins, ends)
        code, different = pd.factorize(hashes.view(np.int64))
        if len(self.place) > _KEEP:
            self.forget()
        keys = different.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            where = np.zeros(len(keys), np.int64)
            where[code] = np.arange(len(code))
            spans = zip(begins[where[new]].tolist(), ends[where[new]].tolist())
            self._learn([keys[i] for i in new], [text[a:b] for a, b in spans])
        place = np.array([self.place[k] for k in keys], np.int64)[code] if keys else np.zeros(0, np.int64)
        size = self.size[place]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.ids[np.repeat(self.begin[place] - (stop - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], stop])[np.searchsorted(begins, first)]


def forget_pieces() -> None:
    """To be called at the end of a task: workers are kept for others."""
    for known in _encoders.values():
        known.forget()
    release()


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
