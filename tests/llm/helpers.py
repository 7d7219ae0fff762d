"""Small tables and brute-force versions of the operators."""

import hashlib
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, first=0):
    """A documents table of (doc_id, text) or texts."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACE.findall(text or "")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminated(rows, items, window=13):
    """doc_id: (n_words, n_hit, item names, contaminated)."""
    patterns = {}
    for name, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    out = {}
    for doc, text in rows:
        w, hit, names = item_words(text), set(), set()
        for pattern, own in patterns.items():
            n = len(pattern)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == pattern:
                    hit.update(range(i, i + n))
                    names |= own
        out[doc] = (len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def without_repeats(rows, window=35):
    """doc_id: (n_words, n_removed, sha256 of what is left)."""
    texts = [(i, words(t)) for i, t in rows]
    seen = {}
    for _, w in texts:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            seen[key] = seen.get(key, 0) + 1
    out = {}
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


def groups(rows, size, percent=80):
    """doc_id: (n_shingles, least reachable doc_id)."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if y < x and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}
