"""Small fixtures and brute-force versions for the training-data operators."""

import collections
import hashlib
import itertools
import random
import re

DOCS = "doc_id long, text string, extra string, n long, key long"


def words(rng, n, size=200):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows; extra columns with names that operators use inside."""
    rng = random.Random(5)
    base = words(rng, 60)
    texts = [None, "", " \t\n", "one", "One two", base, base, base.upper(), base + " tail", base.replace("w1", "x1", 1), "x" * 5000,
             words(rng, 30_000, 5000), "é ß 漢字 😀 " * 30, "a b c d e", "A B C D E"]
    rows = [(i, t, "e", 7, 9) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id here at all", None, None, None), (None, None, None, None, None), (3, "another text of three", None, 1, 1)]


def shingles(text, size=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard_components(rows, percent=75):
    """{doc: (shingles, component)} for (doc, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    u = Union(sets)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def cut_repeats(texts, length):
    """[(bytes left, removed, runs)] with every covered byte of a repeated window removed."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((bytes(x for x, g in zip(t, gone) if not g), sum(gone), runs))
    return out


def sha256(data):
    return hashlib.sha256(data).hexdigest()
