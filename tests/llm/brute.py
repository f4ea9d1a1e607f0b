"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def shingles(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def near_duplicates(rows, percent=85):
    """{id: (set size, component)} of (id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    groups, ids = Groups(sets), sorted(sets)
    for k, x in enumerate(ids):
        for y in ids[k + 1:]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                groups.join(x, y)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def removal(texts, window=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of every text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if count[r[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def base_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen, covered = defaultdict(list), set()
    for i in range(len(words) - 2):
        seen[tuple(words[i:i + 3])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(3))
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def pieces(streams, window=1024):
    """[(doc, start, length, ids, doc tokens, sequence, offset)] of (doc, ids) in stream order."""
    out, at = [], 0
    for doc, ids in streams:
        start = 0
        while start < len(ids):
            sequence, offset = divmod(at + start, window)
            length = min(window - offset, len(ids) - start)
            out.append((doc, start, length, tuple(ids[start:start + length]), len(ids), sequence, offset))
            start += length
        at += len(ids)
    return out
