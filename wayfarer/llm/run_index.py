"""Run-length index of a set of byte strings.

The Burrows-Wheeler transform of the strings, each ended by a symbol of its own,
is kept as runs with the text positions of their first and last entries (the
sampled run ends).  They are enough for every position's matching statistics
against the rest of the set: inside a run neighbouring suffixes stay neighbours
when both move one symbol to the left, so a position's longest match elsewhere
is either found at a run end, by comparing the two sampled suffixes there, or it
is one less than that of the position before.
"""

from __future__ import annotations

import numpy as np

SYMBOL_BITS = 15


class RunIndex:
    """``data`` is the strings one after the other with one end byte behind each."""

    def __init__(self, strings: list[bytes]):
        self.length = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)[:-1]])
        self.data = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8)
        self.end = np.repeat(self.start + self.length, self.length + 1)  # of each position's string
        suffixes = self._sort()
        before = self._symbols()[suffixes - 1]
        boundary = np.flatnonzero(before[1:] != before[:-1]) + 1
        #: Text positions at both sides of every border between two runs.
        self.tails, self.heads = suffixes[boundary - 1], suffixes[boundary]
        self.runs = len(boundary) + 1

    def _symbols(self) -> np.ndarray:
        """Bytes above one end symbol a string; the end symbols sort by string."""
        n = len(self.start)
        out = self.data.astype(np.int64) + n
        out[self.start + self.length] = np.arange(n)
        return out

    def _sort(self) -> np.ndarray:
        """Suffix array by prefix doubling over the positions not yet told apart."""
        symbols = self._symbols()
        n = len(symbols)
        if symbols.max() >= 1 << SYMBOL_BITS:
            raise ValueError("too many strings in one index")
        padded = np.concatenate([symbols, np.zeros(3, np.int64)])
        key = padded[:n].copy()
        for k in (1, 2, 3):
            key = key << SYMBOL_BITS | padded[k:n + k]
        order = np.argsort(key, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        sorted_key = key[order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth = 4
        slots = self._tied(new)
        while len(slots):
            at = order[slots]
            group = rank[at]
            key = group * (n + 1) + rank[np.minimum(at + depth, n)] + 1
            moved = np.argsort(key, kind="stable")
            at, key = at[moved], key[moved]
            order[slots] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            depth *= 2
            slots = slots[self._tied(new)]
        return order

    @staticmethod
    def _tied(new: np.ndarray) -> np.ndarray:
        """Entries whose group has more than one member, from the marks of group starts."""
        last = np.concatenate([new[1:], [True]])
        return np.flatnonzero(~(new & last))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, inside their strings."""
        limit = np.minimum(self.end[a] - a, self.end[b] - b)
        words = np.lib.stride_tricks.sliding_window_view(
            np.concatenate([self.data, np.zeros(8, np.uint8)]), 8)
        found = np.zeros(len(a), np.int64)
        live = np.flatnonzero(limit > 0)
        while len(live):
            p, q = a[live] + found[live], b[live] + found[live]
            x = np.ascontiguousarray(words[p]).view(np.uint64)[:, 0]
            x ^= np.ascontiguousarray(words[q]).view(np.uint64)[:, 0]
            low = x & (~x + np.uint64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            found[live] += same
            live = live[(same == 8) & (found[live] < limit[live])]
        return np.minimum(found, limit)

    def match_lengths(self) -> np.ndarray:
        """For every position the longest prefix of its suffix that starts elsewhere too."""
        reach = np.zeros(len(self.data), np.int64)  # match length plus position
        common = self._common(self.tails, self.heads)
        np.maximum.at(reach, self.heads, self.heads + common)
        np.maximum.at(reach, self.tails, self.tails + common)
        at = np.arange(len(self.data))
        return np.maximum(np.maximum.accumulate(reach) - at, 0)

    def long_matches(self, least: int) -> list[list[tuple[int, int]]]:
        """Per string the ranges covered by substrings of ``least`` bytes that occur elsewhere too."""
        starts = self.match_lengths() >= least
        change = np.zeros(len(self.data) + least + 1, np.int64)
        where = np.flatnonzero(starts)
        np.add.at(change, where, 1)
        np.add.at(change, where + least, -1)
        covered = np.cumsum(change)[:len(self.data)] > 0
        edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out: list[list[tuple[int, int]]] = [[] for _ in self.start]
        for string, a, b in zip(np.searchsorted(self.start, first, "right") - 1, first, last):
            out[string].append((int(a - self.start[string]), int(b - self.start[string])))
        return out
