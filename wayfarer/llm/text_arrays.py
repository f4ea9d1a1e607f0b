"""Numpy views of Arrow text columns: bytes, words and rolling hashes.

Everything works on one flat byte buffer with document offsets, so a batch of
documents costs a few array passes and no Python loop over words.  Hashes are
polynomials over random 64-bit byte codes modulo 2**64, taken from prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; longer documents are a piece of their own.
PIECE_BYTES = 1 << 20

#: Word separators: space and the six ASCII controls from tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else \
        np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Cut a batch into runs of whole documents of about ``limit`` bytes.

    Yields (first document, bytes, offsets from 0).
    """
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, first + 20_000, n)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """Hashes of byte ranges by prefix sums; tables grow with the longest buffer seen."""

    def __init__(self, seed: int = 1):
        self.codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(BASE, -1, 1 << 64)
            up = np.full(size, np.uint64(BASE), np.uint64)
            down = np.full(size, np.uint64(inverse), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each range, the same wherever it stands."""
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])


def _separator_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SEPARATORS)] = True
    return table


IS_SEPARATOR = _separator_table()


def words(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, document) of every word; words never span documents."""
    inside = ~IS_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, doc: np.ndarray, size: int):
    """(hash, first word, document) of every run of ``size`` words inside a document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:n] == doc[size - 1:])
    out = np.zeros(len(first), np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD6E8FEB86659FD93 + 1 & MASK
        out += hashes[first + k] * np.uint64(factor | 1)
    return mix(out), first, doc[first]


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of per-byte values over each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes, so all other characters, stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
