"""Content anchors: each window of a text is filed under its smallest gram hash.

Equal windows hold equal grams, so they have the same smallest one and meet under
the same key wherever they stand.
"""

from __future__ import annotations

import numpy as np

from wayfarer.llm.text_arrays import Hasher

TIE_BITS = 20
TIE_MASK = (1 << TIE_BITS) - 1
SPREAD = 0x9E375
UNSPREAD = pow(SPREAD, -1, 1 << TIE_BITS)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def runs(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, window: int, gram: int):
    """(key, content hash, document, start, end, anchor, again) of the runs of windows with one anchor.

    A run's range holds exactly the windows that start in it and are filed under
    its anchor; every window of a document lies in one run.  Of equal hashes in a
    window an arbitrary one (by a scrambled position) is taken: that keeps runs
    long in periodic text, and the key is the same.  ``again`` tells whether a
    window of the run holds its smallest hash more than once: only then can a run
    repeat a window of its own.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty, \
            empty.astype(bool)
    prefix = hasher.prefix(data)
    at = np.arange(len(data) - gram + 1)
    key = hasher.ranges(prefix, at, at + gram)
    key &= np.uint64(~TIE_MASK & (1 << 64) - 1)
    key |= (at * SPREAD & TIE_MASK).astype(np.uint64)
    least = sliding_minimum(key, window - gram + 1)
    key ^= np.uint64(TIE_MASK)  # the other way round among equal hashes
    twice = sliding_minimum(key, window - gram + 1) != least ^ np.uint64(TIE_MASK)
    # Windows inside one document: starts up to its end less the window.
    change = np.zeros(len(least) + 1, np.int64)
    first, last = offsets[:-1], offsets[1:] - window
    fits = last >= first
    np.add.at(change, first[fits], 1)
    np.add.at(change, last[fits] + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begins[first[fits]] = True
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, starts, "right") - 1
    following = np.append(starts[1:], len(least))
    ends = np.minimum(following - 1, offsets[doc + 1] - window) + window
    counted = np.concatenate([[0], np.cumsum(twice & valid)])
    again = counted[ends - window + 1] > counted[starts]
    chosen = least[starts]
    low = (chosen & np.uint64(TIE_MASK)).astype(np.int64) * UNSPREAD & TIE_MASK
    anchor = starts + ((low - starts) & TIE_MASK)
    return chosen >> np.uint64(TIE_BITS), hasher.ranges(prefix, starts, ends), doc, starts, ends, anchor, again
