import random
import re

import numpy as np
import pyarrow as pa

from tests.llm import brute
from wayfarer.llm.anchors import runs, sliding_minimum
from wayfarer.llm.run_index import RunIndex
from wayfarer.llm.text_arrays import Hasher, flat, pieces, windows, words


def test_flat_reads_slices_and_nulls():
    column = pa.array(["ab", None, "", "çd", "e"])
    data, offsets = flat(column.slice(1, 3))
    assert bytes(data) == "çd".encode() and offsets.tolist() == [0, 0, 0, 3]
    data, offsets = flat(pa.array([], pa.string()))
    assert len(data) == 0 and offsets.tolist() == [0]
    data, offsets = flat(pa.array([None, None], pa.string()))
    assert offsets.tolist() == [0, 0, 0]


def test_pieces_cover_every_document(texts):
    data, offsets = flat(pa.array(texts))
    got = [bytes(d[o[i]:o[i + 1]]) for _, d, o in pieces(data, offsets, 5000) for i in range(len(o) - 1)]
    assert got == [(t or "").encode() for t in texts]


def test_words_are_the_pattern_s(texts):
    data, offsets = flat(pa.array(texts))
    starts, ends, doc = words(data, offsets)
    got = [(int(d), bytes(data[a:b])) for a, b, d in zip(starts, ends, doc)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in brute.WORD.findall((t or "").encode())]


def test_window_hashes_are_equal_for_equal_words_only(texts):
    data, offsets = flat(pa.array(texts))
    hasher = Hasher(2)
    starts, ends, doc = words(data, offsets)
    grams, first, of = windows(hasher.ranges(hasher.prefix(data), starts, ends), doc, 3)
    all_words = [bytes(data[a:b]) for a, b in zip(starts, ends)]
    named = {}
    for g, f in zip(grams.tolist(), first):
        assert named.setdefault(g, tuple(all_words[f:f + 3])) == tuple(all_words[f:f + 3])
    assert len(named) == len({tuple(all_words[f:f + 3]) for f in first})


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 50, 200)
    for width in (1, 2, 3, 7, 8, 169):
        assert sliding_minimum(x, width).tolist() == [x[i:i + width].min() for i in range(201 - width)]


def test_runs_hold_every_window_once_and_equal_windows_share_a_key(texts):
    data, offsets = flat(pa.array(texts))
    key, content, doc, start, end, anchor, again = runs(data, offsets, Hasher(4), 50, 8)
    seen, keys, own = {}, {}, {}
    for k, d, a, b, at, more in zip(key, doc, start, end, anchor, again):
        assert a <= at and at + 8 <= b
        inside = set()
        for s in range(a, b - 49):
            assert offsets[d] <= s and s + 50 <= offsets[d + 1]
            assert (d, s) not in seen
            seen[d, s] = 1
            text = bytes(data[s:s + 50])
            assert keys.setdefault(text, k) == k
            assert more or text not in inside
            inside.add(text)
    assert len(seen) == sum(max(0, int(n) - 49) for n in np.diff(offsets))


def test_run_index_against_enumeration():
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice([b"ab", b"a", b"abcd", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(50))
        strings = []
        for _ in range(rng.randint(1, 7)):
            s = bytes(rng.choice(letters) for _ in range(rng.randint(0, 25)))
            at = rng.randint(0, 30)
            strings.append(s + base[at:at + rng.randint(0, 20)])
        least = rng.choice([1, 2, 5, 9])
        count = {}
        for s in strings:
            for i in range(len(s) - least + 1):
                count[s[i:i + least]] = count.get(s[i:i + least], 0) + 1
        got = RunIndex(strings).long_matches(least)
        for s, ranges in zip(strings, got):
            want = bytearray(len(s))
            for i in range(len(s) - least + 1):
                if count[s[i:i + least]] > 1:
                    want[i:i + least] = b"\1" * least
            have = bytearray(len(s))
            for a, b in ranges:
                have[a:b] = b"\1" * (b - a)
            assert have == want


def test_run_index_runs_are_few_for_repetitive_strings():
    unit = bytes(np.random.default_rng(1).integers(97, 123, 300, dtype=np.uint8))
    assert RunIndex([unit] * 40).runs < 700 < len(unit) * 40 / 10


def test_separators_are_the_pattern_s():
    assert [c for c in range(128) if re.fullmatch(r"[^\x20\x09-\x0D]", chr(c)) is None] == [9, 10, 11, 12, 13, 32]
