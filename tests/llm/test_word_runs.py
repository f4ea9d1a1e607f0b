import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wayfarer.llm import word_runs as W

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """Stretches of equal words p apart, for every p; equal stretches keep the smallest p."""
    found = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = min(((-m, s, p) for s, m, p in runs), default=None)
    best = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    return (len(runs), *best, hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def found(documents, least=12):
    got = [[] for _ in documents]
    for d, *run in zip(*(c.tolist() for c in W.find_runs([np.array(x, np.int64) for x in documents], least))):
        got[d].append(tuple(run))
    return got


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_runs_of_odd_sequences():
    docs = [[], [1], [7] * 11, [7] * 12, [7] * 500, [1, 2] * 6, [1, 2] * 5 + [1], [1, 2] * 40 + [3] * 40,
            fibonacci(300), [0, 1, 1, 0] * 9, list(range(50)) * 2, list(range(50)) * 2 + [0], [5] + [1, 2, 3] * 9 + [5],
            ([1] * 13 + [2]) * 4, list(range(30)) + list(range(29)), [int(bin(i).count("1") % 2) for i in range(256)]]
    assert found(docs) == [plain_runs(d) for d in docs]
    for d in docs:
        assert found([d]) == [plain_runs(d)]
    assert found(docs, 2) == [plain_runs(d, 2) for d in docs]


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(60):
        kinds = rng.choice([1, 2, 2, 3, 8, 100])
        d = [rng.randrange(kinds) for _ in range(rng.choice([0, 5, 12, 40, 150, 400]))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(d) + 1), rng.randint(1, 30)
            d[at:at] = (d[at:at + p] or [1]) * rng.randint(2, 8)
        docs.append(d)
    assert found(docs) == [plain_runs(d) for d in docs]


def test_extensions_are_those_of_the_words():
    rng = random.Random(5)
    words = [90]
    for k in range(8):
        words += [rng.randrange(2) for _ in range(60)] + [3] * 20 + [0, 1] * 15 + [91 + k]
    words = np.array(words, np.int64)
    grammar = W.Grammar(words, 90)
    a, b = np.array([(i, j) for i in range(1, len(words), 3) for j in range(i + 1, len(words), 5)]).T
    forward, back = grammar.extend(a, b), grammar.extend_back(a, b)
    text = words.tolist()
    for i, j, f, g in zip(a.tolist(), b.tolist(), forward.tolist(), back.tolist()):
        k = 0
        while j + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        assert f == k
        k = 0
        while i - k > 0 and text[i - k - 1] == text[j - k - 1]:
            k += 1
        assert g == k


def test_levels_shrink_and_end():
    words = np.concatenate([[1000], np.random.default_rng(1).integers(0, 900, 20_000), [1001]])
    grammar = W.Grammar(words, 1000)
    sizes = [len(level.letters) for level in grammar.levels]
    assert len(grammar.top) <= 4 and sizes == sorted(sizes, reverse=True) and sum(sizes) < 6 * len(words)


def test_rows_equal_brute_force(spark, documents, texts, monkeypatch):
    want = {i: plain_row(i, t) for i, t in enumerate(texts)}
    monkeypatch.setattr("wayfarer.session.read_table", lambda *_: documents)
    got = W.query(spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256") and c != "doc_id"} == {"bigint"}
    rows = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert rows == want
    assert any(r[0] for r in want.values()) and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in want)


def test_whole_small_table(spark):
    rows = {r[0]: tuple(r)[1:] for r in W.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert rows == {i: plain_row(i, t) for i, t in docs}


def test_nulls_names_pieces_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([("a b " * 20, 1, None), (None, None, "x"), ("", 2, "y"), ("\x1c é " * 12, 3, "z")],
                               "text string, word_runs int, n_words string")
    got = W.collapse_runs(df)
    assert got.columns == ["text", "word_runs", "n_words", "_word_runs"]
    by = {r[1]: r[3] for r in got.collect()}
    assert by[1]["runs"] == [(0, 40, 2)] and by[1]["collapsed"] == "a b"
    assert by[None] == (0, [], "") and by[2] == (0, [], "")
    assert by[3]["runs"] == [(0, 24, 2)] and by[3]["collapsed"] == "\x1c é"
    monkeypatch.setattr(W, "PIECE_WORDS", 3)
    assert {r[1]: r[3] for r in W.collapse_runs(df).collect()} == by
    assert W.collapse_runs(df.limit(0)).count() == 0
    wrapped = W.Wrapped("doc_id")
    assert wrapped(None, [b"a"]) == [b"a"] and wrapped(7, []) == []
