import itertools
import random

import pytest

from wayfarer.operators import patterns as P


def brute_closed(lists, min_freq, min_len):
    support = {}
    for i, s in enumerate(lists):
        seen = set()
        for r in range(1, len(s) + 1):
            for idx in itertools.combinations(range(len(s)), r):
                seen.add(tuple(s[j] for j in idx))
        for p in seen:
            support[p] = support.get(p, 0) + 1
    freq = {p: f for p, f in support.items() if f >= min_freq}

    def sub(p, q):
        it = iter(q)
        return all(c in it for c in p)

    out = {}
    for p, f in freq.items():
        if any(len(q) > len(p) and fq == f and sub(p, q) for q, fq in freq.items()):
            continue
        if len(p) >= min_len:
            out[p] = f
    return out


def mine(spark, lists, min_freq, min_len, closed=True):
    df = spark.createDataFrame([(s,) for s in lists], "activity_list array<string>")
    rows = P.frequent_sequences(df, min_freq=min_freq, min_len=min_len, closed=closed).collect()
    return {tuple(r.sequence): r.freq for r in rows}


GOLD = [list("abc"), list("ac"), list("ab"), list("bc"), list("abcd")]


def test_golden_min3(spark):
    assert mine(spark, GOLD, 3, 1) == {("a",): 4, ("b",): 4, ("c",): 4, ("a", "b"): 3,
                                       ("a", "c"): 3, ("b", "c"): 3}


def test_golden_min2(spark):
    got = mine(spark, GOLD, 2, 1)
    assert got[("a", "b", "c")] == 2 and len(got) == 7


def test_golden_closed(spark):
    assert mine(spark, [list("abc"), list("abc"), list("ab")], 2, 1) == {
        ("a", "b"): 3, ("a", "b", "c"): 2}


@pytest.mark.parametrize("seed", range(6))
def test_random_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    items = list("abcdefg")
    lists = []
    for _ in range(25):
        n = rnd.randint(1, 7)
        lists.append(rnd.sample(items, n) if seed % 2 == 0 else
                     [rnd.choice(items) for _ in range(n)])
    for min_freq, min_len in ((2, 1), (4, 2)):
        assert mine(spark, lists, min_freq, min_len) == brute_closed(lists, min_freq, min_len)


def test_support_matches_brute_force(spark):
    rnd = random.Random(7)
    lists = [rnd.sample(list("abcdefg"), rnd.randint(1, 6)) for _ in range(40)]
    pats = [list(p) for p in ("ab", "ba", "abc", "g", "fed", "a")]
    sdf = spark.createDataFrame([(i, s) for i, s in enumerate(lists)],
                                "user_id int, activity_list array<string>")
    pdf = spark.createDataFrame([(p,) for p in pats], "sequence array<string>")
    got = {tuple(r.sequence): r.support for r in P.sequence_support(sdf, pdf).collect()}

    def sub(p, q):
        it = iter(q)
        return all(c in it for c in p)

    assert got == {tuple(p): sum(sub(p, s) for s in lists) for p in pats}


def test_empty_and_too_rare(spark):
    assert mine(spark, [list("ab")], 5, 1) == {}


@pytest.mark.parametrize("seed,top_n,min_len,closed", [(1, 3, 2, True), (2, 8, 1, True), (3, 500, 2, True),
                                                       (4, 5, 3, False), (5, 1, 4, True)])
def test_top_patterns_are_those_of_mining_everything(spark, seed, top_n, min_len, closed):
    rnd = random.Random(seed)
    lists = [[rnd.choice("aabbbcdef") for _ in range(rnd.randrange(7))] for _ in range(40)] + [None]
    df = spark.createDataFrame([(s,) for s in lists], "activity_list array<string>")
    every = P.with_text(P.frequent_sequences(df, min_freq=2, min_len=min_len, closed=closed)).collect()
    want = sorted((tuple(r) for r in every), key=lambda r: (-r[1], r[0]))[:top_n]
    got = P.top_sequences(df, top_n, min_freq=2, min_len=min_len, closed=closed).collect()
    assert [tuple(r) for r in got] == want


def test_top_patterns_do_not_mine_what_they_do_not_show(spark, monkeypatch):
    lists = [list("abcdefghij")] * 30 + [[f"x{i}{j}" for j in range(4)] for i in range(40) for _ in range(2)]
    mined = []
    whole = P.Miner.mine
    monkeypatch.setattr(P.Miner, "mine", lambda self, at: mined.append(at) or whole(self, at))
    df = spark.createDataFrame([(s,) for s in lists], "activity_list array<string>")
    got = P.top_sequences(df, 1, min_freq=2).collect()
    assert [tuple(r) for r in got] == [(" -> ".join("abcdefghij"), 30, 10)] and mined == [30]
    assert P.top_sequences(df.limit(0), 5, min_freq=2).collect() == []
