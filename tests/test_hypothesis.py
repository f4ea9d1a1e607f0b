"""Column functions against plain Python on random inputs."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wayfarer.functions import sequences as S
from wayfarer.operators import quantiles

lists = st.lists(st.sampled_from(list("abcd")), min_size=0, max_size=7)


def py_contains(seq, pat):
    it = iter(seq)
    return all(c in it for c in pat)


def py_prefix(a, b):
    n = min(len(a), len(b))
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), n)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(lists, lists), min_size=1, max_size=30))
def test_array_functions_match_python(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    rows = df.select("a", "b", S.contains_in_order("a", "b").alias("c"),
                     S.common_prefix_length("a", "b").alias("d"),
                     S.divergence_score("a", "b").alias("s")).collect()
    for r in rows:
        assert r.c == py_contains(r.a, r.b)
        d = py_prefix(r.a, r.b)
        assert r.d == d
        if min(len(r.a), len(r.b)) == 0:
            assert r.s is None
        else:
            tail = (len(r.a) - d + len(r.b) - d) / (len(r.a) + len(r.b) - d)
            assert r.s == pytest.approx((d / min(len(r.a), len(r.b))) ** 2 / (tail + 1))


@pytest.mark.parametrize("vals", [[5.0], [1.0, 2.0], [3.0, 3.0, 3.0], [2.0, 1.0, 10.0, 20.0]])
def test_exact_percentile_small(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for q in (0.0, 0.1, 0.5, 0.95, 1.0):
        assert quantiles.exact_percentile(df, "v", q) == pytest.approx(np.percentile(vals, q * 100))


def test_rank_fallback_path(spark, monkeypatch):
    # A tiny accuracy makes the approximate bracket miss; the exact fallback
    # (a distributed sort with indices) must still give the order statistics.
    monkeypatch.setattr(quantiles, "ACCURACY", 1)
    rng = np.random.default_rng(8)
    vals = rng.normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = quantiles.values_at_ranks(df, "v", [0, 17, 250, 499])
    s = np.sort(vals)
    assert got == {0: s[0], 17: s[17], 250: s[250], 499: s[499]}


seq_lists = st.lists(st.lists(st.sampled_from(list("abcd")), min_size=1, max_size=5),
                     min_size=3, max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seq_lists, st.integers(min_value=1, max_value=3))
def test_closed_mining_matches_enumeration(spark, lists, min_freq):
    from tests.test_patterns import brute_closed, mine
    assert mine(spark, lists, min_freq, 1) == brute_closed(lists, min_freq, 1)


pattern_sets = st.dictionaries(st.tuples(*[st.sampled_from("ABC")] * 1).flatmap(
    lambda first: st.lists(st.sampled_from("ABC"), min_size=0, max_size=3).map(
        lambda rest: tuple(first) + tuple(rest))), st.integers(min_value=1, max_value=3),
    min_size=1, max_size=10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pattern_sets, pattern_sets, st.integers(min_value=1, max_value=12))
def test_top_divergence_matches_all_pairs(spark, non, conv, top_n):
    from tests.test_divergence import brute_top, frames
    from wayfarer.operators import divergence as D
    non_l = [(list(p), f) for p, f in non.items()]
    conv_l = [(list(p), f) for p, f in conv.items()]
    want, total = brute_top(non_l, conv_l, top_n)
    n_df, c_df = frames(spark, non_l, conv_l)
    got = [(r.conversion_seq, r.non_conversion_seq, r.diversion, r.non_conv_freq)
           for r in D.top_divergence(n_df, c_df, top_n).collect()]
    assert got == [(w[0], w[1], w[2], w[4]) for w in want]
    assert D.divergence_count(n_df, c_df).first()[0] == total
