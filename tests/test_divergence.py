import random

import pytest

from wayfarer.operators import divergence as D


def score(n, c):
    length = min(len(n), len(c))
    d = next((i for i, (a, b) in enumerate(zip(n, c)) if a != b), length)
    tail = (len(n) - d + len(c) - d) / (len(n) + len(c) - d)
    return d, (d / length) ** 2 / (tail + 1)


def brute_top(non, conv, top_n):
    rows = []
    for n, f in non:
        for c, _ in conv:
            d, s = score(n, c)
            if d < len(n) and d < len(c):
                rows.append((" -> ".join(c), " -> ".join(n), n[d], s, f, s * f))
    rows.sort(key=lambda r: (-r[5], -r[4], r[1], r[0]))
    return rows[:top_n], len(rows)


def frames(spark, non, conv):
    schema = "sequence array<string>, freq bigint"
    return spark.createDataFrame(non, schema), spark.createDataFrame(conv, schema)


@pytest.mark.parametrize("seed,top_n", [(0, 5), (1, 15), (2, 40), (3, 200)])
def test_top_matches_all_pairs(spark, seed, top_n):
    rnd = random.Random(seed)
    vocab = list("abcde")

    def pats(k):
        out = {}
        while len(out) < k:
            p = tuple(rnd.choice(vocab) for _ in range(rnd.randint(1, 5)))
            out[p] = rnd.randint(1, 4)
        return [(list(p), f) for p, f in out.items()]

    non, conv = pats(25), pats(30)
    want, total = brute_top(non, conv, top_n)
    n_df, c_df = frames(spark, non, conv)
    got = [(r.conversion_seq, r.non_conversion_seq, r.diversion, r.divergence_score,
            r.non_conv_freq, r.weight) for r in D.top_divergence(n_df, c_df, top_n).collect()]
    assert [g[:3] + (g[4],) for g in got] == [w[:3] + (w[4],) for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], abs=1e-12)
    assert D.divergence_count(n_df, c_df).first()[0] == total


def test_zero_score_fill(spark):
    non = [(list("ZBC"), 2)]
    conv = [(list("AB"), 1), (list("AC"), 1)]
    n_df, c_df = frames(spark, non, conv)
    got = D.top_divergence(n_df, c_df, 10).collect()
    assert [(r.conversion_seq, r.diversion, r.divergence_score) for r in got] == [
        ("A -> B", "Z", 0.0), ("A -> C", "Z", 0.0)]


def test_prefix_pairs_dropped(spark):
    n_df, c_df = frames(spark, [(list("AB"), 3)], [(list("ABC"), 1), (list("ABX"), 1)])
    assert D.top_divergence(n_df, c_df, 10).count() == 0
    n_df, c_df = frames(spark, [(list("ABCD"), 2)], [(list("ABX"), 1)])
    r = D.top_divergence(n_df, c_df, 10).first()
    assert r.diversion == "C" and r.divergence_score == pytest.approx(0.27778, abs=1e-5)
    assert r.weight == pytest.approx(2 * 0.2777777777777778)


def test_min_prefix_drops_zero_scores(spark):
    non = [(list("ZBC"), 2), (list("ABD"), 1)]
    conv = [(list("AB"), 1), (list("AC"), 1)]
    n_df, c_df = frames(spark, non, conv)
    got = D.top_divergence(n_df, c_df, 10, min_prefix=1).collect()
    assert [(r.non_conversion_seq, r.conversion_seq) for r in got] == [("A -> B -> D", "A -> C")]


def test_large_pattern_tables_are_not_broadcast(spark, tmp_path, capsys):
    """Stored patterns look small on disk: the joins must not send them whole to every task."""
    rows = [(["x", a, b], 2) for a in "abcdef" for b in "ghijkl"]
    frames(spark, rows, rows[:20])[0].write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    other = stored.withColumn("sequence", stored["sequence"])
    for df in (*D.split_shared(stored, other), D.divergence_classes(stored, other), D.divergence_count(stored, other)):
        df.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_pruned_classes_keep_ties_of_one_text(spark):
    # Two patterns of one text (an item holds the separator) and many of the same freq.
    non = [(["A", "B -> C", "D"], 2), (["A", "B", "C -> D"], 2)] + [(["A", "B", x], 1) for x in "EFGH"]
    conv = [(["A", "Q", "R"], 1), (["A", "Q"], 1)]
    n_df, c_df = frames(spark, non, conv)
    full = D.divergence_classes(n_df, c_df)
    first = D.divergence_classes(n_df, c_df, 1)
    assert first.count() < full.count()
    got = [(r.non_conversion_seq, r.diversion, r.weight) for r in D.top_divergence(n_df, c_df, 1).collect()]
    best = max(r["weight"] for r in full.collect())
    assert got[0][0] == "A -> B -> C -> D" and got[0][2] == best
