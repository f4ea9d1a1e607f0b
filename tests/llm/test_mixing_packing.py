import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wayfarer.llm import mixing, packing


def uniform(*parts):
    return int(hashlib.md5("|".join("-" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / 16 ** 13


def plain_copies(rows, weights, default, seed=mixing.SEED):
    """{(id, source): copies} by inverting each source's distribution."""
    count = Counter(s for _, s in rows)
    w = {s: weights.get(s, default) for s in count}
    out = {}
    for ident, s in rows:
        rate = len(rows) * (w[s] / sum(w.values())) / count[s] if sum(w.values()) > 0 else 0.0
        draws = max(1, math.ceil(rate / mixing.SPLIT))
        part, total = rate / draws, 0
        for j in range(1, draws + 1):
            u, k, p = uniform(f"count{seed}", ident, j), 0, math.exp(-part)
            c = p
            while c <= u:
                k += 1
                p = p * part / k
                c += p
            total += k
        out[ident, s] = total
    return out


@pytest.mark.parametrize("weights", [{}, {"a": 5.0, "b": 0.0}, {"a": 0.0, "b": 0.0, "c": 900.0}])
def test_copies_are_the_inverted_distribution(spark, weights):
    rows = [(i, "a" if i < 150 else "b" if i < 220 else "c" if i < 223 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = Counter((r["doc_id"], r["source"]) for r in
                  mixing.mix_sources(df, weights=weights, default_weight=1.0).collect())
    assert got == {k: n for k, n in plain_copies(rows, weights, 1.0).items() if n}


def test_large_rates_are_split(spark):
    rows = [(i, "big") for i in range(3000)] + [(9000, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix_sources(df, weights={"tiny": 1.0, "big": 1e-9})
    n = got.filter("source = 'tiny'").count()
    assert n == plain_copies(rows, {"tiny": 1.0, "big": 1e-9}, 1.0)[9000, "tiny"]
    assert 2500 < n < 3500


def test_shares_follow_the_weights_and_the_order_is_shuffled(spark):
    rows = [(i, "a" if i % 10 else "b", f"t{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, copy string")
    mixed = mixing.mix_sources(df, weights={"a": 1.0, "b": 1.0})
    assert mixed.columns == ["doc_id", "source", "copy", "n_copies", "_copy", "shuffle_key"]
    got = mixed.collect()
    share = np.mean([r["source"] == "a" for r in got])
    assert abs(share - 0.5) < 0.05 and abs(len(got) - 4000) < 300
    assert all(1 <= r["_copy"] <= r["n_copies"] for r in got)
    ids = [r["doc_id"] for r in got]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1
    assert mixed.collect() == got


def test_mixing_nulls_repeats_and_empty_tables(spark):
    rows = [(None, None, None), (1, None, "t"), (1, None, "t"), (1, "s", "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(df, default_weight=4.0).collect()
    # Equal rows are rows of their own: each of the four has its copies numbered from 1.
    firsts = Counter((r["doc_id"], r["source"]) for r in got if r["copy"] == 1)
    assert firsts[1, None] <= 2 and set(firsts) <= {(None, None), (1, None), (1, "s")}
    assert sum(r["n_copies"] for r in got if r["copy"] == 1) == len(got)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.mix_sources(df, weights={}, default_weight=0.0).count() == 0


def test_equal_rows_draw_and_are_dealt_out_one_by_one(spark):
    """Equal rows of a null id, and rows that differ in a map only."""
    rows = [(None, "t", "wiki", {"a": 1})] * 400 + [(None, "t", "wiki", {"a": 2})] * 3 + [(5, "u", "wiki", None)] * 40
    rows += [(i, "v", "wiki", None) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>").repartition(4)
    named = mixing.with_identity(df, "doc_id", "own")
    assert named.columns == [*df.columns, "own"] and named.count() == len(rows)
    assert named.select("own").distinct().count() == len(rows)
    assert named.filter(F.col("m")["a"] == 2).count() == 3
    assert {r["own"] for r in named.filter("doc_id >= 10").collect()} == {str(i) for i in range(10, 60)}
    mixed = mixing.mix_sources(df, weights={"wiki": 1.0})
    drawn = mixed.filter("doc_id is null").groupBy("shuffle_key").count()
    copies = [r["n_copies"] for r in mixed.filter("doc_id is null and copy = 1").collect()]
    assert len(set(copies)) > 2 and drawn.filter("count > 1").count() == 0


def test_rows_of_null_and_repeated_ids_draw_one_by_one(spark):
    """A third of the rows without an id, a third under one id: weights hold and the keys spread."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "ab"[i % 2], f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mixing.mix_sources(df, weights={"a": 1.0, "b": 3.0}).collect()
    for ident in (None, 7):
        for source, want in (("a", 250), ("b", 750)):
            some = [r for r in got if r["doc_id"] == ident and r["source"] == source]
            assert abs(len(some) - want) < 150
            assert len({r["n_copies"] for r in some}) > 1
            assert len({r["shuffle_key"] for r in some}) == len(some)


def test_mixing_plan_is_native(spark):
    df = spark.createDataFrame([(1, "s", "t")], "doc_id long, source string, text string")
    plan = mixing.mix_sources(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


@pytest.fixture(scope="module")
def plain_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, packing.END]


ODD = ["<|endoftext|>", "a<|endoftext|> b", "x" * 5000, " " * 3000, "\r\n\t\n  a", "it's we'll I'M", "日本語テキスト",
       "🙂🙂 👩‍👩‍👧", "  x\u0085y", "éé", "0123 45.67e-8", "\x00\x01", "ß" * 700, "a​b"]


def test_ids_are_the_tokenizer_files(texts, plain_ids):
    encode = packing.encoder()
    for text in [t for t in texts if t] + ODD:
        assert [*encode(text), packing.END] == plain_ids(text)


@pytest.mark.parametrize("window", [1024, 64])
def test_pieces_are_one_stream_cut_at_windows(spark, texts, plain_ids, window):
    rows = list(enumerate(texts + ODD))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed = packing.pack_sequences(df, window=window).collect()
    found = [(p["doc_id"], p["start"], p["length"], tuple(np.frombuffer(bytes(p["ids"]), "<u4").tolist()),
              p["doc_tokens"], r["sequence_id"], p["offset"]) for r in packed for p in r["pieces"]]
    order = sorted(found, key=lambda p: (p[5], p[6]))
    stream = list(dict.fromkeys(p[0] for p in order))
    want = brute.pieces([(i, plain_ids(dict(rows)[i])) for i in stream], window)
    assert order == want
    sizes = sorted((r["sequence_id"], r["n_tokens"]) for r in packed)
    assert [s for s, _ in sizes] == list(range(len(sizes)))
    assert all(n == window for _, n in sizes[:-1]) and 0 < sizes[-1][1] <= window


def test_repeated_null_ids_and_empty_tables_are_packed(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None), (None, "a")], "doc_id long, text string")
    got = packing.pack_sequences(df).collect()
    assert len(got) == 1 and got[0]["n_tokens"] == 6
    assert Counter(p["doc_id"] for p in got[0]["pieces"]) == {None: 2, 1: 2}
    assert packing.pack_sequences(df.limit(0)).count() == 0


def test_documents_longer_than_many_windows(spark, plain_ids):
    text = "word " * 30_000
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    got = packing.pack_sequences(df).agg(F.count("*"), F.sum("n_tokens")).head()
    n = len(plain_ids(text))
    assert tuple(got) == (math.ceil(n / 1024), n)
