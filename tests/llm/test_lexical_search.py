import math
import re
from collections import Counter

import pytest

from wayfarer.llm import lexical_search as L

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_ranking(docs, items, k=20):
    """Every document against every item, by the stated formula."""
    counted = [(i, Counter(ts), len(ts)) for i, ts in ((i, terms(t)) for i, t in docs) if ts]
    n_docs, n_all = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in sorted(set(items), key=str):
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, tf, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in wanted if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranking_is_that_of_every_pair(spark, documents, texts):
    docs = list(enumerate(texts))
    items = [(i, " ".join(t.split()[3:30])) for i, t in enumerate(texts) if t and len(t.split()) > 30][:18]
    items += [(100, "é x\x00é"), (101, None), (102, ""), (103, "nowhere-to-be-found"), (0, "two words two"),
              (0, "two words two"), (104, "THE the The"), (None, "one")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = L.search(documents, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(got) == plain_ranking(docs, items)
    assert ranked(L.search(documents, asked, k=3)) == plain_ranking(docs, items, 3)


def test_boundaries_case_and_odd_characters(spark):
    docs = [(1, "ab abc ab-ab"), (2, "ABC"), (3, "ab\x00ab\x7fab"), (4, "Éab éab ab"), (5, "a b"), (6, None), (7, "-"),
            (None, "ab ab"), (None, "ab ab"), (8, "ab ab")]
    items = [(1, "ab"), (2, "abc ab"), (3, "éab"), (4, "Éab"), (5, "b b a")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked(L.search(df, spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_ranking(docs, items)


def test_copies_tie_by_id_whatever_the_partitions(spark):
    docs = [(i, "same words here") for i in range(500)] + [(i, f"other {i}") for i in range(500, 700)]
    items = spark.createDataFrame([(1, "same words"), (2, "other here")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_ranking(docs, [(1, "same words"), (2, "other here")])
    assert sorted(r[2] for r in want if r[0] == 1) == list(range(20))
    for parts in (1, 7):
        assert ranked(L.search(df.repartition(parts), items)) == want


def test_items_beyond_one_automaton_are_scanned_in_groups(spark, documents, texts):
    items = [(i, t) for i, t in enumerate(texts[:12])] + [(None, "one two")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked(L.search(documents, asked, max_item_bytes=4000)) == plain_ranking(list(enumerate(texts)), items)
    with pytest.raises(ValueError):
        L.search(documents, asked, max_item_bytes=10)


def test_blocks_do_not_change_scores(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 7)
    monkeypatch.setattr(L, "ADDED", 5)
    items = [(i, t) for i, t in enumerate(texts[:4])]
    got = L.search(documents, spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(got) == plain_ranking(list(enumerate(texts)), items)


def test_empty_tables_and_names(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x")], "score string, terms string")
    items = spark.createDataFrame([("i", "x")], "rank string, doc_id string")
    got = L.search(docs, items, doc_id="score", text="terms", item_id="rank", item_text="doc_id")
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [("i", 1, "a"), ("i", 2, "b")]
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert L.search(none, some).collect() == []
    assert L.search(none, none.withColumnRenamed("doc_id", "item_id")).collect() == []
    blank = spark.createDataFrame([(1, "-"), (2, None)], "item_id long, text string")
    assert L.search(none, blank).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_query_equals_its_sql(spark):
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{at}/{name}.parquet'")
    want = con.sql(L.ORACLE_SQL)
    got = L.query(spark, at)
    assert got.columns == want.columns
    assert ranked(got) == sorted(want.fetchall(), key=str)
