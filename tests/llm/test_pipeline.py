import corpus_pipeline
import pytest

import __spark_entry__ as E
from tests.llm import brute
from wayfarer.llm import registry, suffix_dedup
from wayfarer.llm.tables import store


def test_registry_is_part_of_the_entry():
    queries, sql = E.queries(), E.oracle_sql()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in registry.QUERIES}
    assert set(registry.QUERIES) | {"pipeline"} <= set(queries)
    assert set(registry.ORACLE_SQL) <= set(sql) and "pipeline" not in sql


def stage_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_follow_each_other(spark, documents, texts):
    """Each stage against brute force on what its predecessor kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "suffix-array dedup",
                     "mixing sources to target weights", "packing"]
    kept = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out, _ = store(stage(spark, docs, ""), "test-stage")
        kept[name] = out
        if name != "packing":
            assert out.columns == documents.columns
        docs = out
    rows = {n: {r["doc_id"]: r for r in df.collect()} for n, df in kept.items() if n != "packing"}

    def base_ok(text):
        n, _, _, _, repeats = brute.base_counts(text)
        return n >= 50 and 100 * repeats <= 50 * n

    assert set(rows["quality rules"]) == {i for i, t in enumerate(texts) if base_ok(t)}
    groups = brute.near_duplicates([(i, r["text"]) for i, r in rows["quality rules"].items()])
    assert set(rows["MinHash near-dedup"]) == {i for i, (_, c) in groups.items() if i == c}
    before = sorted(rows["MinHash near-dedup"])
    cut = brute.removal([rows["MinHash near-dedup"][i]["text"] for i in before])
    for i, (_, removed, _, _) in zip(before, cut):
        text = rows["MinHash near-dedup"][i]["text"]
        after = rows["suffix-array dedup"][i]
        assert (after["text"] == text) == (removed == 0) and after["n_chars"] == len(after["text"])
    assert set(rows["suffix-array dedup"]) == set(before)
    assert any(removed for _, removed, _, _ in cut)
    mixed = kept["mixing sources to target weights"].collect()
    assert {r["doc_id"] for r in mixed} <= set(before)
    packed = kept["packing"].collect()
    assert sum(p["length"] == p["doc_tokens"] or p["start"] == 0 for r in packed for p in r["pieces"]) >= len(mixed)
    assert sum(p["start"] == 0 for r in packed for p in r["pieces"]) == len(mixed)


def test_stages_on_empty_documents(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = store(stage(spark, docs, ""), "test-stage")
        assert docs.count() == 0


def test_suffix_stage_keeps_all_rows(spark, documents):
    assert suffix_dedup.remove_repeats(documents).count() == documents.count()


@pytest.mark.parametrize("name", ["op1_url_filters", "op9_mixing"])
def test_queries_read_the_tables(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_near_dedup_stage_links_from_80_percent(spark, monkeypatch):
    """Pairs of 0.8165 are one in the stage, pairs of 0.796 two; op7 has its own bound of 0.85."""
    rows = []
    for k, changes in enumerate((8, 9)):
        words = [f"w{k}x{i}" for i in range(400)]
        changed = list(words)
        for j in range(changes):
            changed[20 + 12 * j] = f"c{k}x{j}"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(changed))]
    sets = [brute.shingles(t) for _, t in rows]
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (0, 2)]
    assert 0.80 < share[0] < 0.85 and share[1] < 0.80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 10, 11]
    monkeypatch.setattr("wayfarer.session.read_table", lambda *_: docs)
    assert all(r["kept"] for r in registry.QUERIES["op7_minhash_dedup"](spark, "").collect())
