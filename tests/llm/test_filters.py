import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from wayfarer.llm import quality_rules, url_filters, warc_audit

URLS = ["http://a.example.org/es/1", "https://example.org/en/12", "http://example.org/en/2", "http://x.org",
        "http://x.org/", "http://ORG/", "http://m.EXAMPLE.com/fr/9?x=/de/", "http://a.com/de/", "http://a.com/De/",
        "http://a.com/it/", "http://spam-farm.a.net/", "http://cheap-pills.com/fr/1", "http://nospamhere.net/", None, "",
        "no url", "http://", "://org/", "http://a.com:80/fr/", "http://aorg/x", "http://.org/y", "http://é.org/ü",
        "http://a.b/://c.org/", "http://casino", "http://pills#.org/"]


def plain_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[:min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(len(h + p), v, h + p) for v, h, p in [
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
        ("allow", "com", "/fr/"), ("block", "com", "/de/")]
        if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, verdict, rule = max(fits)
        return host, path, rule, verdict, None
    import re
    for w in url_filters.WORDS:
        if w in re.split("[.-]", host):
            return host, path, None, "block", f"host:{w}"
    return host, path, None, "allow", None


def test_verdicts_are_the_plain_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:3])), "page_id long, url string").repartition(3)
    got = {r["page_id"]: tuple(r["url_verdict"]) for r in url_filters.judge_urls(df).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS + URLS[:3])}


def test_only_candidates_run_their_expression():
    rules = [url_filters.host_rule("block", f"site{i}.com/") for i in range(500)]
    index = url_filters.RuleIndex(rules, {"com": 10_000})
    rule, tried = index.best("www.site42.com/x")
    assert rule.name == "site42.com/" and tried == 1
    assert index.best("other.com/") == (None, 0)
    loose = url_filters.Rule("any", "block", ".*bad", ())
    assert url_filters.RuleIndex([loose], {}).best("xbad")[0] is loose


def test_url_filter_columns_sizes_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([("http://a.org/", "x")], "url string, url_verdict string")
    got = url_filters.judge_urls(df)
    assert got.columns == ["url", "url_verdict", "_url_verdict"] and got.head()[2]["verdict"] == "allow"
    assert url_filters.judge_urls(df.limit(0)).count() == 0
    monkeypatch.setattr(url_filters, "MAX_RULE_BYTES", 10)
    with pytest.raises(ValueError):
        url_filters.judge_urls(df)


def pages(spark, n=400):
    rng = np.random.default_rng(1)
    rows = [(i if i % 50 else None, f"http://h{i % 7}/p{i}", "é" * int(rng.integers(0, 900))) for i in range(n)]
    rows += [(5, None, None), (6, "u", None), (7, None, "t"), rows[3], rows[3]]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_audit_finds_exactly_the_damage(spark):
    whole = warc_audit.warc_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    index = warc_audit.with_offsets(
        warc_audit.record_digests(pages(spark), "page_id", ("digest", whole)), "digest").cache()
    rows = index.orderBy("segment", "offset").collect()
    assert len({(r["segment"], r["offset"]) for r in rows}) == len(rows) == 403
    place = lambda r: (r["segment"], r["offset"])
    gone, extra, bad = place(rows[10]), place(rows[200]), place(rows[-1])
    at = lambda p: (F.col("segment") == p[0]) & (F.col("offset") == p[1])
    second = index.filter(~at(gone)).withColumn("digest", F.when(at(bad), F.lit("0")).otherwise(F.col("digest")))
    first = index.filter(~at(extra))
    for leaf, fan in ((1 << 15, 8), (64, 2), (1 << 30, 2)):
        got = {place(r): r["status"] for r in warc_audit.audit(first, second, leaf, fan).collect()}
        assert got == {gone: "missing", extra: "extra", bad: "corrupt"}


def test_equal_and_empty_replicas(spark):
    whole = warc_audit.warc_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    index = warc_audit.with_offsets(
        warc_audit.record_digests(pages(spark, 60), "page_id", ("digest", whole)), "digest").cache()
    assert warc_audit.audit(index, index).count() == 0
    assert warc_audit.audit(index.limit(0), index.limit(0)).count() == 0
    assert warc_audit.audit(index, index.limit(0)).filter("status = 'missing'").count() == index.count()


def test_records_are_warc(spark):
    df = spark.createDataFrame([(1, "http://a/", "é")], "page_id long, url string, html string")
    got = df.select(warc_audit.warc_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).head()[0]
    head, body = got.split("\r\n\r\n", 1)
    assert head.split("\r\n")[0] == "WARC/1.1" and "Content-Length: 2" in head and body == "é\r\n\r\n"


def test_base_counts_are_the_brute_force_s(documents, texts):
    got = quality_rules.with_measures(documents, "text", "q").collect()
    for r in got:
        want = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
                        brute.base_counts(texts[r["doc_id"]])))
        assert {c: r["q"][c] for c in want} == want


def test_concentration_steps_equal_numpy(spark):
    """One group, one source: the same steps with numpy on the same rows."""
    rng = np.random.default_rng(3)
    docs = []
    for i in range(300):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(80)]
        if i < 20:
            words = [w.upper() + "###" for w in words]
        docs.append((i, " ".join(words), "en", "s"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    measured = quality_rules.with_measures(df, "text", "q").cache()
    model, _ = quality_rules.fit(measured, "lang", "source", "q")
    row = model.filter(F.col("_key").startswith("0")).head()

    x = np.array([[r["q"][c] for c in quality_rules.STATISTICS] for r in measured.collect()])
    least = np.square(quality_rules.FLOOR)
    quarter, median, three = np.percentile(np.floor(x * 256 + 0.5), (25, 50, 75), axis=0) / 256

    def refit(some, share):
        cov = np.cov(some.T, bias=True) * quality_rules.consistency(share)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), least))
        return some.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    ends = []
    for spread in (least, np.maximum(np.square((three - quarter) / 1.349), least)):
        mean, inverse, size = median, np.diag(1 / spread), np.inf
        for _ in range(quality_rules.STEPS):
            d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
            place = np.floor(np.log2(d + 2.0 ** -10) * quality_rules.BINS_PER_OCTAVE)
            limit = next(b for b in np.unique(place) if (place <= b).sum() >= len(x) / 2)
            before = size
            mean, inverse, size = refit(x[place <= limit], 0.5)
            if size >= before - 1e-6:
                break
        ends.append((size, mean, inverse))
    _, mean, inverse = min(ends, key=lambda e: e[0])
    d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
    mean, inverse, _ = refit(x[d <= quality_rules.chi_square_quantile(quality_rules.TRUSTED, x.shape[1])],
                             quality_rules.TRUSTED)
    assert np.allclose(row["mean"], mean, atol=1e-6)
    assert np.allclose(np.array(row["inverse"]).reshape(inverse.shape), inverse, rtol=1e-3, atol=1e-2)
    kept = {r["doc_id"] for r in quality_rules.quality_filter(df).collect()}
    assert kept == set(range(20, 300))


def test_consistency_factors_are_those_of_a_normal_sample():
    rng = np.random.default_rng(1)
    for dimensions, share in ((7, 0.5), (6, 0.5), (7, 0.975)):
        x = rng.normal(size=(200_000, dimensions))
        d = (x ** 2).sum(axis=1)
        limit = quality_rules.chi_square_quantile(share, dimensions)
        assert abs((d <= limit).mean() - share) < 0.005
        assert quality_rules.consistency(share, dimensions) == pytest.approx(1 / x[d <= limit].var(), rel=0.01)
    assert quality_rules.chi_square_share(quality_rules.CUTOFF, 7) == pytest.approx(1 - 1e-6, abs=1e-8)


def test_quality_rules_on_odd_rows(documents, texts):
    judged = quality_rules.quality_verdicts(documents)
    assert judged.columns == [*documents.columns, "quality_stats", "quality_verdict"]
    for r in judged.collect():
        n_words, _, _, _, repeats = brute.base_counts(texts[r["doc_id"]])
        assert r["quality_verdict"]["base_failed"] == (n_words < 50 or 100 * repeats > 50 * n_words)
        assert not (r["quality_verdict"]["base_failed"] and r["quality_verdict"]["kept"])


def test_quality_rules_with_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 60, None, None, "x")],
                               "doc_id long, text string, lang string, source string, quality_stats string")
    got = quality_rules.quality_verdicts(df)
    assert got.columns[-2:] == ["_quality_stats", "quality_verdict"] and got.count() == 1
    assert quality_rules.quality_filter(df.limit(0)).columns == df.columns
    assert quality_rules.quality_filter(df.limit(0)).count() == 0


def test_moderate_junk_in_a_clean_source_is_rejected(spark):
    """30% digits, or a quarter of the lines repeated: the base rules pass both, the distance must not."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    page = lambda n: [" ".join(word() for _ in range(6)) for _ in range(n)]
    clean = ["\n".join(page(int(rng.integers(9, 60)))) for _ in range(120)]
    digits = ["\n".join(" ".join(w if rng.random() < 0.7 else "7" * len(w) for w in line.split())
                        for line in page(24)) for _ in range(3)]
    lines = ["\n".join(x + x[:6]) for x in (page(18) for _ in range(3))]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean + digits + lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {r["doc_id"]: r["quality_verdict"] for r in quality_rules.quality_verdicts(df).collect()}
    assert not any(v["base_failed"] for v in judged.values())
    assert {i for i, v in judged.items() if v["kept"]} == set(range(120))
