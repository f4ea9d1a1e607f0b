import pytest
from pyspark.sql import functions as F

from wayfarer.functions import sequences as S
from wayfarer.functions import text as T


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("y")).first()["y"]


@pytest.mark.parametrize("url,expected", [
    ("https://Shop.example.com/?utm=x", "/"),
    ("https://Shop.example.com/Pricing", "/pricing/"),
    ("https://Shop.example.com/Docs/#a", "/docs/"),
    ("https://Shop.Example.com", "/"),
    ("HTTPS://Shop.example.com/A", "https://shop.example.com/a/"),
    ("/Thank-You//", "/thank-you/"),
    ("  /a/b?c#d", "/a/b/"),
])
def test_url_path(spark, url, expected):
    assert one(spark, T.url_path("x"), url) == expected


@pytest.mark.parametrize("title,expected", [
    ("Welcome | Acme", "Welcome"), ("Acme Pricing - Shop", "Acme Pricing"),
    ("ACME", "ACME"), ("a-b - c | d", "a-b"), (None, ""),
])
def test_title_prefix(spark, title, expected):
    assert one(spark, T.title_prefix("x"), title) == expected


def test_brand_removal_and_strip(spark):
    assert one(spark, T.remove_brand("x", ["Acme "]), "Acme Pricing") == "Pricing"
    assert one(spark, T.remove_brand("x", ["acme"]), "ACME") == ""
    assert one(spark, T.remove_brand("x", []), "\tKeep me ") == "Keep me"
    with pytest.raises(TypeError):
        T.remove_brand("x", "acme")


def test_strip_removes_tabs(spark):
    assert one(spark, T.strip_lower("x"), "\t(Direct) / (None) ") == "(direct) / (none)"


def test_medium_slug(spark):
    assert one(spark, T.medium_slug("x"), "google / cpc") == "medium_google_cpc"
    assert one(spark, T.medium_slug("x"), "(direct) / (none)") == "medium_direct_none"


def test_phrase_regex(spark):
    rx = T.phrase_regex(["job", "job", "careers"])
    df = spark.createDataFrame([("/jobs/",), ("/job/",), ("/careers/open/",), ("/x/",)], "x string")
    hits = [r[0] for r in df.filter(F.col("x").rlike(rx)).collect()]
    assert sorted(hits) == ["/careers/open/", "/job/"]
    assert T.phrase_regex([]) is None


@pytest.mark.parametrize("seq,pat,expected", [
    (list("abxc"), list("axc"), True), (list("abxc"), list("cab"), False),
    (list("abc"), [], True), ([], list("a"), False), (list("aab"), list("ab"), True),
])
def test_contains_in_order(spark, seq, pat, expected):
    df = spark.createDataFrame([(seq, pat)], "s array<string>, p array<string>")
    assert df.select(S.contains_in_order("s", "p")).first()[0] is expected


@pytest.mark.parametrize("n,c,d,score", [
    (list("ABCD"), list("ABX"), 2, 0.2777777777777778),
    (list("ABC"), list("AB"), 2, 0.75),
    (list("ZBC"), list("AB"), 0, 0.0),
])
def test_divergence_point(spark, n, c, d, score):
    df = spark.createDataFrame([(n, c)], "n array<string>, c array<string>")
    row = df.select(S.common_prefix_length("n", "c").alias("d"),
                    S.divergence_score("n", "c").alias("s")).first()
    assert row["d"] == d
    assert row["s"] == pytest.approx(score, abs=1e-12)


def test_one_item_deletions(spark):
    df = spark.createDataFrame([(list("abc"),)], "s array<string>")
    got = df.select(S.one_item_deletions("s")).first()[0]
    assert got == [["b", "c"], ["a", "c"], ["a", "b"]]
