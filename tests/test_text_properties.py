"""String rules against Python's own semantics (str.strip, re) on random text."""
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wayfarer.functions import text as T

ALPHABET = list("aBz09/?#:.-| _") + ["\t", "\n", " ", " ", "é", "É", "ß"]
texts = st.lists(st.text(alphabet=ALPHABET, max_size=24), min_size=1, max_size=40)
urls = st.lists(st.builds(lambda a, b: a + b,
                          st.sampled_from(["", "http://", "https://", "HTTPS://", " "]),
                          st.text(alphabet=ALPHABET, max_size=20)), min_size=1, max_size=40)
SETTINGS = dict(max_examples=20, deadline=None,
                suppress_health_check=[HealthCheck.function_scoped_fixture])


def py_url(s):
    s = re.sub(r"[?#].*$", "", s)
    s = re.sub(r"^https?://[^/]+", "", s)
    return s.strip().lower().rstrip("/") + "/"


def py_title(s):
    return re.search(r"(.*?)(?:\s[-|]\s|$)", s).group(1)


def run(spark, values, col):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [(r.x, r.y) for r in df.select("x", col.alias("y")).collect()]


@settings(**SETTINGS)
@given(urls)
def test_url_path(spark, values):
    for x, y in run(spark, values, T.url_path("x")):
        assert y == py_url(x), repr(x)


@settings(**SETTINGS)
@given(texts)
def test_strip_and_slug(spark, values):
    for x, y in run(spark, values, T.strip("x")):
        assert y == x.strip(), repr(x)
    for x, y in run(spark, values, T.medium_slug("x")):
        assert y == "medium_" + re.sub(r"[^a-zA-Z0-9]+", "_", x).strip(" _"), repr(x)


@settings(**SETTINGS)
@given(texts)
def test_title_prefix(spark, values):
    for x, y in run(spark, values, T.title_prefix("x")):
        assert y == py_title(x), repr(x)


WORDY = list("jobcarepliy_/-.9") + ["é", "É", " ", "ß"]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet=WORDY, max_size=20), min_size=1, max_size=40))
def test_phrase_match_like_python(spark, values):
    from pyspark.sql import functions as F
    phrases = ["job", "career", "careers", "apply"]
    rx = T.phrase_regex(phrases)
    py = re.compile(r"\b(?:" + "|".join(phrases) + r")\b", re.IGNORECASE)
    df = spark.createDataFrame([(v,) for v in values], "x string")
    for r in df.select("x", F.col("x").rlike(rx).alias("m")).collect():
        assert r.m == bool(py.search(r.x)), repr(r.x)
