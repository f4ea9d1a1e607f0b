import html as plain
import re

import numpy as np
import pytest

from wayfarer.llm import html_text as H

P1 = "The first paragraph of the story goes on for a while, as first paragraphs do, with a comma or two."
P2 = "Second one &amp; more: it tells <b>why</b> the <a href='/x'>thing</a> matters to the people of the town."
T2 = "Second one & more: it tells why the thing matters to the people of the town."
P3 = "Short."
P4 = "The last paragraph closes the story with enough words to count as a proper line of its own, surely."
BODY = f"<p>{P1}</p><p>{P2}</p>\n<p>{P3}</p><p>{P4}</p>"
WANT = f"{P1} {T2} {P3} {P4}"
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About us</a></li></ul>"
LONG_COMMENT = "<p>I have read this long story twice and I still do not agree with a single word of what it says.</p>" * 3


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title</title>{head}</head><body class='has-sidebar'>{body}</body></html>"


@pytest.mark.parametrize("body", [
    f"<nav>{MENU}</nav><article>{BODY}</article><footer>&copy; 2024 Site</footer>",
    f"<header><h1>Site</h1>{MENU}</header><main>{BODY}</main><aside><p>{P1}</p></aside>",
    f"<nav>{MENU}<article>{BODY}</article>",  # the menu is never closed
    f"<article>{BODY}<section class='comments'>{LONG_COMMENT}</section></article>",
    f"<article>{BODY}</article><div id='comments'><article class='comment'>{LONG_COMMENT}</article></div>",
    f"<article><p>{P1}</p><div class='ad'>Buy now!</div><p>{P2}</p><p>{P3}</p><p>{P4}</p></article>",
    f"<article><p>{P1}</p><p>{P2}<p>{P3}<p>{P4}</article><form><p>{P1}</p><input name=q></form>",
    f"<article><p>{P1}<script>var x = '</p><p>no</p>';</script></p><style>p{{}}</style>"
    f"<!-- <p>no</p> --><p>{P2}</p><p>{P3}</p><p>{P4}</p></article>",
    f"<div class='cookie-notice'><p>{P1}</p></div><main role='main'>{BODY}</main>",
    f"<div id='nav'>{MENU}</div><div class='content'>{BODY}</div><div class='footer'>Copyright 2024 Site</div>",
    f"<div>{MENU}</div><div><div>{BODY}</div></div><div><p>Copyright 2024 Site</p></div>",
    f"<div class='sidebar'><p>{P1}</p><p>{P4}</p></div><div id='main-column'>{BODY}</div>"
    f"<div class='related-posts'><p>{P1}</p></div>",
    f"<div><p>Log in</p></div><table><tr><td>{BODY}</td></tr></table><div><p>Imprint</p><p>Contact</p></div>",
    f"<div><div>{P1}</div><div>{P2}</div><div>{P3}</div><div>{P4}</div></div>",
    f"<form action='/' method=post><div>{MENU}</div><div>{BODY}</div></form>",
    f"<div>{P1}<br>{P2}<br/>{P3}<br>{P4}</div>",
    f"<div>\n<span class='ad'>Advert</span>\n{BODY}<p hidden>no</p><p style='display:none'>no</p></div>",
    f"<aside class=x title='a > b'><p>{P1}</p></aside><article>{BODY}</article>",
])
def test_article_of_many_layouts(body):
    assert H.main_text(page(body)) == WANT
    assert H.main_text(page(body).replace("<p>", "<P>").replace("article>", "ARTICLE >")) == WANT


def test_headings_references_and_white_space():
    assert H.main_text(page(f"<header>Site</header><article><header><h1>Big &lt;News&gt;</h1></header>{BODY}")) == \
        f"Big <News> {WANT}"
    assert H.main_text(page(f"<div><h1>Big\nNews</h1></div><div>{BODY}</div>")) == f"Big News {WANT}"
    assert H.main_text("<article>a&nbsp;&#8217;\t b&#x26;c &amp &unknown; <i>d</i>e<p></p>  <p>f</article>") == \
        "a ’ b&c & &unknown; de f"
    assert H.main_text("<p>Tom &amp; Jerry") == "Tom & Jerry"


def test_broken_and_empty_pages():
    for empty in (None, "", " \n", "<html><body></body></html>", "<script>only", "<!-- never closed <p>x</p>", "<p",
                  "<article></article>", "<title>only a title</title>"):
        assert H.main_text(empty) == ""
    assert H.main_text("just text, 1 < 2 > 0 & more") == "just text, 1 < 2 > 0 & more"
    assert H.main_text("<article><p>a<p>b</p></b></i></div></article></article><p>c") == "a b"
    assert H.main_text("<article>" + "<b>" * 1000 + "deep" + "<div>" * 5000 + "er</article>") == "deep er"
    assert H.main_text("<article>x <a href=\"never closed>y</article>").startswith("x")


def test_time_is_linear_in_the_length():
    import time

    for text in ("<" * 200_000, "<p " * 100_000, "<a href='" * 50_000, "<!--" * 50_000, "<div>" * 60_000, "<b></i>" * 60_000,
                 "<ul><li>" * 30_000 + "x</ul>" * 30_000, "&" * 200_000, "<script>" * 60_000, "<p><b>" * 50_000 + "</p>" * 50_000):
        at = time.time()
        H.main_text(text)
        assert time.time() - at < 8


def test_stretches_equal_a_plain_scan():
    rng = np.random.default_rng(2)
    for _ in range(300):
        w = rng.integers(0, 30, rng.integers(0, 40)) * (rng.random() < rng.random(40)[:1]) * 1
        w = np.where(rng.random(len(w)) < 0.6, 0, w)
        surge, want, k = int(rng.integers(0, 60)), [], 0
        while k < len(w):
            if sum(w[k:k + H.WINDOW]) >= max(surge, 1):
                end = k
                while end < len(w) and sum(w[end:end + H.WINDOW]):
                    end += 1
                want.append((k, end))
                k = end
            else:
                k += 1
        assert H.stretches(w, surge) == want


def test_rows_names_and_empty_tables(spark):
    df = spark.createDataFrame([("x", page(f"<article>{BODY}")), ("y", None), ("x", "")], "main_text string, html string")
    got = H.extract_text(df.repartition(2))
    assert got.columns == ["main_text", "html", "_main_text"]
    assert sorted((r[0], r[2]) for r in got.collect()) == [("x", ""), ("x", WANT), ("y", "")]
    assert H.extract_text(df.limit(0)).count() == 0


def test_query_returns_the_marked_article_of_every_page(spark):
    at = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in H.query(spark, at).collect()}
    pages = spark.read.parquet(f"{at}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [plain.unescape(re.sub("<[^>]*>", "", b)).split() for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        want = " ".join(" ".join(b) for b in blocks if b)
        assert tuple(got[p["page_id"]]) == (p["page_id"], p["url"], want, len(want))
