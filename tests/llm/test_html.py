"""Wrappers: alignment by definition, what they match, and that the text comes through them."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sylvaframe.llm import html_extract
from sylvaframe.llm.html_extract import align, blocks, expression, matches, stream


def shape(page):
    return expression(stream(blocks(page)))


def language(tokens):
    """A Python expression over names of one letter for one level of an expression."""
    return re.compile("".join({"(": "(?:", ")+": ")+", "[": "(?:", "]?": ")?"}.get(t, t.strip("<>")) for t in tokens if not t.startswith("</") and t != "#"))


def test_groups():
    assert shape("<p>a</p><p>b</p><p>c</p>") == ["(", "<p>", "#", "</p>", ")+"]
    one, two = stream(blocks("<h1>a</h1><p>b</p>")), stream(blocks("<h1>a</h1><div>x</div><p>b</p><p>c</p>"))
    assert expression(align(one, two)) == ["<h1>", "#", "</h1>", "[", "<div>", "#", "</div>", "]?", "(", "<p>", "#", "</p>", ")+"]
    both = align(stream(blocks("<p>a</p><h2>b</h2>")), stream(blocks("<h2>a</h2><p>b</p>")))
    assert expression(both) == ["(", "[", "<h2>", "#", "</h2>", "]?", "[", "<p>", "#", "</p>", "]?", ")+"]


def test_alignment_matches_all_it_has_seen():
    """One level: the inferred expression, as a regular expression, matches every stream; alignment does not depend on the order."""
    r = random.Random(2)
    tags = ["p", "ul", "h2", "table", "pre"]
    letter = dict(zip(tags, "puhtr", strict=True))
    for _ in range(120):
        pages = [[r.choice(tags[: r.randint(1, 5)]) for _ in range(r.randint(1, 6))] for _ in range(r.randint(1, 5))]
        streams = [stream(blocks("".join(f"<{t}>x</{t}>" for t in p))) for p in pages]
        whole = streams[0]
        for s in streams[1:]:
            whole = align(whole, s)
        tokens = [re.sub(r"[a-z0-9]+", lambda m: letter.get(m[0], m[0]), t) if t.startswith("<") else t for t in expression(whole)]
        assert all(language(tokens).fullmatch("".join(letter[t] for t in p)) for p in pages)
        assert all(matches(whole, s) for s in streams)
        for order in itertools.islice(itertools.permutations(streams), 6):
            again = order[0]
            for s in order[1:]:
                again = align(again, s)
            assert expression(again) == expression(whole)
    assert not matches(stream(blocks("<p>a</p>")), stream(blocks("<div>a</div>"))) and not matches(stream(blocks("<p>a</p><h2>b</h2>")), stream(blocks("<h2>a</h2><p>b</p>")))


PAGE = (
    "<html><head><title>T</title><script>x('</p>')</script></head><body><nav><a>Menu</a></nav><div class='cookie-notice'>ok?</div><article><h1>Head &amp; all</h1>"
    "<p><b>One<br>two\n three<p>Four&nbsp;five<div class=ad>buy</div><section id='comments'><p>me too</p></section></article><aside>side</aside><footer>&copy;</footer></body></html>"
)


#: Top and tail are containers of their own with one text on all pages; the paragraph is among others that differ.
TEMPLATED = "<div class=ua><span>Login here</span></div><div class=ub><h1>Head</h1><p>Text %d of the page</p><p>On each page</p><p>%s</p></div><div class=uc><p>We are a company</p></div>"
COPY = "The same article stands here, and it is longer than what stands around it."
CASES = [
    ("k", "<article><p>one</p></article><div class=user-reviews><p>nice</p></div>", "one"),
    ("l", "<div><p>one</p><p>two</p></div><div class='user-reviews box'>nice</div><div class=top-bar>Login here</div><div class=cookie-msg>We use cookies</div><div class=hdr>H</div>", "one two"),
    ("m", "<p>one</p><div style='color:red; display: none'>gone</div><p style='display:block'>two</p>", "one two"),
    ("n", "<p>one</p><ul><li><a href=x>linked</a></li><li>a plain entry</li></ul><ul><li><a href=x>Home</a></li><li><a href=y>Away</a></li></ul><p>two</p>", "one linked a plain entry two"),
    ("o", "<article><h1>Head</h1><p>one</p></article><article><h2><a href=x>Other head</a></h2><p>other</p></article>", "Head one"),
    ("p", "<article><h2><a href=x>Head</a></h2><p>one</p></article><article><h2><a href=x>Other head</a></h2><p>other</p></article>", "Head one Other head other"),
    ("q", "<main><p>intro</p><article><h2>Head</h2><p>one</p></article><article class=teaser><p>other</p></article></main>", "intro Head one"),
]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit(1))


@pytest.fixture(scope="module")
def rows():
    loose = "<body><div class=menu>m</div><div><p>Body %d text</p><p>Same on all</p></div></body>"
    out = [(0, "http://a.org/1", PAGE), (1, None, None), (2, "http://a.org/2", ""), (2, "http://a.org/2", "")]
    out += [(10 + i, f"http://b.org/{i}", loose % i) for i in range(6)]
    out += [(40 + i, f"http://g.org/{i}", TEMPLATED % (i, "tail " * (i + 1))) for i in range(5)]
    out += [(50 + i, f"http://i.org/{i}", f"<div class=x{i}><p>{COPY}</p></div><div class=t>Page {i}</div>") for i in range(5)]
    out += [(60 + i, f"http://j.org/{i}", f"<article><p>Piece {i}</p><p>On each page</p><h2>Sources</h2></article>") for i in range(5)]
    out += [(70 + i, f"http://{h}.org/", page) for i, (h, page, _) in enumerate(CASES)]
    out += [(30, "http://c.org/", '<article><p>one</p><p class="legal">Court text</p><p class="social-history">Kept?</p><div id="related-work">body</div></article>')]
    out += [(31, "http://d.org/", '<p class="a>one</p><p>two</p>'), (32, "http://d.org/x", "<p>3 < 4 and 5 > 2</p><p>x <b"), (33, "http://e.org/", "<div><p>" + "long <i>text</i> " * 60_000)]
    out += [(34, "http://f.org/", "<main><div class='related'><a href=x>More of this</a></div><p class='related'>How it is related</p><header><h2>H</h2><p>by me</p></header></main>")]
    return out + [(None, "http://a.org/1", PAGE)]


EXPECTED = {0: "Head & all One two three Four five", 1: "", 2: "", 12: "Body 2 text Same on all", 30: "one Court text Kept? body", 31: "one two", 32: "3 < 4 and 5 > 2 x", 34: "How it is related H"}


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_texts_through_wrappers_sent_or_joined(spark, rows, monkeypatch, most):
    monkeypatch.setattr(html_extract, "MAX_SENT_BYTES", most)
    got = html_extract.extract(pages_of(spark, rows)).collect()
    by = {g.page_id: g for g in got}
    assert len(got) == len(rows) and {i: by[i].text for i in EXPECTED} == EXPECTED and by[None].text == EXPECTED[0]
    assert [by[40 + i].text for i in range(5)] == [f"Head Text {i} of the page On each page {'tail ' * i}tail" for i in range(5)]
    assert [by[50 + i].text for i in range(5)] == [f"{COPY} Page {i}" for i in range(5)]
    assert [by[60 + i].text for i in range(5)] == [f"Piece {i} On each page Sources" for i in range(5)]
    assert [by[70 + i].text for i in range(len(CASES))] == [text for *_, text in CASES]
    assert by[33].text == " ".join(["long text"] * 60_000) and all(g.n_chars == len(g.text) for g in got)


def test_without_wrappers_nothing_is_read(spark, rows):
    pages = pages_of(spark, rows)
    own = pages.select(html_extract._host(F.col("url")).alias("host"), "html")
    found = html_extract.infer_wrappers(own)
    assert {r.host for r in found.collect()} == {r.host for r in own.distinct().collect()}
    empty = found.withColumn("wrapper", F.lit('{"e": [], "f": {}, "k": {}}'))
    assert {g.text for g in html_extract.extract(pages, wrappers=empty).collect()} == {""}
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 40])
def test_constants_do_not_depend_on_the_number_of_pages(spark, n):
    """Alignment needs two pages that differ; from there on their number changes nothing. By marks of elements alone the template would stay."""
    pages = [(i, f"http://h.org/{i}", TEMPLATED % (i, "tail " * (i % 7 + 1))) for i in range(n)]
    got = {g.page_id: g.text for g in html_extract.extract(pages_of(spark, pages + [(-1, *pages[0][1:])])).collect()}
    for i, _, page in pages:
        found = blocks(page)
        by_marks = html_extract.read(found, {b.path: html_extract.role(b.path) for b in found})
        inner = f"Head Text {i} of the page On each page {'tail ' * (i % 7)}tail"
        assert by_marks == f"Login here {inner} We are a company" and got[i] == (inner if n > 1 else by_marks)
    assert got[-1] == got[0]


def test_every_page_matches_the_wrapper_of_its_host(spark, monkeypatch):
    import json

    monkeypatch.setattr(html_extract, "_FAN", 3)
    html = ["<body>" + "<div><p>x</p></div><h2>y</h2>" * (i % 9) + f"<article><h{i % 6 + 1}>t</h{i % 6 + 1}>" + "<ul><li>a</li></ul><p>b</p>" * (i // 9) + "</article></body>" for i in range(60)]
    pages = spark.createDataFrame([("h.org", x) for x in html] + [("i.org", None)], "host string, html string").repartition(30)
    found = {r.host: json.loads(r.wrapper) for r in html_extract.infer_wrappers(pages).collect()}
    assert len(found) == 2 and all(matches(found["h.org"], stream(blocks(x))) for x in html)
    assert {b.path for x in html for b in blocks(x)} == set(html_extract.slots(found["h.org"]))


def test_names():
    mark = html_extract.name_mark
    assert [mark(x) for x in ("ad", "site-header", "cookie-notice", "comment_list x", "related-posts", "legal")] == ["!", "!", "!", "!", "~", "~"]
    assert [mark(x) for x in ("user-reviews", "top-bar", "cookie-msg", "hdr", "reader-feedback-list")] == ["!"] * 5
    assert [mark(x) for x in ("review", "review-body", "user-guide", "top", "bar")] == [""] * 5
    assert [mark(x) for x in ("", "article-body", "related-work", "social-history", "adventure", "notice-of-appeal", "menu-engineering")] == [""] * 7
