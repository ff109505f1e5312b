"""Elements of nested pages, JSON-LD of all forms, phrase clusters against a plain fold."""

import random

import pytest

from spanfit.functions.markup import as_text, elements, json_types, page_elements, page_texts, parse_json
from spanfit.operators import audits

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav>menu <p>in nav</p></nav>
<main id=m class="a" class="b">One<b>two</b> &amp; <i>three<div id="review-videos"><div>x <p>gone</p></div> y</div> four</i><script>var t="</main>";</script>
<p>first <b>bold<p cite>SECOND para</b> end<ul><li>a<li>b <ul><li>c</ul> d</ul><footer>foot</footer><img alt=x>five</main><main>other</main>tail"""


def texts(html, tags, out=(), ids=()):
    return [(t, x) for t, _, x in elements(html, frozenset(tags), frozenset(out), frozenset(ids))[0]]


def test_elements_nest_and_close_as_html_does():
    assert texts(PAGE, ["p"]) == [("p", "in nav"), ("p", "gone"), ("p", "first bold"), ("p", "SECOND para end")]
    assert texts(PAGE, ["li"]) == [("li", "a"), ("li", "b c d"), ("li", "c")]
    assert texts("<p>a<pre>b</pre>c</p>d", ["p", "pre"]) == [("p", "a"), ("pre", "b")]
    found, ids = elements(PAGE, frozenset(["main", "p"]), frozenset(), frozenset())
    assert found[1][1] == {"id": "m", "class": "a"} and ids == {"m", "review-videos"}
    assert texts("<p>one<br/>two<p/>three", ["p"]) == [("p", "onetwo"), ("p", "three")]
    assert texts("<table><tr><td><p>a</td><td>b</table>", ["p", "td"]) == [("td", "a"), ("p", "a"), ("td", "b")]
    assert texts("<script><p>x</p>", ["p"]) == [] and texts("", ["p"]) == [] and texts("<", ["p"]) == []


def test_main_text_leaves_out_a_subtree_by_id(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", "<p>only body <span id='review-videos'>videos <b>x</b></span> text</p><nav>n</nav>"), ("c", None), ("d", "<p>none</p>")], "url string, html string")
    got = {r.url: (r.found, r.text) for r in page_texts(pages, "review-videos").collect()}
    assert got == {"a": (True, "Onetwo & three four first boldSECOND para endab c dfive"), "b": (True, "only body text"), "c": (False, ""), "d": (False, "none")}
    assert [(r.at, r.tag, r.attributes, r.text) for r in page_elements(pages.where("url = 'd'"), ("p",)).collect()] == [(1, "p", {}, "none")]
    assert page_elements(pages.limit(0), ("p",)).collect() == [] and page_texts(pages.limit(0), "x").collect() == []


def test_review_audit_counts_own_words(spark):
    own = "word " * 290 + "fits the cavity 5mm side 10 mm rear 20mm top space ok"
    pages = spark.createDataFrame([("a", f"<p>{'out ' * 400}</p><main>{own}<div id='review-videos'><div>{'video ' * 99}</div>9mm side</div></main>"), ("b", f"<main>{own} 10mm rear</main><i id=review-videos></i>"), ("c", own)], "url string, html string")
    assert {r.url: (r.words, r.issues) for r in audits.review_audit(pages).collect()} == {"a": (302, "rear"), "b": (304, "")}
    expected = spark.createDataFrame([("b", 5, 10, 25), ("x", 1, 1, 1)], "url string, side int, rear int, top int")
    assert {r.url: r.issues for r in audits.review_audit(pages, expected=expected).collect()} == {"a": "rear", "b": "top"}


def test_types_of_all_forms():
    assert json_types({"@type": "A"}) == ["A"] and json_types({"@type": ["A", "B"]}) == ["A", "B"] and json_types([{"@type": "A"}, [{"@type": 5}]]) == ["A", "5"]
    assert json_types({"@graph": [{"@graph": [{"@type": ["A"]}]}], "@type": ""}) == ["A"] and json_types("A") == [] and json_types({"@graph": {"@type": "A"}}) == []
    deep = {"@type": "deep"}
    for _ in range(3000):
        deep = {"@graph": [deep]}
    assert json_types(deep) == ["deep"]
    assert [as_text(x) for x in (None, True, 2.0, 1.5, [1, None, "x"], {})] == ["", "true", "2", "1.5", "1,,x", "[object Object]"]
    assert parse_json("{no")[0] is False and parse_json("NaN")[0] is False and parse_json("[" * 100_000)[0] is False and parse_json("null") == (True, None)


@pytest.mark.parametrize(("block", "article", "errors"), [
    ('{"@type":["Article"],"headline":"h","description":"d","url":"https://s/a","dateModified":1}', True, "missing FAQPage JSON-LD"),
    ('{"@graph":[{"@type":"Article","headline":"h"},{"@type":"FAQPage"}],"mainEntity":[1]}', True, "Article missing headline; Article missing description; Article missing url; Article missing dateModified"),
    ('[{"@type":"FAQPage","mainEntity":[1]}]', False, "missing Article JSON-LD; FAQPage missing mainEntity questions"),
    ("{", False, "invalid JSON-LD; missing Article JSON-LD; missing FAQPage JSON-LD"),
])
def test_schema_audit_of_one_block(spark, block, article, errors):
    page = spark.createDataFrame([("u", f'<script id="x" type="application/ld+json">{block}</script>')], "url string, html string")
    got = audits.schema_audit(page, "https://s/").first()
    assert (got.has_article, got.errors) == (article, errors)


def fold(rows, most):
    """All phrases against all clusters, as the rule says."""

    def near(a, b):
        short, long = sorted((a, b), key=len)
        if any(long[k : k + len(short)] == short for k in range(len(long) - len(short) + 1)):
            return True
        return any(a[-k:] == b[:k] or b[-k:] == a[:k] for k in range(max(2, len(short) - 2), len(short)))

    clusters = []
    for phrase, n in sorted(rows, key=lambda r: (-r[0].count(" "), -r[1], r[0])):
        own = phrase.split(" ")
        home = next((c for c in clusters if any(near(x, own) for x in c[2])), None)
        if home:
            home[2].append(own)
        else:
            clusters.append((phrase, n, [own]))
    return [(p, n) for p, n, _ in clusters[:most]]


@pytest.mark.parametrize("seed", range(6))
def test_phrase_clusters_are_the_plain_fold(seed):
    r = random.Random(seed)
    rows = list({" ".join(r.choice("abcdef") for _ in range(r.randrange(3, 6))): r.randrange(5, 9) for _ in range(40 + 30 * seed)}.items())
    for most in (2, 5, 25):
        assert audits.phrase_clusters(rows, most) == fold(rows, most)


def test_headings_and_prose(spark):
    html = "<h1>Good ☕</h1><h2 style=''>a</h2><h3>© no</h3><h4>☕</h4><blockquote><p>in quote</p></blockquote><pre>code</pre><p>see <code>x</code> it</p>"
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    assert sorted((r.at, r.rule) for r in audits.heading_issues(pages).collect()) == [(1, "emoji-heading"), (2, "heading-inline-style"), (3, "emoji-heading")]
    assert audits.prose(pages).first().text == "Good ☕ a © no ☕ in quote in quote see it"
    shout = spark.createDataFrame([("u", "<p>ABÉcole</p><p>AB&amp; x</p><p cite>AB CD</p><p>ABc</p><p>A</p>")], "url string, html string")
    assert sorted((r.at, r.rule) for r in audits.paragraph_issues(shout).collect()) == [(1, "uppercase-lead"), (2, "uppercase-lead")]
