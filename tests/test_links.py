"""Targets of links by pages, files and rewrites; the orphan gate; the indexing audit."""

import re

from pyspark.sql import functions as F

from spanfit.operators import links

SOURCES = ["/products/:slug", "/docs/:path*", "/a/:b/c/:d", "/static", "/(.*)", "relative", "/x/(en|fr)/y", "/files/:name.pdf"]
PATHS = ["/products/one", "/products/one/two", "/products/", "/docs/a/b/c", "/docs", "/docs/", "/a/1/c/2", "/a/1/d/2", "/static", "/static/x", "/x/en/y", "/x/de/y", "/files/r.pdf", "/files/r.txt", "/", "/other"]


def test_rewrites_reach_what_their_patterns_say(spark):
    rules = links.rewrite_rules(spark.createDataFrame([(s,) for s in SOURCES], "source string"))
    assert {r.prefix for r in rules.collect()} == {"/products/", "/docs/", "/a/", "/static", "/x/", "/files/"}
    patterns = [re.compile("^" + re.sub(r":\w+", "[^/]+", re.sub(r":\w+\*", ".+", s)) + "$") for s in SOURCES if s.startswith("/") and s != "/(.*)"]
    want = {p for p in PATHS if any(x.match(p) for x in patterns)}
    got = links.rewritten(spark.createDataFrame([(p,) for p in PATHS], "dst string"), rules)
    assert {r.dst for r in got.collect()} == want == {"/products/one", "/docs/a/b/c", "/a/1/c/2", "/static", "/x/en/y", "/files/r.pdf"}


def test_pages_reached_by_a_rewrite_are_not_broken(spark):
    edges = spark.createDataFrame([("/", "/products/one"), ("/", "/page"), ("/page", "/logo.svg"), ("/page", "/gone"), ("/", "/gone")], "src string, dst string")
    pages = spark.createDataFrame([("/page",), ("/",)], "url string")
    files = spark.createDataFrame([("/logo.svg",)], "path string")
    rules = links.rewrite_rules(spark.createDataFrame([(s,) for s in SOURCES], "source string"))
    checked = links.checked_links(edges, pages, rules, files)
    assert checked.count() == 5 and [(r.dst, r.n) for r in links.broken_targets(checked).collect()] == [("/gone", 2)]
    assert {r.dst for r in links.broken_targets(links.checked_links(edges, pages)).collect()} == {"/gone", "/logo.svg", "/products/one"}
    assert links.broken_targets(links.checked_links(edges.limit(0), pages, rules)).collect() == []


def test_orphan_gate(spark):
    rows = spark.createDataFrame([("/", 2, 1), ("/a", 0, 1), ("/b", 1, 1)], "url string, n_in long, n_out long")
    assert links.orphan_gate(rows).first().asDict() == {"pages": 3, "edges": 3, "orphans": 1, "ok": False}
    assert links.orphan_gate(rows, allowed=1).first().ok and links.orphan_gate(rows.limit(0)).first().asDict() == {"pages": 0, "edges": 0, "orphans": 0, "ok": True}


def test_indexing_issues(spark):
    site = "https://s.example"
    sitemap = spark.createDataFrame([(f"{site}/",), (f"{site}/a/",), ("/b?x=1",), (f"{site}/c#d",), (f"{site}/e",), (f"{site}/a",)], "url string")
    own = '<LINK href="{}" rel=\'canonical\'>'.format
    pages = spark.createDataFrame([("/", own(f"{site}/")), ("/a", own(f"{site}/b")), ("/b", "<meta name='robots' content='noindex'>"), ("/c", f'<link rel="canonical" href="{site}/c"> x-robots-tag : noindex'), ("/z", "")], "route string, html string")
    got = sorted((r.route, r.issue, r.found) for r in links.indexing_issues(sitemap, pages, site).collect())
    assert got == [("/a", "canonical-mismatch", f"{site}/b"), ("/b", "missing-canonical", None), ("/b", "noindex", None), ("/c", "noindex", None), ("/e", "missing-file", None)]
    rows = spark.createDataFrame([("https://a.b/c/",), ("/x//",), ("",), ("?q",), ("rel/path",), ("//h/p#f",)], "u string")
    assert [r[0] for r in rows.select(links.route_of(F.col("u"))).collect()] == ["/c", "/x", "/", "/", "/rel/path", "/p"]
