"""Likeness joins, sessions, audits and listings on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from spanfit.operators import audits, listing, session
from spanfit.operators.facets import ranked
from spanfit.operators.replacement import best_sources
from spanfit.operators.resolve import fuzzy_match
from spanfit.operators.similar import contained, within_edits
from spanfit.operators.telemetry import sanitised_errors
from spanfit.operators.text import candidate_cascade, coverage_similarity, covered_queries, link_classes, link_summary, shingle_pairs, uncovered
from spanfit.sources.files import write_checked


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def words(n, seed, longest=12):
    r = random.Random(seed)
    return ["".join(r.choice("abc") for _ in range(r.randrange(longest))) for _ in range(n)]


def test_contained_is_every_containment(spark):
    a, b = words(80, 1, 6), words(80, 2, 14)
    got = contained(spark.createDataFrame(list(enumerate(a)), "i long, needle string"), spark.createDataFrame(list(enumerate(b)), "j long, hay string"), "needle", "hay")
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and x in y)


def test_edits_and_coverage_miss_no_pair(spark):
    a, b = set(words(70, 3)) - {""}, set(words(70, 4)) - {""}
    pairs = within_edits(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b", lambda _: F.lit(2), lambda _: F.lit(2))
    assert {(x, y) for x in a for y in b if distance(x, y) <= 2} <= {tuple(r) for r in pairs.collect()}
    r = random.Random(5)
    slugs = ["".join(r.choice("abcdef") for _ in range(r.choice([5, 10, 19, 21, 40, 72]))) for _ in range(60)]
    asked = []
    for s in slugs * 3:
        q = list(s)
        for _ in range(r.randrange(9)):
            k = r.randrange(len(q))
            q[k : k + 1] = r.choice([[], ["a"], [q[k], "b"]])
            q = q or ["a"]
        asked.append("".join(q)[:72])
    queries, site = spark.createDataFrame(list(enumerate(asked)), "ord long, query string"), spark.createDataFrame([(s,) for s in slugs], "slug string")
    got = covered_queries(queries, site)
    best = {k: max(1 - distance(q, s) / max(len(q), len(s)) for s in slugs) for k, q in enumerate(asked)}
    assert {x.ord: round(x.similarity, 9) for x in got.collect()} == {k: round(v, 9) for k, v in best.items() if v > 0.9}
    assert {x.ord: round(x.similarity, 9) for x in coverage_similarity(queries, site).collect()} == {k: round(v, 9) for k, v in best.items()}


def test_fuzzy_match_is_all_pairs(spark):
    known, asked = words(90, 6), words(60, 7)
    catalog = spark.createDataFrame([(f"p{k}", k, f"B{k % 2}", m) for k, m in enumerate(known)], "id string, ord long, brand string, model string")
    scraped = spark.createDataFrame([(k, f"b{k % 2}", m) for k, m in enumerate(asked)], "item long, brand string, model string")
    want = {}
    for i, m in enumerate(asked):
        for k, n in enumerate(known):
            if k % 2 == i % 2 and m and n:
                c = 1.0 if m == n else 0.9 if (m.startswith(n) or n.startswith(m)) and abs(len(m) - len(n)) <= 3 else 0.85 if distance(m, n) <= 2 else None
                if c and (i not in want or (-c, k) < want[i]):
                    want[i] = (-c, k)
    assert {(r.item, r.id, r.confidence) for r in fuzzy_match(scraped, catalog).collect()} == {(i, f"p{k}", -c) for i, (c, k) in want.items()}


def test_replacement_rules_in_order(spark):
    p = spark.createDataFrame([("a", 1, "fridge", "Samsung", "SRF7500WFH", "Samsung Fridge"), ("b", 2, "dryer", "LG", "DVH5-08W", "LG 8kg Heat Pump Dryer"), ("c", 3, "fridge", "Haier", "", "Haier French Door")], "id string, ord long, cat string, brand string, model string, display_name string")
    asked = spark.createDataFrame(list(enumerate(["SRF7500WFH", "srf7500", "samsung srf", "heat pump", "french door", "xy", "", None])), "ask long, text string")
    got = {r.ask: (r.id, r.score, r.confidence) for r in best_sources(asked, p).collect()}
    assert got == {0: ("a", 98, "high"), 1: ("a", 96, "high"), 2: ("a", 84, "medium"), 3: ("b", 78, "medium"), 4: ("c", 78, "medium")}
    assert [r.ask for r in best_sources(asked, p, cat="dryer").collect()] == [3]
    assert best_sources(asked.limit(0), p).count() == 0


def test_url_state_round_trip(spark):
    state = session.SearchState(cat="fridge", w=600, d=650, tolerance=7.0, brands=("Fisher & Paykel", "A,B"), price_max=900.0, stars=4.0, available_only=True, mode="physical", retailer_only=False, sort="stars")
    assert session.read_url("?" + session.write_url(state)) == state
    assert session.read_url("w=0&h=12.5&d=x&tol=99&brand=a,+b&pmin=-1&mode=odd&sort=odd") == session.SearchState(h=13, tolerance=20.0, brands=("a", "b"))
    assert session.read_url("") == session.SearchState()
    r = session.read_urls(spark.createDataFrame([("?" + session.write_url(state),), (None,)], "query string")).collect()
    assert (r[0].cat, r[0].w, r[0].h, r[0].brands, r[0].price_max, r[0].retailer_only, r[0].sort) == ("fridge", 600, None, ["Fisher & Paykel", "A,B"], 900.0, False, "stars")
    assert (r[1].tolerance, r[1].mode, r[1].retailer_only) == (5.0, "practical", True)
    assert session.checked_sizes("600", "", None) == ("ok", {"w": 600}) and session.checked_sizes("6x")[0] == "invalid" and session.checked_sizes()[0] == "missing"


def test_error_payloads(spark):
    rows = spark.createDataFrame([("a@b.org +61.2 9999 0000", "HTTPS", 1.7, 2, "x\n\n/y?z\n1\n2\n3\n4"), ("", None, -1.0, 0, None), (None, "", 0.0, None, None)], "message string, source string, line double, col int, stack string")
    got = sanitised_errors(rows, "https://s.example").collect()
    assert tuple(got[0]) == ("[redacted-email] [redacted-phone]", "https://s.example/HTTPS", 1, 2, "\n".join(f"https://s.example/{x}" for x in ("x", "y", "1", "2", "3")))
    assert tuple(got[1]) == ("Error", "https://s.example/", 0, 0, "") and len(got) == 2


def test_candidates_say_the_first_reason(spark):
    rows = [(1, " ", 99, 0.0, 12.0), (2, "Best fridge size", 99, 0.0, 12.0), (3, "best fridge size!", 99, 0.0, 12.0), (4, "cheap fridge size", 99, 0.0, 12.0), (5, "two words", 99, 0.0, 12.0), (6, "one two three", 49, 0.0, 12.0), (7, "one two four", 99, 0.0, 31.0), (8, "one two five", 99, 0.05, 12.0), (9, "how to measure it", 50, 0.04, 30.0)]
    got = {r.ord: (r.reason, r.slug, r.kind) for r in candidate_cascade(spark.createDataFrame(rows, "ord long, query string, impressions long, ctr double, position double"), spark.createDataFrame([("best-fridge-sizes",)], "slug string")).collect()}
    reasons = ["empty_query", "already_covered", "duplicate_query", "blacklist", "query_too_short", "low_impressions", "position_out_of_range", "ctr_not_low_enough", None]
    assert [got[k][0] for k in range(1, 10)] == reasons and got[9][1:] == ("how-to-measure-it", "how-to")


def test_uncovered_queries(spark):
    rows = spark.createDataFrame([(1, "the of"), (2, "ridge unit"), (3, "xyz zzz"), (4, None)], "ord long, query string")
    assert [r.ord for r in uncovered(rows, spark.createDataFrame([("https://e.org/Fridge-a",)], "url string")).collect()] == [3]


def test_short_texts_pair_by_tokens(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "b  a"), (3, None), (4, ""), (5, "a, b"), (6, "<i>a</i> b")], "id long, text string")
    assert sorted((r.a, r.b, r.similarity) for r in shingle_pairs(docs).collect()) == [(1, 2, 1.0), (1, 6, 1.0), (2, 6, 1.0), (3, 4, 1.0)]


def test_link_tiers(spark):
    a = lambda h, t="": f'<a class="c" href="{h}">{t}</a>'
    pages = [("/1", a("https://x.org/p", "<b>Buy</b> now") + a("/in")), ("/2", a("https://x.org/search?q=1")), ("/3", a("https://www.binglee.com.au/")), ("/4", a("https://own.example/x") + a("#")), ("/5", "")]
    c = link_classes(spark.createDataFrame(pages, "url string, html string"), ("own.example",))
    assert {r.url: (r.tier, r.buy_links) for r in c.collect()} == {"/1": ("strong", 1), "/2": ("search_only", 1), "/3": ("homepage_only", 1), "/4": ("none", 0), "/5": ("none", 0)}
    assert tuple(link_summary(c).first()) == (5, 1, 1, 1, 2, 1, 1, 1)


def test_repeated_phrases_cluster(spark):
    text = "quick brown fox jumps high. " * 6 + "and the for with. " * 9 + "other three words here " * 5
    got = [(r.place, r.phrase, r.n) for r in audits.repeated_phrases(spark.createDataFrame([(1, text), (2, "")], "id long, text string")).orderBy("place").collect()]
    assert got[0][1] == "quick brown fox jumps high" and got[0][2] == 6
    assert all("and the for" != p for _, p, _ in got) and len({p for _, p, _ in got}) == len(got)


def test_repeated_phrases_are_not_dealt(spark):
    """Texts may meet by id, never their phrases (F10, F11); rows of one id count together, and words do not run on from one to the next."""
    rows = [(1, "Red BLUE green-tea! " * 3 + "red"), (1, "red blue green tea " * 2), (2, None), (None, "a1 b2 c3\u212a d " * 5), (3, "the and for fit " * 9)]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id, r.place): (r.phrase, r.n) for r in audits.repeated_phrases(docs).collect()}
    assert {k for k, _ in got} == {1, None} and got[1, 1] == ("red blue green tea", 5) and got[None, 1] == ("a1 b2 c3k d", 5)
    apart = docs.where("id = 2 or id is null")
    assert audits.repeated_phrases(apart, keyed=True).collect() == audits.repeated_phrases(apart).collect()
    plan = lambda d: d._jdf.queryExecution().toString()
    assert plan(audits.repeated_phrases(docs)).count("Exchange hashpartitioning") == 1 and "Exchange" not in plan(audits.repeated_phrases(apart, keyed=True))
    assert all("phrase" not in line for line in plan(audits.repeated_phrases(docs)).splitlines() if "Exchange" in line)


def test_schema_audit(spark):
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    good = '{"@type": "Article", "headline": "h", "description": "d", "url": "https://e.org/f/1", "dateModified": "x"}'
    pages = [("/1", block(good) + block('{"@type": "FAQPage", "mainEntity": [1]}')), ("/2", block("{") + block(good.replace("/f/", "/g/").replace('"h"', '" "'))), ("/3", "")]
    got = {r.url: (r.blocks, r.errors) for r in audits.schema_audit(spark.createDataFrame(pages, "url string, html string"), "https://e.org/f/").collect()}
    assert got == {"/1": (2, ""), "/2": (1, "invalid JSON-LD; Article missing headline; Article url elsewhere; missing FAQPage JSON-LD"), "/3": (0, "missing Article JSON-LD; missing FAQPage JSON-LD")}


def test_bounded_store_keeps_first_id(spark):
    rows = [("u", k, n, f"id{k}", f"/{k}") for k, n in enumerate("abcad")]
    got = listing.saved_searches(spark.createDataFrame(rows, "user string, at long, name string, id string, url string")).orderBy("place").collect()
    assert [(r.name, r.id, r.url) for r in got] == [("d", "id4", "/4"), ("a", "id0", "/3"), ("c", "id2", "/2")]


def test_wildcards(spark):
    rows = spark.createDataFrame([("SRF*W", "srf-75w", True, True), ("SRF75", "SRF75X", False, False), ("SRF75X", "SRF75XY/SA", False, True), ("", "a", False, False), (None, None, False, False)], "m string, s string, e boolean, p boolean")
    for r in rows.select("e", "p", listing.wildcard_match(F.col("m"), F.col("s")).alias("x"), listing.wildcard_match(F.col("m"), F.col("s"), True).alias("y")).collect():
        assert (r.e, r.p) == (r.x, r.y)


def test_ranks_within_groups(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(6)], "i long, g long")
    assert sorted((r.g, r.rank, r.i) for r in ranked(rows, [F.desc("i")], ["g"], 2).collect()) == [(0, 1, 4), (0, 2, 2), (1, 1, 5), (1, 2, 3)]


def test_slug_discovery_is_the_plain_rule(spark):
    """Against a plain reading of the same rules, on random slugs."""
    import re

    from spanfit.operators import naming
    from spanfit.plans.names import BRANDS, MODEL_BRANDS, WEAK

    def mixed(t):
        return bool(re.search("[a-z]", t) and re.search(r"\d", t))

    def points(t):
        if not mixed(t) or re.match(naming.SIZE_TOKEN, t):
            return -100
        if t in WEAK:
            return -50
        letters, digits = len(re.findall("[a-z]", t)), len(re.findall(r"\d", t))
        return len(t) + 6 * (letters >= 2) + 6 * (digits >= 2) + 6 * (len(t) >= 6) + 4 * bool(re.match(r"[a-z]{1,4}\d", t))

    def plain(slug):
        category = None if re.search(naming.OTHER_GOODS, slug) else next((c for c, words in naming.SLUG_WORDS.items() if re.search(words, slug)), None)
        prefix, brand = next(((p, b) for p, b in BRANDS if slug == p or slug.startswith(p + "-")), ("", None))
        tokens, best = [t for t in slug[len(prefix) :].split("-") if t], (0, "")
        for k, t in enumerate(tokens):
            after = tokens[k + 1] if k + 1 < len(tokens) else ""
            found = []
            size = lambda x: re.match(naming.SIZE_TOKEN, x)
            if (mixed(t) or re.match(naming.MODEL_LETTERS, t)) and len(t) <= 5 and not size(t) and mixed(after) and not size(after):
                found.append((max(points(t), 0) + points(after) + 8, f"{t}-{after}".upper()))
            if mixed(t):
                found.append((points(t), t.upper()))
            for score, model in found:
                if score > best[0]:
                    best = (score, model)
        brand = brand or next((b for p, b in MODEL_BRANDS if re.match(p, best[1])), None)
        return (category, brand, best[1]) if category and brand and best[1] else None

    r = random.Random(8)
    parts = ["samsung", "lg", "fisher-paykel", "rs", "srf750w", "ww85", "a1", "500l", "9kg", "fridge", "dryer", "hair-dryer", "washer", "white", "x9", "top", "600mm", "dish-ss", "gf", "l500", "2-door"]
    slugs = ["-".join(r.choices(parts, k=r.randrange(1, 6))) for _ in range(400)]
    got = naming.discovered(spark.createDataFrame([(f"https://e.org/p/{s}.html",) for s in set(slugs)], "url string"), BRANDS, MODEL_BRANDS, WEAK)
    want = {f"https://e.org/p/{s}.html": plain(s) for s in slugs}
    assert {x.url: (x.category, x.brand, x.model) for x in got.collect()} == {u: w for u, w in want.items() if w}


def test_a_bad_write_leaves_the_table(spark, tmp_path):
    path, staging = f"file://{tmp_path}/t", f"file://{tmp_path}/s"
    write_checked(spark.range(3), path, staging, lambda d: d.count() == 3)
    with pytest.raises(ValueError, match="stays"):
        write_checked(spark.range(9), path, staging, lambda d: d.count() < 5)
    assert spark.read.parquet(path).count() == 3
