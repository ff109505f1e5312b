"""Unit tests of the catalog operators on small fixtures, and of files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from spanfit.functions import columns as c
from spanfit.operators import fit, resolve, telemetry, text
from spanfit.operators.fit import FitQuery
from spanfit.plans import etl, search, signals
from spanfit.sources import adapters, files
from spanfit.streaming import telemetry as streams

PRODUCT = "ord int, id string, cat string, brand string, model string, display_name string, type string, w int, h int, d int, stars int, price int, unavailable boolean, priority int"


def product(ord, w, h, d, cat="fridge", **more):
    row = {"ord": ord, "id": f"p{ord}", "cat": cat, "brand": "B", "model": f"M{ord}", "display_name": f"B {ord}", "type": "", "w": w, "h": h, "d": d, "stars": 4, "price": 900, "unavailable": False, "priority": 50} | more
    return tuple(row.values())


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [product(1, 590, 1880, 640), product(2, 596, 1800, 620), product(3, 600, 1900, 650), product(4, None, 1800, 600), product(5, 500, 1500, 500), product(6, 600, 850, 600, "dryer", model="WK tower")]
    return spark.createDataFrame(rows, PRODUCT)


def ids(df):
    return [r.id for r in df.collect()]


def test_fit_modes_are_nested_and_tolerance_admits_nothing(catalog):
    q = {"w": 600, "h": 1900, "d": 650, "cat": "fridge"}
    bare, practical = (set(ids(fit.find_matches(catalog, FitQuery(**q, mode=m)))) for m in ("physical", "practical"))
    assert bare == {"p1", "p2", "p3", "p5"} and practical == {"p1", "p5"}
    assert set(ids(fit.find_matches(catalog, FitQuery(**q, tolerance_mm=10)))) == practical
    assert set(ids(fit.fits(catalog, FitQuery(**q, mode="physical", null_dim_as_zero=True)))) == bare | {"p4"}
    assert ids(fit.find_matches(catalog, FitQuery(cat="fridge"))) == []
    assert ids(fit.find_matches(catalog, FitQuery(**q)))[0] == "p1"  # the tightest first


def test_scores_and_near_misses(catalog):
    rows = {r.id: r for r in fit.fits(catalog, FitQuery(w=600, h=1900, d=650, cat="fridge")).collect()}
    assert all(0 <= r.fit_score_numeric <= 100 for r in rows.values()) and rows["p1"].binding_axis == "width"
    only_width = fit.fits(catalog, FitQuery(w=5000, mode="physical")).first()
    assert only_width.fit_score_numeric == 40  # weights are not spread over absent axes
    near = fit.near_misses(catalog, FitQuery(w=600, h=1900, d=650, cat="fridge")).collect()
    assert [(r.id, r.needed_mm, r.needed_axis) for r in near] == [("p2", 6, "width"), ("p3", 20, "height")]
    tower = FitQuery(w=700, h=900, d=700, replacement=True, source_category="dryer")
    assert "p6" not in ids(fit.fits(catalog, tower)) and ids(fit.fits(catalog.where("cat = 'dryer'"), FitQuery(w=700, cat="washtower_combo"))) == ["p6"]


def test_scan_gets_the_bounds(spark, catalog, tmp_path):
    manifest = files.write_by_category(catalog, f"{tmp_path}/cat", ("fridge", "dryer", "dishwasher"))
    assert {r.cat: r.n for r in manifest.collect()} == {"fridge": 5, "dryer": 1, "dishwasher": 0}
    plan = fit.find_matches(spark.read.parquet(f"{tmp_path}/cat"), FitQuery(w=600, h=1900, d=650, cat="fridge"))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(w,590)" in plan and "PartitionFilters: [isnotnull(cat" in plan and "TakeOrderedAndProject" in plan and "Python" not in plan


def test_column_functions(spark):
    one = spark.range(1)
    value = lambda x: one.select(x).first()[0]
    assert [value(c.js_round(F.lit(x))) for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    assert [value(c.to_mm(F.lit(x))) for x in ("600", " 59.5 ", "0.2", "6e2", "abc", None)] == [600, 60, None, None, None, None]
    assert [value(c.cm_shorthand(F.lit(x))) for x in ("60", "59,5", "600", "-1", "x")] == [600, 595, 600, None, None]
    assert value(c.slug(F.lit("Fisher & Paykel  RF610"), 14)) == "fisher-paykel" and value(c.number_in(F.lit("$1,299.50"))) == 1299.5
    urls = {"https://www.jbhifi.com.au/products/x": (True, True), "https://www.jbhifi.com.au/collections/x": (False, False), "https://shop.example.org/p/1": (True, False), "https://shop.example.org/": (False, False), "https://x.org/p?q=1": (False, False), "not a url": (False, False), "https://www.harveynorman.com.au/a.html": (True, True)}
    for u, want in urls.items():
        assert (value(c.is_product_url_lenient(F.lit(u))), value(c.is_product_url_strict(F.lit(u)))) == want, u


def test_upsert_keeps_what_null_would_erase(spark):
    base = spark.createDataFrame([("a", 1, "x", None), ("b", 2, None, False)], "id string, w int, s string, unavailable boolean")
    new = spark.createDataFrame([("a", None, "y"), ("c", 3, None)], "id string, w int, s string")
    once = resolve.upsert(base, [new])
    assert sorted(map(tuple, once.select("id", "w", "s", "unavailable").collect())) == [("a", 1, "y", True), ("b", 2, None, False), ("c", 3, None, True)]
    assert sorted(map(str, resolve.upsert(once, [new]).collect())) == sorted(map(str, once.collect()))
    with pytest.raises(ValueError, match="DATA_LOSS"):
        resolve.raise_if_broken(resolve.breaker(base.limit(1), base, F.lit(False), ("id",)))


def test_limiters(spark):
    rows = [(1, k, f"2024-01-01 00:00:{k:02d}") for k in range(10)] + [(2, 10, "2024-01-01 00:00:00"), (2, 11, "2024-01-01 00:05:00")]
    events = spark.createDataFrame(rows, "user_id long, event_id long, t string").select("user_id", "event_id", F.to_timestamp("t").alias("ts"))
    assert sorted(map(tuple, telemetry.window_limited(events, "user_id", 3, 5).collect())) == [(1, 6, 4), (2, 2, 0)]
    assert sorted(map(tuple, telemetry.bucket_limited(events, "user_id", 2, 0.5).collect())) == [(1, 6, 4), (2, 2, 0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 2, "products": [{"id": "x", "w": 1}, {"id": "y", "cat": "dryer"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"products": [{"id": "x", "w": 2}]}))
    rows = files.first_by_slug(files.read_catalog(spark, f"{tmp_path}/*.json", "fridge"))
    assert {(r.id, r.cat, r.w) for r in rows.collect()} == {("x", "fridge", 1), ("y", "dryer", None)}
    (tmp_path / "r.ndjson").write_text('{"metric":"lcp","value":1,"path":"/"}\nnonsense\n{"path":"/"}\n')
    assert [(r.metric, r.value) for r in files.read_rum(spark, f"{tmp_path}/r.ndjson").collect()] == [("LCP", 1.0)]
    (tmp_path / "c.csv").write_text('Brand, Star 2010 ,Star\n"A ""b""", ,4\n c ,5\n')
    csv = files.read_csv_rows(spark, f"{tmp_path}/c.csv")
    assert [tuple(r) for r in csv.select("Brand", files.alias(csv, "Star 2010", "Star", "none")).collect()] == [('A "b"', "4"), ("c", "5")]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(k % 3, f"E{k % 4}", f"/s/{k % 3}.js", k % 2, f"2024-01-0{1 + k // 20} 00:{k % 60:02d}:00", k) for k in range(60)]
    events = spark.createDataFrame(rows, "user_id long, message string, source string, line int, t string, event_id long").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(f"{tmp_path}/in")
    stream = lambda: streams.read_stream(spark, f"{tmp_path}/in", events.schema)
    streams.run_once(streams.daily_firsts(stream()), f"{tmp_path}/first", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/first").count() == telemetry.daily_firsts(events).count()
    streams.run_once(streams.signature_counts(stream()), f"{tmp_path}/sig", f"{tmp_path}/c2", "update")
    got = {(r.signature, r.n) for r in spark.read.parquet(f"{tmp_path}/sig").collect()}
    assert got == {(r.signature, r.n) for r in telemetry.error_signatures(events).collect()}
    streams.run_once(streams.window_limited(stream(), "user_id", 4, 600.0), f"{tmp_path}/lim", f"{tmp_path}/c3")
    want = sorted(map(tuple, telemetry.window_limited(events, "user_id", 4, 600.0).collect()))
    assert sorted((r.user_id, r.allowed, r.refused) for r in spark.read.parquet(f"{tmp_path}/lim").collect()) == want


def test_offers_are_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    pairs = {(f"p{r.l_partkey}", r.l_suppkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    got = [(r.product_id, r.pos) for r in adapters.offers(spark, sf).collect()]
    assert len(got) == len(pairs) and set(got) == pairs


def test_short_texts_pair_by_words(spark):
    texts = ["red fox", "Red fox!", "fox red fox", "", None, "a b c d e f", "a b c d e f", "a b c d", "a b c d e"]
    got = {(r.a, r.b): r.similarity for r in text.shingle_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert got == {(0, 2): 1.0, (3, 4): 1.0, (5, 6): 1.0}  # tokens are what stands between spaces


def test_signal_queries_read_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, parts = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "part"))
    everyone = {r.doc_id for r in docs.select("doc_id").collect()}
    similar = {r.ord: r.similarity for r in signals.coverage_similarity(spark, sf).collect()}
    covered = {r.ord: r.similarity for r in signals.covered_queries(spark, sf).collect()}
    assert set(similar) == {i for i in everyone if i % 100 == 0} and everyone == {r.ord for r in signals.plan_cap(spark, sf).collect()}
    one = adapters.search_console(spark, sf).selectExpr("ord", "replace(query, ' ', '-') AS q").where("q <> ''").crossJoin(adapters.sitemap(spark, sf))
    best = {r.ord: r.s for r in one.selectExpr("ord", "1 - levenshtein(q, slug) / greatest(length(q), length(slug)) AS s").groupBy("ord").agg(F.max("s").alias("s")).collect()}
    assert all(abs(s - best[i]) < 1e-9 for i, s in similar.items() if i in best)
    assert covered.keys() == {i for i, s in best.items() if s > 0.9} and all(abs(s - best[i]) < 1e-9 for i, s in covered.items())
    assert {r.ord for r in signals.candidate_cascade(spark, sf).collect()} == everyone
    grams = signals.text_ngrams(spark, sf).collect()
    assert grams == text.repeated_ngrams(docs.withColumn("id", F.col("doc_id"))).collect()
    asked = {r.p_partkey for r in parts.select("p_partkey").collect()}
    assert {r.item for r in etl.feed_match(spark, sf).collect()} == asked
    assert len(search.replacement_sources(spark, sf).collect()) > len(asked) / 2
