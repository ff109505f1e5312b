"""Many searches at once against one search at a time; names in a dictionary's order."""

import random

import pytest
from pyspark.sql import functions as F

from spanfit.functions.columns import by_name
from spanfit.operators import batch
from spanfit.operators.fit import FitQuery, find_matches
from spanfit.operators.replacement import best_sources
from spanfit.operators.session import SearchState, read_url, read_urls, write_url

PRODUCTS = "ord long, id string, cat string, brand string, model string, display_name string, w int, h int, d int, priority int"
RULES = "cat string, brand string, side int, top int, rear int"


@pytest.fixture(scope="module")
def products(spark):
    r = random.Random(4)
    rows = []
    for k in range(400):
        cat = r.choice(["fridge", "dryer", "washing_machine", "washtower_combo"])
        size = [r.randrange(400, 1100), r.randrange(300, 2300), r.randrange(450, 900)]
        if k % 41 == 0:
            size[k % 3] = None
        rows.append((k, f"p{k}", cat, f"b{k % 7}", f"M{k}" if k % 13 else f"WWT{k}", r.choice(["Zebra", "apple", "Äpfel", "Apple"]), *size, r.choice([None, 3, 50])))
    return spark.createDataFrame(rows, PRODUCTS).repartition(3).cache()


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame([("fridge", "b1", 30, 50, 5), ("fridge", "__default__", 1, 2, 3), ("dryer", "b2", None, 9, None)], RULES)


def shape(q):
    mode = "physical" if q.replacement else q.mode
    towers = {"washtower_combo": "only", "dryer": "none", "washing_machine": "none"}.get(q.source_category, "any") if q.replacement else "any"
    return (f"{mode}|{q.cat or '*'}", towers, q.w, q.h, q.d)


def test_batch_equals_single_searches(spark, products, rules):
    r = random.Random(8)
    asked = []
    for k in range(24):
        size = {a: r.choice([None, r.randrange(lo, hi)]) for a, lo, hi in (("w", 500, 1200), ("h", 800, 2400), ("d", 500, 950))}
        replacing = k % 4 == 0
        asked.append(FitQuery(**size, cat=r.choice([None, "fridge", "dryer", "washtower_combo"]), mode="practical" if replacing else r.choice(["practical", "physical", "manufacturer"]), replacement=replacing, source_category=r.choice(["washtower_combo", "dryer", "fridge"]) if replacing else None))
    rows = [(k, q.cat, q.w, q.h, q.d, q.mode, "replacement" if q.replacement else "cavity", q.source_category) for k, q in enumerate(asked)]
    log = spark.createDataFrame(rows, "search_id int, cat string, w int, h int, d int, mode string, search_mode string, source_cat string")
    got = {}
    for x in batch.batch_matches(log, products, rules, limit=7).collect():
        got.setdefault(tuple(x[c] for c in batch.SHAPE), []).append((x["rank"], x.id, round(x.sort_score, 9)))
    found = 0
    for q in asked:
        want = [(k + 1, x.id, round(x.sort_score, 9)) for k, x in enumerate(find_matches(products, q, rules, limit=7).collect())] if q.cavity else []
        found += len(want)
        assert sorted(got.get(shape(q), [])) == want, q
    assert found > 60


def test_searches_meet_products_on_equal_cells(spark, products, rules):
    log = spark.createDataFrame([("fridge", 700, 1900, 700, "practical")], "cat string, w int, h int, d int, mode string")
    plan = batch.batch_matches(log, products, rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    needed = batch.needs(products, rules)
    visited = batch.searched(log).join(batch.grid(needed), "scope").select(F.size(F.array_distinct(batch._visits(5))).alias("some"), F.size(F.array_distinct("cells.cell")).alias("all")).first()
    assert visited.some < visited["all"] / 2


def test_products_of_one_size_meet_once(spark):
    """Searches meet sizes, and of a size no more products than are shown (F17, F18); results stay those of single searches."""
    r = random.Random(2)
    rows = [(k, f"p{k}", "fridge" if k % 3 else "dryer", "b", f"M{k}", r.choice(["a", "B", "c"]), 600 + 7 * (k % 3), None if k % 5 == 4 else 1500 + 10 * (k % 4), 500 + k % 2, r.choice([None, 1, 2])) for k in range(600)]
    many = spark.createDataFrame(rows, PRODUCTS).repartition(3)
    asked = [FitQuery(w=w, h=h, d=d, cat=c, mode=m) for w, h, d, c, m in ((620, 1600, 600, None, "physical"), (625, None, 540, "fridge", "practical"), (640, 1531, None, "dryer", "practical"), (620, None, None, None, "practical"), (None, 1800, 501, "fridge", "physical"))]
    log = spark.createDataFrame([(q.cat, q.w, q.h, q.d, q.mode) for q in asked], "cat string, w int, h int, d int, mode string")
    got = {}
    for x in batch.batch_matches(log, many, limit=9).collect():
        got.setdefault(tuple(x[c] for c in batch.SHAPE), []).append((x["rank"], x.id, round(x.sort_score, 9)))
    for q in asked:
        assert sorted(got[shape(q)]) == [(k + 1, x.id, round(x.sort_score, 9)) for k, x in enumerate(find_matches(many, q, limit=9).collect())], q
    most = batch.leading(batch.needs(many), 9).groupBy("scope", "tower", "need_w", "need_h", "need_d").count().agg(F.max("count"))
    assert most.first()[0] == 9


def test_answers_of_a_log(spark, products):
    urls = [(1, "?cat=fridge&w=900&h=2200&d=850&tol=7"), (2, "?cat=fridge&w=100"), (3, ""), (4, None), (5, "?cat=fridge&w=900&h=2200&d=850&tol=-3")]
    log = read_urls(spark.createDataFrame(urls, "search_id int, query string"))
    got = {x.search_id: x for x in batch.batch_answers(log, products, F.coalesce("cat", F.lit("Appliances"))).collect()}
    want = [x.id for x in find_matches(products, FitQuery(w=900, h=2200, d=850, cat="fridge")).collect()]
    assert got[1].exact == got[1].relaxed == len(want) and got[1].best == ",".join(want[:3]) and got[1].action == "Relax to 7mm"
    assert [got[k].exact for k in (2, 3, 4)] == [0, 0, 0] and got[2].action == "Try a preset" and got[3].detail.startswith("No appliances fit yet")
    assert got[5].action == "Relax to 0mm"


def test_replacement_run_is_its_steps(spark, products):
    asked = spark.createDataFrame([(1, "the apple M7"), (2, "nothing like it"), (3, "M41"), (4, "zebra WWT13")], "ask long, text string")
    got = {}
    for x in batch.replacement_runs(asked, products, limit=5).collect():
        got.setdefault(x.ask, []).append(x)
    source = {x.ask: x.id for x in best_sources(asked, products).collect()}
    size = {x.id: x for x in products.collect()}
    assert set(got) == {1, 2, 3, 4} and got[2][0].source is None and got[2][0].id is None
    for ask, name in source.items():
        p = size[name]
        if None in (p.w, p.h, p.d):
            assert [x.id for x in got[ask]] == [None]
            continue
        tower = p.cat == "washtower_combo" or p.model.startswith("WWT")
        q = FitQuery(w=p.w + 10, h=p.h + 20, d=p.d + 10, cat=p.cat, replacement=True, source_category="washtower_combo" if tower else p.cat)
        assert [x.id for x in sorted(got[ask], key=lambda x: x["rank"])] == [x.id for x in find_matches(products, q, limit=5).collect()]


def test_url_state_round_trip(spark):
    states = [SearchState(), SearchState(cat="dryer", w=600, tolerance=0.5, search_mode="replacement", source_cat="washtower_combo", brands=("A & B", "c"), price_min=5.0), SearchState(mode="physical", source_cat="fridge", retailer_only=False)]
    for s in states:
        assert read_url("?" + write_url(s)) == s
    odd = ["tol=-3", "tol=0", "tol=abc", "tol=99", "tol=NaN", "searchMode=x&replaceCat=Wash-Tower", "replaceCat=washing%20machine", "replaceCat=car", "tol=", "searchMode=replacement", "brand=a%2Cb", "cat=&w=5&w=6"]
    rows = read_urls(spark.createDataFrame([(k, q) for k, q in enumerate(odd)], "k int, query string")).orderBy("k").collect()
    for q, x in zip(odd, rows, strict=True):
        s = read_url(q)
        assert (x.tolerance, x.search_mode, x.source_cat, tuple(x.brands), x.cat, x.w) == (s.tolerance, s.search_mode, s.source_cat, s.brands, s.cat, s.w), q
    assert [read_url(q).tolerance for q in odd[:5]] == [0.0, 5.0, 5.0, 20.0, 5.0]


def test_names_in_dictionary_order(spark):
    names = spark.createDataFrame([("Zebra",), ("äpfel",), ("apple",), ("Apple",), ("Öl",), ("ofen",), ("éclair",)], "n string")
    assert [x.n for x in names.orderBy(by_name(F.col("n"))).collect()] == ["äpfel", "apple", "Apple", "éclair", "ofen", "Öl", "Zebra"]
    assert names.where(by_name(F.col("n"), base=True) == F.lit("ECLAIR").cast("string")).count() == 1
    p = spark.createDataFrame([(1, "a", "fridge", "b", "x1", "Zebra", 500, 500, 500, 1), (2, "b", "fridge", "b", "x2", "élan", 500, 500, 500, 1), (3, "c", "fridge", "b", "x3", "Fan", 500, 500, 500, 1)], PRODUCTS)
    assert [x.id for x in find_matches(p, FitQuery(w=600)).collect()] == ["b", "c", "a"]
