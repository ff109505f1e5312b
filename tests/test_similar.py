"""Joins on likeness at sizes that Spark underestimates: nothing that grows goes through the driver."""

import random
import re
from collections import Counter

from spanfit.operators import resolve, selection, similar, text
from spanfit.operators.replacement import best_sources
from spanfit.plans import extras, names, records

NAMES = ["largering1", "largering12", "largering123", "largerung123", "oldbolt", "bolt", "x" * 40 + "bolt", "y" * 33]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def test_contained_deals_both_sides(spark):
    needles = spark.createDataFrame([(k, n) for k, n in enumerate([*NAMES, "", "bolt", "absent"])], "k int, needle string")
    hays = spark.createDataFrame([(k, h) for k, h in enumerate([*(f"new{n}now" for n in NAMES), "bolt", "", None, "bolt"])], "i int, hay string")
    got = similar.contained(needles, hays, "needle", "hay")
    want = sorted((n.k, h.i) for n in needles.collect() for h in hays.collect() if n.needle and h.hay and n.needle in h.hay)
    assert sorted((r.k, r.i) for r in got.collect()) == want
    assert "BroadcastHashJoin" not in plan(got)


def test_replacement_asks_names_only_of_unsettled_texts(spark):
    products = spark.createDataFrame([("p1", 1, "A#1", "ring 1", "A#1 large ring"), ("p2", 2, "A#1", "ring 12", "A#1 old bolt")], "id string, ord int, brand string, model string, display_name string").selectExpr("*", "'fridge' as cat")
    asked = spark.createDataFrame([(1, "A#1 ring 12 x"), (2, "old bolt"), (3, "nothing here")], "ask int, text string")
    got = best_sources(asked, products)
    assert {(r.ask, r.id, r.score) for r in got.collect()} == {(1, "p1", 95), (2, "p2", 78)} and "BroadcastHashJoin" not in plan(got)


def test_feed_and_prefix_match_deal_both_sides(spark):
    p = spark.createDataFrame([("p1", 1, "A#1", "ring 1", 1, 1, 1), ("p2", 2, "A#1", "ring 12", 1, 1, 9)], "id string, ord int, brand string, model string, w int, h int, d int")
    feed = spark.createDataFrame([(1, "New A#1 ring 12 now", None, None), (2, "x", "A#1", "ring 1")], "item int, name string, brand string, model string")
    got = resolve.feed_match(feed, p)
    assert {tuple(r) for r in got.collect()} == {(1, "p2", False), (2, "p1", True)} and "BroadcastHashJoin" not in plan(got)
    got = resolve.prefix_match(spark.createDataFrame([(7, "A#1", "ring 123", 1, 9, 1)], "item int, brand string, model string, w int, h int, d int"), p)
    assert [tuple(r) for r in got.collect()] == [(7, "p1", "h")] and "BroadcastHashJoin" not in plan(got)


def test_few_edits_meets_shortened_texts(spark):
    words = [*NAMES, "largerng13", "lrgring123", "oldbolts", "ldbolz", "bo", "b", "x" * 39 + "bolt", "x" * 33, "z" + "y" * 32, "z" + "y" * 31, "largering4567890"]
    a, b = spark.createDataFrame([("s", w) for w in words], "b string, m string"), spark.createDataFrame([("s", w) for w in words] + [("t", "bolt")], "b string, c_m string")
    got = similar.few_edits(a, b, "m", "c_m", 2, ("b",))
    assert sorted((r.m, r.c_m) for r in got.collect()) == sorted((x, y) for x in words for y in words if edits(x, y) <= 2)
    assert similar.shortened(a.where("m = 'bolt'"), "m", 2).count() == 1 + 4 + 6


def test_coverage_meets_all_slugs_for_far_queries_alone(spark):
    queries = spark.createDataFrame([(1, "large ring of iron"), (2, "zz"), (3, "?"), (4, "old bolt and nut")], "ord int, query string")
    slugs = spark.createDataFrame([(s,) for s in ("large-ring-of-irons", "old-bolts", "zzz", "")], "slug string")
    got = {r.ord: r.similarity for r in text.coverage_similarity(queries, slugs).collect()}
    assert got == {1: 1 - 1 / 19, 2: 1 - 1 / 3, 3: 0.0, 4: 1 - edits("old-bolt-and-nut", "old-bolts") / 16}


def test_ngrams_are_counted_whole_after_buckets(spark, monkeypatch):
    monkeypatch.setattr(text, "GRAM_BUCKETS", 7)
    docs = [(1, "a b c a b c a b c d"), (2, "a b c x y z x y z"), (3, ""), (4, "q r s t u v w " * 3)]
    n, docs_of = Counter(), Counter()
    for _, t in docs:
        w = t.split()
        own = Counter(" ".join(w[k : k + s]) for s in (3, 4, 5) for k in range(len(w) - s + 1))
        n.update(own)
        docs_of.update(own.keys())
    want = sorted(((g, k, docs_of[g]) for g, k in n.items() if k >= 2), key=lambda r: (-r[1], r[0]))[:5]
    got = text.repeated_ngrams(spark.createDataFrame(docs, "id int, text string"), least=2, most=5).orderBy("rank").collect()
    assert [(r.gram, r.n, r.docs) for r in got] == want
    assert text.repeated_ngrams(spark.createDataFrame(docs, "id int, text string"), least=9).collect() == []


def test_pairs_of_copies_are_made_at_the_end(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(5, base), (1, base + " more"), (3, base), (9, base.upper()), (2, "short"), (4, "short"), (6, ""), (7, None), (8, "alone in the world here")]
    got = text.shingle_pairs(spark.createDataFrame(docs, "id int, text string"))
    assert sorted((r.a, r.b, round(r.similarity, 3)) for r in got.collect()) == [(1, 3, 0.889), (1, 5, 0.889), (1, 9, 0.889), (2, 4, 1.0), (3, 5, 1.0), (3, 9, 1.0), (5, 9, 1.0), (6, 7, 1.0)]


def near_copies(r, n, words, changed):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    return [" ".join(f"x{r.randrange(10**6)}" if r.random() < changed else w for w in base[: words - r.randrange(words // 4)]) for _ in range(n)]


def test_pairs_are_all_pairs(spark, monkeypatch):
    """Whatever the buckets and blocks (F1): against the sets themselves."""
    for name, n in (("ORDER_BUCKETS", 13), ("ASKED_BUCKETS", 11), ("BLOCK", 150)):
        monkeypatch.setattr(text, name, n)
    r = random.Random(5)
    texts = [*near_copies(r, 14, 60, 0.01), *near_copies(r, 12, 60, 0.03), *near_copies(r, 8, 9, 0.02), *(" ".join(r.choices("abc", k=r.randrange(8))) for _ in range(40)), "a " * 300, "a " * 301, "\t\n", "A\tb\r\nc", "a b c", "p\u00a0q", "p q", "y" * 65, "y" * 66, "<p>a</p><!-- x --> B <script>q</script>c", "\u0130 \u00c9t\u00e9", None]
    docs = list(enumerate([*texts, *r.choices(texts, k=12)]))

    def shingles(t):
        for tag in (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
            t = re.sub(tag, " ", t)
        w = [x for x in re.split("[ \t\r\n]+", t.lower()) if x]
        return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else set(w) or {""}

    sets = {k: shingles(t or "") for k, t in docs}
    share = {(a, b): len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}
    got = text.shingle_pairs(spark.createDataFrame([*docs, (None, texts[0])], "id int, text string")).collect()
    want = {p: s for p, s in share.items() if s >= 0.8}
    assert len(want) > 150 and {(x.a, x.b): x.similarity for x in got} == want and len(got) == len(want)
    assert text.shingle_pairs(spark.createDataFrame([], "id int, text string")).collect() == []


def test_pairs_deal_few_shingles(spark, monkeypatch):
    """Bytes that shuffles write (F1): not every shingle, and no set for every document that it meets."""
    monkeypatch.setattr(text, "ORDER_BUCKETS", 64, raising=False)
    r = random.Random(6)
    docs = spark.createDataFrame(list(enumerate([*near_copies(r, 60, 400, 0.01), *(x for _ in range(60) for x in near_copies(r, 1, 400, 0))])), "id long, text string").localCheckpoint()
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty()
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    assert text.shingle_pairs(docs).count() > 300
    written = sum(n for k, n in stages().items() if k not in before)
    assert written < 10 * docs.selectExpr("sum(size(split(text, ' ')))").first()[0], written


def test_review_audit_keeps_references_without_semicolon(spark, tmp_path):
    spark.createDataFrame([(5, "u", "<p>one two&amp three &amp; four&quot&ampx</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.words for r in extras.review_audit(spark, str(tmp_path)).collect()] == [11]  # words of paragraphs that follow each other run together


def test_small_rows_that_make_many_are_dealt(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('p', id) as id", "if(id >= 0, 'c', 'd') as cat", "if(id >= 0, 'b', 'd') as brand", "cast(600 + id as int) as w")
    got = selection.chassis_candidates(rows, rows.where("w % 2 = 0"))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.count() == sum(abs(a - b) <= 5 and a != b for a in range(40) for b in range(0, 40, 2))
    spark.range(30).selectExpr("id as p_partkey", "'a' as p_name", "'Brand#1' as p_brand", "'T' as p_type", "1 as p_size", "1d as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for query in (records.record_errors, names.slug_discovery):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
