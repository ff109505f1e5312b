"""Queries of page and pair selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfit.operators import selection as s
from spanfit.operators.facets import ranked
from spanfit.plans.oracle import with_tables
from spanfit.plans.search import catalog, slim_catalog
from spanfit.sources import adapters


def _catalog(spark, sf_dir):
    return slim_catalog(spark, sf_dir).withColumn("current_link", F.col("verified"))


def _needs(spark, sf_dir):
    return s.fridge_needs(adapters.products(spark, sf_dir), adapters.rules(spark, sf_dir))


def cavity_counts(spark, sf_dir):
    return s.range_counts(_needs(spark, sf_dir), *s.WIDTHS)


def cavity_featured(spark, sf_dir):
    return s.range_top(_needs(spark, sf_dir), [F.coalesce("stars", F.lit(-1)).desc(), F.asc("model")], 18, *s.WIDTHS).select("width", "rank", "id")


def cavity_brands(spark, sf_dir):
    return s.range_brands(_needs(spark, sf_dir), 8, *s.WIDTHS).select("width", "rank", "brand", "n")


def doorway_counts(spark, sf_dir):
    return s.range_counts(adapters.products(spark, sf_dir).select((F.col("w") + 10).alias("need")), *s.DOORWAYS)


def brand_ranking(spark, sf_dir):
    return s.brand_ranking(adapters.products(spark, sf_dir))


def brand_ranking_links(spark, sf_dir):
    return s.brand_ranking_by_links(slim_catalog(spark, sf_dir)).drop("best_linked")


def comparison_pairs(spark, sf_dir):
    return s.comparison_pairs(_catalog(spark, sf_dir), adapters.rules(spark, sf_dir))


def seeded_pairs(spark, sf_dir):
    return s.seeded_pairs(slim_catalog(spark, sf_dir))


def related_pairs(spark, sf_dir):
    return s.related_pairs(comparison_pairs(spark, sf_dir))


def check_combinations(spark, sf_dir):
    return s.check_combinations(adapters.products(spark, sf_dir)).select("id", "place", "width", "gap", "verdict")


def review_sample(spark, sf_dir):
    return s.review_sample(s.check_combinations(adapters.products(spark, sf_dir)))


def alternatives(spark, sf_dir):
    p = adapters.products(spark, sf_dir)
    return s.alternatives(p, p, 700)


def chassis_candidates(spark, sf_dir):
    p = adapters.products(spark, sf_dir)
    return s.chassis_candidates(p, p.where("ord % 2 = 0"))


def _widths(spark, sf_dir):
    return adapters.products(spark, sf_dir).select(F.col("w").alias("width")).distinct()


def width_neighbours(spark, sf_dir):
    return s.neighbours(_widths(spark, sf_dir))


def nearest_widths(spark, sf_dir):
    return s.nearest_widths(_widths(spark, sf_dir))


def top_models(spark, sf_dir):
    keys = [F.desc("verified"), F.coalesce("stars", F.lit(-1)).desc(), F.desc("h"), F.asc("model")]
    return ranked(slim_catalog(spark, sf_dir), keys, ["cat", "brand"], 3).select("cat", "brand", "rank", "id")


def top_by_stars(spark, sf_dir):
    return ranked(adapters.products(spark, sf_dir), [F.desc("stars"), F.desc("priority"), F.asc("ord")], ["cat"], 3).select("cat", "rank", "id")


def cheapest_offer(spark, sf_dir):
    return s.cheapest_offer(adapters.offers(spark, sf_dir))


def quota_pick(spark, sf_dir):
    return s.quota_pick(adapters.products(spark, sf_dir), {"fridge": 2, "washing_machine": 1, "dishwasher": 1, "dryer": 1}).select("cat", "rank", "id")


def latest_per_key(spark, sf_dir):
    rows = adapters.read(spark, sf_dir, "events").withColumn("kind", F.concat("event_type", F.lit(":"), (F.col("event_id") % 5).cast("string")))
    return s.latest_per_key(rows, "user_id", "kind", 8).select("user_id", "rank", "kind", "event_id")


def round_robin(spark, sf_dir):
    return s.round_robin(adapters.products(spark, sf_dir), "cat", {"fridge": 8, "dryer": 5, "dishwasher": 2}, 30).select("id", "cat", "left_over")


def work_page(spark, sf_dir):
    return s.page(adapters.products(spark, sf_dir), [F.desc("priority"), F.asc("ord")], 100, 50).select("rank", "id")


def width_clusters(spark, sf_dir):
    return s.width_clusters(adapters.products(spark, sf_dir))


def ranked_feed(spark, sf_dir):
    p = adapters.products(spark, sf_dir)
    a = p.where("cat = 'fridge'").select(F.col("model").alias("title"), F.concat(F.lit("/p/"), "id").alias("url"))
    b = p.select("brand").distinct().select(F.col("brand").alias("title"), F.concat(F.lit("/b/"), "brand").alias("url"))
    return s.feed(iter([(a, 40), (b, 90)]))


QUERIES = [cavity_counts, cavity_featured, cavity_brands, doorway_counts, brand_ranking, brand_ranking_links, comparison_pairs, seeded_pairs, related_pairs, check_combinations, review_sample, alternatives, chassis_candidates, width_neighbours, nearest_widths, top_models, top_by_stars, cheapest_offer, quota_pick, latest_per_key, round_robin, work_page, width_clusters, ranked_feed]

_NEEDS = "(SELECT p.*, w + 2 * coalesce(side, 20) AS need FROM products p LEFT JOIN rules r ON r.cat = p.cat AND r.brand = p.brand WHERE p.cat = 'fridge')"
_SPINE = "(SELECT CAST(range AS INTEGER) AS width FROM range(500, 1101, 10))"
_RN = "CAST(row_number() OVER ({}) AS INTEGER) AS rank"
_BRANDS = f"(SELECT cat, brand, count(*) AS n, {_RN.format('PARTITION BY cat ORDER BY count(*) DESC, brand')} FROM products GROUP BY cat, brand)"
_WEIGHT = "(CASE WHEN n_offers > 0 THEN 10000 ELSE 0 END + CASE WHEN unavailable THEN 0 ELSE 5000 END + priority + stars * 10)"
_LINKED = f"""(SELECT *, {_RN.format('PARTITION BY cat ORDER BY n_linked DESC, n DESC, best_score DESC, brand')} FROM (SELECT cat, brand, count(*) AS n, count(*) FILTER (WHERE n_offers > 0) AS n_linked,
    max({_WEIGHT}) AS best_score, arg_min(n_offers > 0, {{'a': -{_WEIGHT}, 'b': model}}) AS best_linked FROM catalog GROUP BY cat, brand))"""
_PAIRS = f"""(SELECT * FROM (SELECT a.cat, {_RN.format('PARTITION BY a.cat ORDER BY a.rank + b.rank, a.n + b.n DESC, a.brand, b.brand')}, a.brand AS brand_a, b.brand AS brand_b, a.n AS n_a, b.n AS n_b
    FROM (SELECT x.*, bool_or(verified) AS linked FROM {_BRANDS} x JOIN rules USING (cat, brand) JOIN catalog USING (cat, brand) WHERE x.rank <= 8 AND x.n >= 3 GROUP BY ALL) a
    JOIN (SELECT x.*, bool_or(verified) AS linked FROM {_BRANDS} x JOIN rules USING (cat, brand) JOIN catalog USING (cat, brand) WHERE x.rank <= 8 AND x.n >= 3 GROUP BY ALL) b
    ON a.cat = b.cat AND a.rank < b.rank AND (a.linked OR b.linked)) WHERE rank <= 10)"""
_GAP = "CAST(width - (w + 10) AS INTEGER)"
_VERDICT = f"CASE WHEN {_GAP} >= 20 THEN 'perfect' WHEN {_GAP} >= 5 THEN 'tight' WHEN {_GAP} >= 0 THEN 'binding' ELSE 'no-fit' END"
_COMBOS = f"""(SELECT id, place, width, {_GAP} AS gap, {_VERDICT} AS verdict FROM (SELECT *, CAST(row_number() OVER (ORDER BY priority DESC, display_name, ord) AS INTEGER) AS place FROM products),
    (SELECT unnest([540, 580, 600, 620, 650, 700, 800, 900]) AS width) WHERE place <= 200)"""

ORACLE = {
    "cavity_counts": f"SELECT width, (SELECT count(*) FROM {_NEEDS} WHERE need <= width) AS n FROM {_SPINE}",
    "cavity_featured": f"SELECT * FROM (SELECT width, {_RN.format('PARTITION BY width ORDER BY stars DESC, model')}, id FROM {_SPINE} JOIN {_NEEDS} ON need <= width) WHERE rank <= 18",
    "cavity_brands": f"SELECT * FROM (SELECT width, {_RN.format('PARTITION BY width ORDER BY count(*) DESC, brand')}, brand, count(*) AS n FROM {_SPINE} JOIN {_NEEDS} ON need <= width GROUP BY width, brand) WHERE rank <= 8",
    "doorway_counts": "SELECT CAST(range AS INTEGER) AS width, (SELECT count(*) FROM products WHERE w + 10 <= range) AS n FROM range(600, 901, 10)",
    "brand_ranking": f"SELECT cat, brand, n, rank FROM {_BRANDS}",
    "brand_ranking_links": f"SELECT cat, brand, n, n_linked, best_score, rank FROM {_LINKED}",
    "comparison_pairs": f"SELECT cat, rank, brand_a, brand_b, n_a, n_b FROM {_PAIRS}",
    "seeded_pairs": f"""SELECT a.cat, a.brand AS brand_a, b.brand AS brand_b, b.rank > 5 AS extra FROM {_LINKED} a JOIN {_LINKED} b ON a.cat = b.cat AND a.rank < b.rank AND b.rank <= 12 AND (a.best_linked OR b.best_linked)
        ORDER BY extra, CASE a.cat WHEN 'fridge' THEN 0 WHEN 'dishwasher' THEN 1 WHEN 'dryer' THEN 2 ELSE 3 END, a.rank, b.rank LIMIT 100""",
    "related_pairs": f"""SELECT cat, slug, rank, related FROM (SELECT a.cat, a.brand_a || '-vs-' || a.brand_b AS slug, b.brand_a || '-vs-' || b.brand_b AS related,
        {_RN.format("PARTITION BY a.cat, a.brand_a || '-vs-' || a.brand_b ORDER BY CASE WHEN a.brand_a IN (b.brand_a, b.brand_b) OR a.brand_b IN (b.brand_a, b.brand_b) THEN 0 ELSE 1 END, b.n_a + b.n_b DESC, b.brand_a || '-vs-' || b.brand_b")}
        FROM {_PAIRS} a JOIN {_PAIRS} b ON a.cat = b.cat AND a.rank <> b.rank) WHERE rank <= 8""",
    "check_combinations": f"SELECT id, place, width, gap, verdict FROM {_COMBOS}",
    "review_sample": f"""SELECT verdict, rank, id, width, gap FROM (SELECT *, {_RN.format('PARTITION BY verdict ORDER BY CASE WHEN k > 1 THEN 1 ELSE 0 END, place, width')}
        FROM (SELECT *, row_number() OVER (PARTITION BY verdict, id ORDER BY place, width) AS k FROM {_COMBOS})) WHERE rank <= CASE verdict WHEN 'perfect' THEN 5 WHEN 'tight' THEN 3 WHEN 'no-fit' THEN 2 ELSE 0 END""",
    "alternatives": f"SELECT id, rank, alternative, gap FROM (SELECT a.id, b.id AS alternative, CAST(690 - b.w AS INTEGER) AS gap, {_RN.format('PARTITION BY a.id ORDER BY abs(690 - b.w - 20), b.priority DESC, b.display_name, b.ord')} FROM products a JOIN products b ON a.cat = b.cat AND a.id <> b.id AND NOT b.unavailable AND 690 - b.w >= 5) WHERE rank <= 3",
    "chassis_candidates": "SELECT a.id, b.id AS candidate, b.w FROM products a JOIN products b ON a.cat = b.cat AND a.brand = b.brand AND a.id <> b.id AND b.ord % 2 = 0 AND abs(a.w - b.w) <= 5",
    "width_neighbours": f"SELECT width, lag(width) OVER (ORDER BY width) AS previous, lead(width) OVER (ORDER BY width) AS next FROM (SELECT DISTINCT w AS width FROM products)",
    "nearest_widths": f"SELECT * FROM (SELECT a.width, b.width AS other, {_RN.format('PARTITION BY a.width ORDER BY abs(a.width - b.width), b.width')} FROM (SELECT DISTINCT w AS width FROM products) a JOIN (SELECT DISTINCT w AS width FROM products) b ON a.width <> b.width) WHERE rank <= 8",
    "top_models": f"SELECT * FROM (SELECT cat, brand, {_RN.format('PARTITION BY cat, brand ORDER BY verified DESC, stars DESC, h DESC, model')}, id FROM catalog) WHERE rank <= 3",
    "top_by_stars": f"SELECT * FROM (SELECT cat, {_RN.format('PARTITION BY cat ORDER BY stars DESC, priority DESC, ord')}, id FROM products) WHERE rank <= 3",
    "cheapest_offer": "SELECT product_id, n, price, url FROM (SELECT *, CASE WHEN p > 0 THEN p ELSE 2147483647 END AS price, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN p > 0 THEN p ELSE 2147483647 END, lower(n), pos) AS k FROM offers) WHERE k = 1",
    "quota_pick": f"SELECT * FROM (SELECT cat, {_RN.format('PARTITION BY cat ORDER BY priority DESC, stars DESC, ord')}, id FROM products) WHERE rank <= CASE cat WHEN 'fridge' THEN 2 ELSE 1 END",
    "latest_per_key": f"""SELECT * FROM (SELECT user_id, {_RN.format('PARTITION BY user_id ORDER BY ts DESC, event_id DESC')}, kind, event_id FROM (SELECT user_id, kind, ts, event_id, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) AS k
        FROM (SELECT *, event_type || ':' || CAST(event_id % 5 AS VARCHAR) AS kind FROM events)) WHERE k = 1) WHERE rank <= 8""",
    "round_robin": "SELECT id, cat, left_over FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY ord) > CASE cat WHEN 'fridge' THEN 8 WHEN 'dryer' THEN 5 WHEN 'dishwasher' THEN 2 ELSE 0 END AS left_over FROM products) ORDER BY left_over, ord LIMIT 30",
    "work_page": f"SELECT * FROM (SELECT {_RN.format('ORDER BY priority DESC, ord')}, id FROM products) WHERE rank > 100 AND rank <= 150",
    "ranked_feed": "SELECT * FROM (SELECT model AS title, '/p/' || id AS url, 40 AS score FROM products WHERE cat = 'fridge' UNION ALL SELECT DISTINCT brand, '/b/' || brand, 90 FROM products) ORDER BY score DESC, title LIMIT 50",
}


def oracle() -> dict[str, str]:
    return {n: with_tables(q) for n, q in ORACLE.items()}
