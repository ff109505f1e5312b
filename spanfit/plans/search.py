"""Queries of the search family: fit, scores, facets, sorts, near misses, replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfit.functions.columns import is_product_url_audit, is_product_url_lenient, is_product_url_strict
from spanfit.operators import facets as fc
from spanfit.operators import fit
from spanfit.operators.fit import FitQuery
from spanfit.operators.replacement import best_sources, suggestions
from spanfit.plans.oracle import PRODUCT_URL, fit_sql, with_tables
from spanfit.sources import adapters

CAVITY = {"w": 700, "h": 1900, "d": 700}
FRIDGE = FitQuery(**CAVITY, cat="fridge")
BASE = ["id", "brand", "sort_score", "fit_score_numeric", "binding_axis", "tightest_gap_mm"]
SQL_BASE = ", ".join(BASE)
ORDER = "sort_score, priority DESC, display_name, ord"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their offers, and flags of their links."""
    return _flagged(adapters.with_retailers(adapters.products(spark, sf_dir), adapters.offers(spark, sf_dir)))


def slim_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with what questions about links need: n_offers, linked, verified, current, checked. Flags are aggregated where offers are grouped, so none is nested."""
    o = adapters.offers(spark, sf_dir)
    flags = o.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n_offers"), F.bool_or(is_product_url_lenient(F.col("url"))).alias("linked"), F.bool_or(is_product_url_strict(F.col("url"))).alias("verified"), F.max("verified_at").alias("checked"))
    rows = adapters.products(spark, sf_dir).join(flags, "id", "left").na.fill({"n_offers": 0, "linked": False, "verified": False})
    return rows.withColumn("current", F.coalesce(~F.col("unavailable"), F.lit(False)) & F.col("linked"))


def _flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"current": fc.is_current(), "verified": F.exists("retailers", lambda r: is_product_url_strict(r["url"]))})


def fitting(spark: SparkSession, sf_dir: str, q: FitQuery) -> DataFrame:
    """The products that fit, with their offers: the cavity thins products and offers out before any offer is nested."""
    rows = fit.fits(adapters.products(spark, sf_dir), q)
    own = adapters.offers(spark, sf_dir).join(rows.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    return _flagged(adapters.with_retailers(rows, own))


def fit_search(spark, sf_dir):
    return fc.ranked(fit.fits(adapters.products(spark, sf_dir), FRIDGE), fit.best_first(), most=60).select("rank", *BASE)


def fit_search_manufacturer(spark, sf_dir):
    q = FitQuery(**CAVITY, cat="dryer", mode="manufacturer")
    return fit.fits(adapters.products(spark, sf_dir), q, adapters.rules(spark, sf_dir)).select(*BASE, *(f"required_{a}" for a in "whd"))


def fit_search_replacement(spark, sf_dir):
    q = FitQuery(w=650, h=1000, d=650, cat="washing_machine", replacement=True, source_category="washing_machine")
    return fit.fits(adapters.products(spark, sf_dir), q).select("id", "fit_score_numeric", *(f"{k}_{a}" for k in ("required", "size_gap") for a in "whd"))


def fit_gaps(spark, sf_dir):
    return fit.fits(adapters.products(spark, sf_dir), FitQuery(**CAVITY)).select("id", *(f"{k}_{a}" for k in ("gap", "size_gap") for a in "whd"), "exact_fit", "fits_tightly")


def fit_tiers(spark, sf_dir):
    rows = fit.fits(adapters.products(spark, sf_dir), FitQuery(**CAVITY)).withColumn("tier", fit.tier(F.col("fit_score_numeric")))
    return rows.groupBy("cat", "tier").agg(F.count("*").alias("n")).withColumn("label", fit.tier_label(F.col("tier")))


def fit_breakdown(spark, sf_dir):
    q = FitQuery(**CAVITY, cat="fridge")
    return fit.fits(adapters.products(spark, sf_dir), q).select("id", *(c.alias(n) for n, c in fit.score_breakdown(q).items()))


def fit_modes_monotone(spark, sf_dir):
    p = adapters.products(spark, sf_dir)
    each = [fit.fits(p, FitQuery(**CAVITY, mode=m)).groupBy("cat").agg(F.count("*").alias("n")).withColumn("mode", F.lit(m)) for m in ("physical", "practical")]
    return each[0].unionByName(each[1])


def deduction_scores(spark, sf_dir):
    return adapters.products(spark, sf_dir).select("id", *(c.alias(n) for n, c in fit.deduction_score(FitQuery(**CAVITY)).items()))


def near_misses(spark, sf_dir):
    return fit.near_misses(adapters.products(spark, sf_dir), FRIDGE).select("id", "needed_mm", "needed_axis")


def awkward_spaces(spark, sf_dir):
    rows = adapters.products(spark, sf_dir).select("id", F.explode(fit.awkward_flags()).alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))


def width_verdicts(spark, sf_dir):
    rows = adapters.products(spark, sf_dir).select("cat", *(c.alias(n) for n, c in fit.width_verdict(F.lit(700)).items()))
    return rows.groupBy("cat", "verdict").agg(F.count("*").alias("n"), F.min("gap").alias("least_gap"))


def delivery_paths(spark, sf_dir):
    return adapters.products(spark, sf_dir).select("id", *(c.alias(n) for n, c in (fit.delivery_path() | fit.replacement_dimensions()).items()))


def facet_search(spark, sf_dir):
    pool = fitting(spark, sf_dir, FitQuery(**CAVITY)).where("current")
    chosen = fc.apply_facets(pool, fc.Facets(brands=(" brand#2 ", "Brand#17", "BRAND#4"), price_max=950, stars=2))
    return fc.ranked(chosen, fc.order_for("price-asc"), most=100).select("rank", "id", "price", "stars")


def facet_counts(spark, sf_dir):
    return fc.facet_counts(fitting(spark, sf_dir, FitQuery(**CAVITY)).where("current"))


def _sorted(name, order):
    def query(spark, sf_dir):
        return fc.ranked(fitting(spark, sf_dir, FRIDGE), order(), most=40).select("rank", "id")

    query.__name__ = name
    return query


SORTS = {f"sort_{s.replace('-', '_')}": (lambda s=s: fc.order_for(s)) for s in ("price-asc", "price-desc", "popularity", "stars")}
SORTS |= {f"rating_{s.replace('-', '_')}": (lambda s=s: fc.rating_order(s)) for s in ("score", "price-asc", "price-desc", "stars", "brand", "verified-first")}
_SCORE = f"coalesce(fit_score_numeric, -1) DESC, {ORDER}"
SORT_SQL = {
    "sort_price_asc": f"price ASC NULLS LAST, {ORDER}", "sort_price_desc": f"price DESC NULLS LAST, {ORDER}", "sort_popularity": f"priority DESC, {ORDER}", "sort_stars": f"stars DESC, {ORDER}",
    "rating_score": _SCORE, "rating_price_asc": f"price ASC NULLS LAST, {_SCORE}", "rating_price_desc": f"price DESC NULLS LAST, {_SCORE}", "rating_stars": f"stars DESC, {_SCORE}", "rating_brand": f"brand, {_SCORE}", "rating_verified_first": f"verified DESC, {_SCORE}",
}


def range_sliders(spark, sf_dir):
    rows = fitting(spark, sf_dir, FitQuery(**CAVITY))
    return fc.range_filter(rows, {"w": (500, 680), "h": (900, None), "price": (None, 1000), "stars": (2, 5)}, score_min=40, verified_only=True).select("id", "fit_score_numeric")


def url_predicates(spark, sf_dir):
    u = F.col("url")
    rows = adapters.offers(spark, sf_dir).withColumns({"lenient": is_product_url_lenient(u), "strict": is_product_url_strict(u), "audit": is_product_url_audit(u)})
    return rows.groupBy("lenient", "strict", "audit").agg(F.count("*").alias("n"))


def replacement_sources(spark, sf_dir):
    p = adapters.products(spark, sf_dir)
    asked = p.select(F.col("ord").alias("ask"), F.concat("display_name", F.lit(" "), F.col("ord").cast("string")).alias("text"))
    return best_sources(asked, p)


def replacement_suggestions(spark, sf_dir):
    return suggestions(catalog(spark, sf_dir), "fridge").select("rank", "id", "n_strict")


QUERIES = [fit_search, fit_search_manufacturer, fit_search_replacement, fit_gaps, fit_tiers, fit_breakdown, fit_modes_monotone, deduction_scores, near_misses, awkward_spaces, width_verdicts, delivery_paths, facet_search, facet_counts, *(_sorted(n, o) for n, o in SORTS.items()), range_sliders, url_predicates, replacement_sources, replacement_suggestions]

_C = fit_sql(700, 1900, 700, "fridge")
_ALL = fit_sql(700, 1900, 700)
_PCT = "floor(least(1e0, (CAST(greatest(0, gap_{a}) AS DOUBLE) / {v}e0) / 0.2e0) * 100 + 0.5e0)"
_P = {a: _PCT.format(a=a, v=v) for a, v in CAVITY.items()}
_PEN = "CASE WHEN tightest_gap_mm < 5 THEN 15 WHEN tightest_gap_mm < 10 THEN 5 ELSE 0 END"
_LOST = " + ".join(f"CASE WHEN {v} - {a} >= 0 AND {v} - {a} < {n} THEN least({m}, floor((CAST({n} - ({v} - {a}) AS DOUBLE) / {n}e0) * {m} + 0.5e0)) ELSE 0 END" for a, v, n, m in (("w", 700, 40, 40), ("h", 1900, 50, 30), ("d", 700, 50, 30)))
_WARN = " + ".join(f"CASE WHEN {v} - {a} >= 0 AND {v} - {a} < {n} THEN 1 ELSE 0 END" for a, v, n in (("w", 700, 40), ("h", 1900, 50), ("d", 700, 50)))
_NEED = {"w": "greatest(0, w + 10 - 700)", "h": "greatest(0, h + 20 - 1900)", "d": "greatest(0, d + 10 - 700)"}
_MOST = f"greatest({', '.join(_NEED.values())})"
_RANKED = "CAST(row_number() OVER (ORDER BY {o}) AS INTEGER) AS rank"

ORACLE = {
    "fit_search": f"SELECT {_RANKED.format(o=ORDER)}, {SQL_BASE} FROM {_C} ORDER BY rank LIMIT 60",
    "fit_search_manufacturer": f"SELECT {SQL_BASE}, required_w, required_h, required_d FROM {fit_sql(700, 1900, 700, 'dryer', 'manufacturer')}",
    "fit_search_replacement": f"SELECT id, fit_score_numeric, required_w, required_h, required_d, size_gap_w, size_gap_h, size_gap_d FROM {fit_sql(650, 1000, 650, 'washing_machine', 'practical', True)}",
    "fit_gaps": f"SELECT id, gap_w, gap_h, gap_d, size_gap_w, size_gap_h, size_gap_d, TRUE AS exact_fit, gap_w / 700e0 < 0.02e0 OR gap_h / 1900e0 < 0.02e0 OR gap_d / 700e0 < 0.02e0 AS fits_tightly FROM {_ALL}",
    "fit_tiers": f"""SELECT cat, tier, count(*) AS n, CASE tier WHEN 'excellent' THEN 'Excellent fit' WHEN 'strong' THEN 'Strong fit' WHEN 'workable' THEN 'Workable fit' WHEN 'tight' THEN 'Tight fit' WHEN 'marginal' THEN 'Marginal fit' ELSE 'Won''t fit' END AS label
        FROM (SELECT cat, CASE WHEN fit_score_numeric >= 90 THEN 'excellent' WHEN fit_score_numeric >= 75 THEN 'strong' WHEN fit_score_numeric >= 60 THEN 'workable' WHEN fit_score_numeric >= 40 THEN 'tight' WHEN fit_score_numeric >= 1 THEN 'marginal' ELSE 'no-fit' END AS tier FROM {_ALL}) GROUP BY cat, tier""",
    "fit_breakdown": f"SELECT id, CAST({_P['w']} AS INTEGER) AS percent_w, CAST({_P['h']} AS INTEGER) AS percent_h, CAST({_P['d']} AS INTEGER) AS percent_d, {_PEN} AS penalty_percent, CAST(floor((0e0 + {_P['w']} * 0.4e0 + {_P['h']} * 0.3e0 + {_P['d']} * 0.3e0) * (100 - {_PEN}) / 100 + 0.5e0) AS INTEGER) AS breakdown_total FROM {_C}",
    "fit_modes_monotone": f"SELECT cat, count(*) AS n, 'physical' AS mode FROM {fit_sql(700, 1900, 700, None, 'physical')} GROUP BY cat UNION ALL SELECT cat, count(*), 'practical' FROM {_ALL} GROUP BY cat",
    "deduction_scores": f"SELECT id, CAST(CASE WHEN w > 700 OR h > 1900 OR d > 700 THEN 0 ELSE greatest(0, 100 - ({_LOST})) END AS INTEGER) AS deduction_score, CAST(CASE WHEN w > 700 OR h > 1900 OR d > 700 THEN 1 ELSE {_WARN} END AS INTEGER) AS n_warnings FROM products",
    "near_misses": f"SELECT id, CAST({_MOST} AS INTEGER) AS needed_mm, CASE WHEN {_NEED['w']} = {_MOST} THEN 'width' WHEN {_NEED['h']} = {_MOST} THEN 'height' ELSE 'depth' END AS needed_axis FROM {fit_sql(700, 1900, 700, 'fridge', 'physical')} WHERE {_MOST} > 0 ORDER BY {_MOST}, {ORDER} LIMIT 10",
    "awkward_spaces": """SELECT flag, count(*) AS n, min(id) AS least_id FROM (SELECT id, 'shallow-depth' AS flag FROM products WHERE d <= 550 UNION ALL SELECT id, 'low-cavity' FROM products WHERE h <= 1700
        UNION ALL SELECT id, 'apartment-ok' FROM products WHERE cat = 'dryer' AND regexp_matches(lower(type), 'heat\\s*pump') UNION ALL SELECT id, 'narrow-doorway' FROM products WHERE least(w, d) <= 600) GROUP BY flag""",
    "width_verdicts": "SELECT cat, CASE WHEN gap >= 20 THEN 'perfect' WHEN gap >= 5 THEN 'tight' WHEN gap >= 0 THEN 'binding' ELSE 'no-fit' END AS verdict, count(*) AS n, CAST(min(gap) AS INTEGER) AS least_gap FROM (SELECT cat, 700 - (w + 10) AS gap FROM products) GROUP BY ALL",
    "delivery_paths": "SELECT id, least(w, d) + 50 AS doorway_mm, greatest(w, d) AS turning_mm, w + 10 AS cavity_w, h + 20 AS cavity_h, d + 10 AS cavity_d FROM products",
    "facet_search": f"SELECT {_RANKED.format(o=SORT_SQL['sort_price_asc'])}, id, price, stars FROM {_ALL} WHERE current AND lower(brand) IN ('brand#2', 'brand#17', 'brand#4') AND coalesce(price, 0) <= 950 AND stars >= 2 ORDER BY rank LIMIT 100",
    "facet_counts": f"""SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM {_ALL} WHERE current GROUP BY brand UNION ALL SELECT 'stars', CAST(stars AS VARCHAR), count(*) FROM {_ALL} WHERE current GROUP BY stars
        UNION ALL SELECT 'available', 'current', count(*) FROM {_ALL} WHERE current HAVING count(*) > 0 UNION ALL SELECT 'priced', 'priced', count(*) FROM {_ALL} WHERE current HAVING count(*) > 0""",
    **{n: f"SELECT {_RANKED.format(o=o)}, id FROM {_C} ORDER BY rank LIMIT 40" for n, o in SORT_SQL.items()},
    "range_sliders": f"SELECT id, fit_score_numeric FROM {_ALL} f WHERE w BETWEEN 500 AND 680 AND h >= 900 AND price <= 1000 AND stars BETWEEN 2 AND 5 AND fit_score_numeric >= 40 AND (verified OR NOT (SELECT bool_or(verified) FROM {_ALL}))",
    "url_predicates": f"SELECT {PRODUCT_URL.format(u='url', other='TRUE')} AS lenient, {PRODUCT_URL.format(u='url', other='FALSE')} AS strict, {PRODUCT_URL.format(u='url', other='FALSE')} AS audit, count(*) AS n FROM offers GROUP BY ALL",
    "replacement_sources": r"""SELECT ask, id, CAST(score AS INTEGER) AS score, CASE WHEN score >= 90 THEN 'high' WHEN score >= 75 THEN 'medium' ELSE 'low' END AS confidence FROM (
        SELECT a_ord AS ask, id, s AS score, row_number() OVER (PARTITION BY a_ord ORDER BY s DESC, display_name, p_ord) AS i FROM (
            SELECT a.ord AS a_ord, p.ord AS p_ord, p.id, p.display_name, CASE WHEN pc <> '' AND pc = qc THEN 98 WHEN length(qc) >= 5 AND starts_with(pc, qc) THEN 96 WHEN length(qc) >= 5 AND starts_with(pm, qc) THEN 94
                WHEN pm = q THEN 100 WHEN contains(q, pm) THEN 95 WHEN contains(pm, q) THEN 90 WHEN contains(bm, t) THEN 84 WHEN contains(dn, t) THEN 78 ELSE 0 END AS s
            FROM (SELECT ord, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS q, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t,
                    coalesce(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))[1], '') AS qc
                  FROM (SELECT ord, display_name || ' ' || ord AS text FROM products)) a
            CROSS JOIN (SELECT ord, id, display_name, regexp_replace(lower(model), '[^a-z0-9]+', '', 'g') AS pm, trim(regexp_replace(lower(brand || ' ' || model), '[^a-z0-9]+', ' ', 'g')) AS bm, trim(regexp_replace(lower(display_name), '[^a-z0-9]+', ' ', 'g')) AS dn,
                    coalesce(list_filter(string_split(trim(regexp_replace(lower(model), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 4 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))[1], '') AS pc FROM products) p) WHERE s > 0) WHERE i = 1""",
    "replacement_suggestions": f"SELECT {_RANKED.format(o='n_strict DESC, priority DESC, display_name, ord')}, id, n_strict FROM catalog WHERE cat = 'fridge' AND verified ORDER BY rank LIMIT 160",
}


def oracle() -> dict[str, str]:
    return {n: with_tables(q) for n, q in ORACLE.items()}
