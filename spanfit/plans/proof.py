"""Queries of evidence, documents, affiliate links and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfit.operators import evidence as e
from spanfit.operators.fit import FitQuery, resolve_clearance, with_fit
from spanfit.plans.oracle import with_tables
from spanfit.plans.pages import _PAIRS, comparison_pairs
from spanfit.plans.search import catalog
from spanfit.sources import adapters

AS_OF = "2001-01-01"


def _manifest(spark, sf_dir):
    k = F.col("ord")
    status = lambda n: F.element_at(F.array(F.lit("approved"), F.lit("invalid"), F.lit("pending")), (F.floor(k / n) % 3 + 1).cast("int"))
    item = lambda n: F.struct(status(n).alias("status"), F.when(k % (n + 3) != 0, F.concat(F.lit(f"/e{n}/"), "id")).otherwise("").alias("url"))
    return adapters.products(spark, sf_dir).select(F.col("id").alias("product_id"), F.array(item(2), item(6), item(18)).alias("items"))


def evidence_index(spark, sf_dir):
    return e.evidence_index(_manifest(spark, sf_dir))


def work_queue(spark, sf_dir):
    return e.work_queue(adapters.products(spark, sf_dir), e.evidence_index(_manifest(spark, sf_dir)), ("BRAND#1", "Brand#2")).select("id")


def failure_buckets(spark, sf_dir):
    p = adapters.products(spark, sf_dir)
    reason = F.element_at(F.array(*map(F.lit, ("HTTP 404", "Model mismatch", "clearance not found", "timeout"))), (F.floor(F.col("ord") / 3) % 4 + 1).cast("int"))
    rows = p.select(F.when(F.col("ord") % 2 == 0, F.col("id")).alias("id"), F.upper("model").alias("sku"), reason.alias("reason"))
    return e.failures(rows, e.evidence_index(_manifest(spark, sf_dir)), p)


def _documents(spark, sf_dir):
    p, o = adapters.products(spark, sf_dir), adapters.offers(spark, sf_dir)
    end = F.element_at(F.array(*map(F.lit, ("/Data-Sheet.pdf", "/install.pdf", "/warranty.pdf", "/page"))), (F.col("pos") % 4 + 1).cast("int"))
    official = F.array(F.when(F.col("ord") % 2 == 0, "jbhifi.com.au").otherwise("harveynorman.com.au"))
    return o.join(p.select("id", "model", "ord"), F.col("id") == F.col("product_id")).select("id", "model", "pos", official.alias("official"), F.concat(F.regexp_replace("url", "[?].*$", ""), F.when(F.col("pos") % 3 == 0, F.regexp_replace("model", " ", "-")).otherwise(""), end).alias("url"))


def best_document(spark, sf_dir):
    return e.best_document(_documents(spark, sf_dir))


def affiliate_links(spark, sf_dir):
    rows = adapters.products(spark, sf_dir)
    return rows.select("id", e.affiliate_url(["https://a.example/{price}/{id}", "https://b.example/?m={model}"], {"price": F.col("price").cast("string"), "id": F.col("id"), "model": F.when(F.col("ord") % 10 != 0, F.col("id"))}).alias("link"))


def freshness(spark, sf_dir):
    rows = adapters.offers(spark, sf_dir).groupBy("product_id").agg(F.max("verified_at").alias("checked"), F.count("*").alias("found"))
    return rows.select("product_id", e.stale_days(F.col("checked"), AS_OF).alias("days"), e.research_confidence(F.col("found"), F.lit(4)).alias("confidence"))


def _tray(spark, sf_dir):
    rows = with_fit(resolve_clearance(catalog(spark, sf_dir), "practical"), FitQuery(w=700))
    return rows.select("id", F.floor(F.col("ord") / 4).alias("grp"), (F.col("ord") % 4).alias("place"), F.col("fit_score_numeric").alias("score"), F.col("gap_w").alias("gap"), "price", "retailers")


def compare_insights(spark, sf_dir):
    return e.compare_insights(_tray(spark, sf_dir))


def compare_summary(spark, sf_dir):
    return e.compare_summary(_tray(spark, sf_dir))


def footprint_verdicts(spark, sf_dir):
    r = adapters.rules(spark, sf_dir)
    a, b = (r.select("cat", *(F.col(c).alias(f"{c}_{s}") for c in ("brand", "side", "rear", "top"))) for s in "ab")
    return e.footprint_verdict(comparison_pairs(spark, sf_dir).join(a, ["cat", "brand_a"]).join(b, ["cat", "brand_b"])).select("cat", "brand_a", "brand_b", "room_a", "room_b", "verdict")


QUERIES = [evidence_index, work_queue, failure_buckets, best_document, affiliate_links, freshness, compare_insights, compare_summary, footprint_verdicts]

_S = "['approved', 'invalid', 'pending'][ord // {n} % 3 + 1]"
_U = "CASE WHEN ord % ({n} + 3) <> 0 THEN '/e{n}/' || id ELSE '' END"
_ITEMS = "[" + ", ".join(f"{{{{'s': {_S.format(n=n)}, 'u': {_U.format(n=n)}}}}}".replace("{{", "{").replace("}}", "}") for n in (2, 6, 18)) + "]"
_INDEX = f"""(SELECT id AS product_id, e.u AS url, e.s = 'approved' AS verified FROM (SELECT id, coalesce(list_filter(i, lambda x: x.s = 'approved')[1], list_filter(i, lambda x: x.s <> 'invalid')[1], i[1]) AS e
    FROM (SELECT id, {_ITEMS} AS i FROM products)) WHERE e.u <> '')"""
_SQ = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_DOC = "(SELECT p.id, p.ord, p.model, o.pos, regexp_replace(o.url, '[?].*$', '') || CASE WHEN pos % 3 = 0 THEN replace(model, ' ', '-') ELSE '' END || ['/Data-Sheet.pdf', '/install.pdf', '/warranty.pdf', '/page'][pos % 4 + 1] AS url FROM offers o JOIN products p ON p.id = o.product_id)"
_SCORE = f"""CAST(CASE WHEN contains({_SQ.format('url')}, {_SQ.format('model')}) THEN 60 ELSE 0 END + CASE WHEN regexp_matches(url, CASE WHEN ord % 2 = 0 THEN '^https?://([^/]*\\.)?jbhifi\\.com\\.au/' ELSE '^https?://([^/]*\\.)?harveynorman\\.com\\.au/' END) THEN 35 ELSE 0 END
    + CASE WHEN regexp_matches(url, '(?i)spec|data.?sheet|fact.?sheet') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)install|manual|quick.?reference|qrg') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)warranty|energy|label|catalog|brochure') THEN -20 ELSE 0 END AS INTEGER)"""
_TRAY = "(SELECT id, ord // 4 AS grp, ord % 4 AS place, 690 - w AS gap, price, n_offers, CASE WHEN 690 - w < 0 THEN 0 ELSE floor(least(1e0, ((690 - w) / 700e0) / 0.2e0) * 0.4e0 * 100e0 * CASE WHEN 690 - w < 5 THEN 0.85e0 WHEN 690 - w < 10 THEN 0.95e0 ELSE 1e0 END + 0.5e0) END AS score FROM catalog)"

ORACLE = {
    "evidence_index": f"SELECT product_id, url, verified FROM {_INDEX}",
    "work_queue": f"SELECT id FROM products WHERE lower(brand) IN ('brand#1', 'brand#2') AND id NOT IN (SELECT product_id FROM {_INDEX} WHERE verified)",
    "failure_buckets": f"""SELECT ['A', 'C', 'B', 'D'][ord // 3 % 4 + 1] AS bucket, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT product_id FROM {_INDEX})) AS resolved FROM products GROUP BY 1""",
    "best_document": f"SELECT id, url, score FROM (SELECT id, url, {_SCORE} AS score, row_number() OVER (PARTITION BY id ORDER BY {_SCORE} DESC, pos) AS k FROM {_DOC}) WHERE k = 1",
    "affiliate_links": "SELECT id, CASE WHEN price IS NOT NULL THEN 'https://a.example/' || CAST(price AS VARCHAR) || '/' || id WHEN ord % 10 <> 0 THEN 'https://b.example/?m=' || id END AS link FROM products",
    "freshness": f"SELECT product_id, CAST(DATE '{AS_OF}' - max(verified_at) AS INTEGER) AS days, CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM offers GROUP BY product_id",
    "compare_insights": f"SELECT grp, arg_min(id, {{'a': -score, 'b': place}}) AS best_fit, arg_min(id, {{'a': -n_offers, 'b': place}}) AS most_retailers, arg_min(id, {{'a': CASE WHEN price > 0 THEN price ELSE 2147483647 END, 'b': place}}) AS lowest_price FROM {_TRAY} GROUP BY grp",
    "compare_summary": f"SELECT grp, count(*) FILTER (WHERE gap BETWEEN 0 AND 9) AS tight, count(*) FILTER (WHERE gap < 0) AS blocked, count(price) AS priced, CAST(sum(n_offers) AS BIGINT) AS links FROM {_TRAY} GROUP BY grp",
    "footprint_verdicts": f"""SELECT x.cat, brand_a, brand_b, CAST(2 * a.side + a.rear + a.top AS INTEGER) AS room_a, CAST(2 * b.side + b.rear + b.top AS INTEGER) AS room_b, CASE WHEN 2 * a.side + a.rear + a.top < 2 * b.side + b.rear + b.top THEN brand_a || ' needs less room'
        WHEN 2 * a.side + a.rear + a.top > 2 * b.side + b.rear + b.top THEN brand_b || ' needs less room' ELSE 'equal' END AS verdict FROM {_PAIRS} x JOIN rules a ON a.cat = x.cat AND a.brand = brand_a JOIN rules b ON b.cat = x.cat AND b.brand = brand_b""",
}


def oracle() -> dict[str, str]:
    return {n: with_tables(q) for n, q in ORACLE.items()}
