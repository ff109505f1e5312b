"""Queries of catalog building, validation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfit.operators import quality as q
from spanfit.operators import resolve as r
from spanfit.plans.oracle import with_tables
from spanfit.plans.search import catalog
from spanfit.sources import adapters

AS_OF = "2001-01-01"
TIERS = {"dropped": ("Brand#9",), "tier1": ("Brand#1", "Brand#2", "Brand#3"), "tier2": ("Brand#4", "Brand#5"), "tier3": ("Brand#6",)}


def _p(spark, sf_dir):
    return adapters.products(spark, sf_dir)


def _scraped(spark, sf_dir):
    """Every product, some under a changed model: a letter more, or another first one."""
    m = F.col("model")
    changed = F.when(F.col("ord") % 9 == 0, F.concat(m, F.lit("x"))).when(F.col("ord") % 9 == 3, F.concat(F.lit("z"), F.expr("substring(model, 2)"))).otherwise(m)
    return _p(spark, sf_dir).select(F.col("ord").alias("item"), "brand", changed.alias("model"), (F.col("w") + F.col("ord") % 8).alias("w"), "h", "d")


def _evidence(spark, sf_dir):
    k = F.col("ord")
    rows = _p(spark, sf_dir)
    model = F.when(k % 40 == 5, F.concat(F.lit("new "), "model")).when(k % 10 == 3, F.concat(F.lit("Shared-"), F.floor(k / 30).cast("string"))).otherwise(F.col("model"))
    named = F.when(k % 8 == 1, F.col("id")).when(k % 8 == 5, F.concat(F.lit("x"), F.floor(k / 20).cast("string"))).when(k % 16 == 4, F.concat(F.lit("p"), (k + 1).cast("string")))
    return rows.select(k.alias("evidence_id"), named.alias("product_id"), model.alias("model"), F.concat(F.lit("sku"), F.when(k % 10 == 3, k + 7).otherwise(k % 100).cast("string")).alias("sku"), F.when(k % 6 == 0, F.concat(F.lit("P-"), (k + 2).cast("string"))).alias("extracted_model"), *((F.col(a) + 1).alias(a) for a in "whd"))


def upsert_sources(spark, sf_dir):
    p = _p(spark, sf_dir).select("id", "brand", "w", "price", "unavailable", "ord")
    first = p.where("ord % 2 = 0").select("id", F.col("brand"), (F.col("w") + 1).alias("w"), F.lit(None).cast("int").alias("price"), F.when(F.col("ord") % 4 == 0, F.lit(False)).alias("unavailable"))
    second = p.where("ord % 3 = 0").select(F.when(F.col("ord") % 6 == 0, F.concat("id", F.lit("n"))).otherwise(F.col("id")).alias("id"), F.lit(None).cast("string").alias("brand"), F.lit(None).cast("int").alias("w"), F.lit(7).alias("price"))
    return r.upsert(p.where("ord % 5 <> 0").drop("ord"), [first, second])


def upsert_by_key(spark, sf_dir):
    p = _p(spark, sf_dir).select("ord", "id", "brand", "model", "stars")
    new = p.where("ord % 3 = 0").select("ord", F.when(F.col("ord") % 2 == 0, F.concat("id", F.lit("e"))).otherwise(F.col("id")).alias("id"), F.upper("brand").alias("brand"), "model", F.when(F.col("ord") % 5 != 0, F.lit(9)).alias("stars"))
    return r.upsert_by_key(p.where("ord % 7 <> 0"), new).select("id", "brand", "stars")


def feed_match(spark, sf_dir):
    p = _p(spark, sf_dir)
    feed = p.select(F.col("ord").alias("item"), F.concat(F.lit("New "), "brand", F.lit(" "), "model", F.lit(" now")).alias("name"), F.when(F.col("ord") % 40 == 7, F.col("brand")).alias("brand"), F.when(F.col("ord") % 40 == 7, F.col("model")).alias("model"))
    return r.feed_match(feed, p)


def fuzzy_match(spark, sf_dir):
    return r.fuzzy_match(_scraped(spark, sf_dir), _p(spark, sf_dir))


def prefix_match(spark, sf_dir):
    return r.prefix_match(_scraped(spark, sf_dir), _p(spark, sf_dir))


def offer_upsert(spark, sf_dir):
    o = adapters.offers(spark, sf_dir)
    new = o.where("pos % 5 = 0").select("product_id", "pos", F.upper("n").alias("n"), F.lit(None).cast("string").alias("url"), (F.col("p") + 1).alias("p"))
    return r.upsert_offers(o, new)


def evidence_match(spark, sf_dir):
    return r.match_evidence(_evidence(spark, sf_dir), _p(spark, sf_dir))


def evidence_overlay(spark, sf_dir):
    e, p = _evidence(spark, sf_dir), _p(spark, sf_dir)
    rows = r.overlay_evidence(p, r.match_evidence(e, p), e)
    return rows.groupBy("cat", "verified").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum("h").alias("h"))


def evidence_new(spark, sf_dir):
    e, p = _evidence(spark, sf_dir), _p(spark, sf_dir)
    return r.new_from_evidence(e, r.match_evidence(e, p), p)


def manual_retailers(spark, sf_dir):
    rows = r.set_retailers(_p(spark, sf_dir), adapters.offers(spark, sf_dir).where("p > 1000"), ("Bing Lee",))
    return rows.select("id", "n_approved", "unavailable")


def research_lookup(spark, sf_dir):
    p = _p(spark, sf_dir)
    research = p.where("ord % 3 = 0").select(F.when(F.col("ord") % 2 == 0, F.col("id")).otherwise(F.col("model")).alias("key"), F.col("ord").alias("value"))
    return r.lookup(p, research).select("id", "value")


def _aliases(spark, sf_dir):
    return _p(spark, sf_dir).select("brand").distinct().where("brand like '%1%'").select(F.upper("brand").alias("alias"), F.concat(F.lit("Brand#"), F.length("brand").cast("string")).alias("canonical"))


def brand_alias(spark, sf_dir):
    dropped = _p(spark, sf_dir).select("brand").distinct().where("brand like '%9'")
    return r.canonical_brands(_p(spark, sf_dir), _aliases(spark, sf_dir), dropped).groupBy("brand").agg(F.count("*").alias("n"))


def rule_canon(spark, sf_dir):
    return r.canonical_rules(adapters.rules(spark, sf_dir), _aliases(spark, sf_dir))


def missing_rules(spark, sf_dir):
    return r.missing_rules(_p(spark, sf_dir), adapters.rules(spark, sf_dir))


def first_per_name(spark, sf_dir):
    return r.first_per_key(_p(spark, sf_dir), F.lower("display_name")).select("id", "display_name")


def discovery_delta(spark, sf_dir):
    p = _p(spark, sf_dir)
    found = p.withColumn("model", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("N"), F.floor(F.col("ord") / 12).cast("string"))).otherwise(F.col("model")))
    return r.discovery_delta(found, p).select("id", "model")


def batch_targets(spark, sf_dir):
    p = _p(spark, sf_dir)
    return r.batch_targets(p, p.where("ord % 100 = 0").select(F.col("model").alias("sku"))).select("id")


def circuit_breaker(spark, sf_dir):
    p = _p(spark, sf_dir)
    bad = F.size(q.field_errors(p.columns)) > 0
    cases = [("all", p, p), ("lost", p.where("ord % 10 < 7"), p), ("odd", p.withColumn("w", F.when(F.col("ord") % 2 == 0, 1).otherwise(F.col("w"))), p), ("mutated", p.drop("model"), p)]
    out = [r.breaker(n, o, bad if c != "mutated" else F.lit(False), ("id", "cat", "brand", "model")).withColumn("run", F.lit(c)) for c, n, o in cases]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def issue_triage(spark, sf_dir):
    rows = adapters.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % 50).alias("key"), F.col("o_orderkey").alias("number"), F.col("o_orderdate").alias("created"))
    return r.triage(rows, 200)


def issue_actions(spark, sf_dir):
    from spanfit.operators.telemetry import error_signatures

    s = error_signatures(adapters.errors(spark, sf_dir)).select("signature", "n")
    head = F.conv(F.substring("signature", 1, 4), 16, 10).cast("int")
    issues = s.where(head % 3 > 0).select("signature", F.when(head % 3 == 1, "open").otherwise("closed").alias("state"), F.date_sub(F.lit(AS_OF).cast("date"), (head % 15).cast("int")).alias("closed_on"))
    return r.issue_actions(s, issues, AS_OF).groupBy("action").agg(F.count("*").alias("signatures"), F.sum("n").alias("events"))


def priority_scores(spark, sf_dir):
    tier = q.brand_tier(F.col("brand"), TIERS)
    checked = F.array_max(F.transform("retailers", lambda x: x["verified_at"]))
    rows = catalog(spark, sf_dir).withColumns({"tier": tier, "checked": checked})
    return rows.select("id", "tier", q.priority_score(F.col("tier"), F.col("checked"), AS_OF).alias("score"))


def series_prefix(spark, sf_dir):
    p = _p(spark, sf_dir)
    series = p.where("ord < 60").select("brand", F.expr("substring(model, 1, cast(2 + ord % 3 as int))").alias("prefix")).distinct().withColumn("series", F.concat(F.lit("S-"), "prefix"))
    return q.longest_prefix(p.withColumn("token", F.col("model")), series)


def door_swing(spark, sf_dir):
    k = F.col("ord")
    rows = _p(spark, sf_dir).withColumns({"features": F.array(F.element_at(F.array(*map(F.lit, ("Upright", "Chest", "Top Mount", "Bar"))), (F.floor(k / 4) % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("1", "7", "5B"))), (F.floor(k / 16) % 3 + 1).cast("int"))), "top_loader": F.when(k % 3 != 0, k % 3 == 1), "door_swing_mm": F.when(k % 11 == 0, F.lit(50))})
    return q.infer_door_swing(rows).select("id", "door_swing_mm", "inferred")


def prices(spark, sf_dir):
    rows = q.available_by_price(catalog(spark, sf_dir).withColumn("price", F.when(F.col("ord") % 2 == 0, F.col("price"))))
    return rows.select("id", "unavailable", q.best_price().alias("any_price"), q.best_price(own=True).alias("own_price"))


def field_errors(spark, sf_dir):
    k = F.col("ord")
    rows = _p(spark, sf_dir).withColumns({"w": F.when(k % 10 == 0, None).otherwise(F.col("w")), "h": F.when(k % 6 == 0, 2600).otherwise(F.col("h")), "price": F.when(k % 14 == 0, 0).otherwise(F.col("price")), "brand": F.when(k % 50 == 1, " ").otherwise(F.col("brand")), "door_swing_mm": (k % 7 * 60).cast("int")})
    return rows.select("id", F.explode(q.field_errors(rows.columns)).alias("field"))


def plausibility(spark, sf_dir):
    p = _p(spark, sf_dir)
    ranges = p.select("cat").distinct().select("cat", F.explode(F.array(F.struct(F.lit("w").alias("axis"), F.lit(500).alias("low"), F.lit(900).alias("high")), F.struct(F.lit("h").alias("axis"), F.lit(850).alias("low"), F.lit(1900).alias("high")), F.struct(F.lit("d").alias("axis"), F.lit(520).alias("low"), F.lit(780).alias("high")))).alias("x")).select("cat", "x.*")
    return q.plausible(p, ranges).select("id", F.array_join("odd", ",").alias("odd")).where("odd <> ''")


def accuracy_audit(spark, sf_dir):
    rows = q.audited(catalog(spark, sf_dir), AS_OF)
    return rows.select("grade", F.explode(F.when(F.size("issues") > 0, F.col("issues")).otherwise(F.array(F.lit("none")))).alias("issue")).groupBy("grade", "issue").agg(F.count("*").alias("n"))


def coverage(spark, sf_dir):
    return q.coverage(_p(spark, sf_dir), F.col("price").isNull())


def category_summary(spark, sf_dir):
    return q.category_summary(_p(spark, sf_dir), (*adapters.CATEGORIES, "washtower_combo"))


def brand_casing(spark, sf_dir):
    rows = _p(spark, sf_dir).withColumn("brand", F.when(F.col("ord") % 7 == 0, F.upper("brand")).otherwise(F.col("brand")))
    return q.casing_groups(rows)


def brand_options(spark, sf_dir):
    rows = _p(spark, sf_dir).withColumn("brand", F.when(F.col("ord") % 7 == 0, F.upper("brand")).otherwise(F.col("brand")))
    return q.brand_options(rows)


def metric_winners(spark, sf_dir):
    rows = _p(spark, sf_dir).withColumn("grp", F.floor(F.col("ord") / 4))
    return q.metric_winners(rows, {"price": False, "stars": True, "w": False})


QUERIES = [upsert_sources, upsert_by_key, feed_match, fuzzy_match, prefix_match, offer_upsert, evidence_match, evidence_overlay, evidence_new, manual_retailers, research_lookup, brand_alias, rule_canon, missing_rules, first_per_name, discovery_delta, batch_targets, circuit_breaker, issue_triage, issue_actions, priority_scores, series_prefix, door_swing, prices, field_errors, plausibility, accuracy_audit, coverage, category_summary, brand_casing, brand_options, metric_winners]

_SQ = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_SCRAPED = "(SELECT ord AS item, brand, CASE WHEN ord % 9 = 0 THEN model || 'x' WHEN ord % 9 = 3 THEN 'z' || substr(model, 2) ELSE model END AS model, CAST(w + ord % 8 AS BIGINT) AS w, h, d FROM products)"
_EV = """(SELECT ord AS evidence_id, CASE WHEN ord % 8 = 1 THEN id WHEN ord % 8 = 5 THEN 'x' || ord // 20 WHEN ord % 16 = 4 THEN 'p' || (ord + 1) END AS product_id, CASE WHEN ord % 40 = 5 THEN 'new ' || model WHEN ord % 10 = 3 THEN 'Shared-' || ord // 30 ELSE model END AS model,
    'sku' || CASE WHEN ord % 10 = 3 THEN ord + 7 ELSE ord % 100 END AS sku, CASE WHEN ord % 6 = 0 THEN 'P-' || (ord + 2) END AS extracted_model, w + 1 AS w, h + 1 AS h, d + 1 AS d FROM products)"""
_FIRST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY evidence_id) AS nth FROM {_EV}) WHERE nth = 1 OR product_id IS NULL)"


def _matched(rounds: int = 6) -> str:
    """Claims on tokens settle round by round; six are enough for these rows."""
    steps = [f"first AS MATERIALIZED {_FIRST}", f"claims AS MATERIALIZED (SELECT evidence_id, min(pos) AS pos, token FROM (SELECT evidence_id, 0 AS pos, {_SQ.format('model')} AS token FROM first UNION ALL SELECT evidence_id, 1, {_SQ.format('sku')} FROM first UNION ALL SELECT evidence_id, 2, {_SQ.format('extracted_model')} FROM first) WHERE token <> '' GROUP BY ALL)", "live0 AS MATERIALIZED (SELECT * FROM claims)"]
    for r in range(rounds):
        steps.append(f"stops{r} AS MATERIALIZED (SELECT evidence_id, min(pos) AS stop FROM (SELECT * FROM live{r} QUALIFY row_number() OVER (PARTITION BY token ORDER BY evidence_id) = 2) GROUP BY 1)")
        steps.append(f"live{r + 1} AS MATERIALIZED (SELECT claims.* FROM claims LEFT JOIN stops{r} USING (evidence_id) WHERE stop IS NULL OR pos <= stop)")
    steps.append(f"keys AS MATERIALIZED (SELECT token, min(evidence_id) AS evidence_id FROM live{rounds} GROUP BY 1 HAVING count(*) = 1)")
    steps.append(f"""taken AS (SELECT id, ord, arg_min(evidence_id, way) AS evidence_id, min(way) AS way FROM (SELECT p.id, p.ord, evidence_id, -1 AS way FROM products p JOIN first ON product_id = p.id UNION ALL SELECT p.id, p.ord, evidence_id, 0 FROM products p JOIN keys ON token = {_SQ.format('p.model')}
        UNION ALL SELECT p.id, p.ord, evidence_id, 1 FROM products p JOIN keys ON token = p.id) GROUP BY 1, 2)""")
    return f"""(WITH {', '.join(steps)} SELECT evidence_id, id, CASE WHEN way < 0 THEN 'id' ELSE 'token' END AS "by" FROM taken QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ord) = 1)"""


_MATCH = _matched()
_ALIAS = "(SELECT DISTINCT upper(brand) AS alias, 'Brand#' || CAST(length(brand) AS VARCHAR) AS canonical FROM products WHERE brand LIKE '%1%')"
_TIER = "CASE WHEN brand = 'Brand#9' THEN 'dropped' WHEN brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'tier1' WHEN brand IN ('Brand#4', 'Brand#5') THEN 'tier2' WHEN brand = 'Brand#6' THEN 'tier3' ELSE 'unknown' END"
_ERR = "(SELECT ord, id, CASE WHEN ord % 10 = 0 THEN NULL ELSE w END AS w, CASE WHEN ord % 6 = 0 THEN 2600 ELSE h END AS h, CASE WHEN ord % 14 = 0 THEN 0 ELSE price END AS price, CASE WHEN ord % 50 = 1 THEN ' ' ELSE brand END AS brand, ord % 7 * 60 AS swing FROM products)"
_CASED = "(SELECT ord, CASE WHEN ord % 7 = 0 THEN upper(brand) ELSE brand END AS brand FROM products)"

ORACLE = {
    "upsert_sources": """SELECT id, arg_max(brand, nth_) FILTER (WHERE brand IS NOT NULL) AS brand, arg_max(w, nth_) FILTER (WHERE w IS NOT NULL) AS w, arg_max(price, nth_) FILTER (WHERE price IS NOT NULL) AS price,
        coalesce(arg_max(unavailable, nth_) FILTER (WHERE unavailable IS NOT NULL), TRUE) AS unavailable FROM (SELECT id, brand, w, price, unavailable, 0 AS nth_ FROM products WHERE ord % 5 <> 0
        UNION ALL SELECT id, brand, w + 1, NULL, CASE WHEN ord % 4 = 0 THEN FALSE END, 1 FROM products WHERE ord % 2 = 0 UNION ALL SELECT CASE WHEN ord % 6 = 0 THEN id || 'n' ELSE id END, NULL, NULL, 7, NULL, 2 FROM products WHERE ord % 3 = 0) GROUP BY id""",
    "upsert_by_key": f"""SELECT id, arg_max(brand, nth_) AS brand, arg_max(stars, nth_) FILTER (WHERE stars IS NOT NULL) AS stars FROM (SELECT id, brand, stars, -1 AS nth_ FROM products WHERE ord % 7 <> 0 UNION ALL
        SELECT coalesce(k.id, x.id), x.brand, x.stars, x.ord FROM (SELECT ord, CASE WHEN ord % 2 = 0 THEN id || 'e' ELSE id END AS id, upper(brand) AS brand, model, CASE WHEN ord % 5 <> 0 THEN 9 END AS stars FROM products WHERE ord % 3 = 0) x
        LEFT JOIN products k ON k.ord % 7 <> 0 AND k.ord = x.ord) GROUP BY id""",
    "feed_match": f"""SELECT item, id, exact FROM (SELECT item, id, exact FROM (SELECT ord AS item, first_value(id) OVER (PARTITION BY {_SQ.format('brand || model')} ORDER BY ord) AS id, TRUE AS exact FROM products) WHERE item % 40 = 7 UNION ALL SELECT item, id, FALSE FROM (SELECT f.ord AS item, c.id, row_number() OVER (PARTITION BY f.ord ORDER BY greatest(length({_SQ.format('c.brand || c.model')}), length({_SQ.format('c.model')})) DESC, c.ord) AS k
        FROM products f JOIN products c ON contains({_SQ.format("'New ' || f.brand || ' ' || f.model || ' now'")}, {_SQ.format('c.model')}) WHERE f.ord % 40 <> 7) WHERE k = 1)""",
    "fuzzy_match": f"""SELECT item, id, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY c DESC, ord) AS k FROM (SELECT s.item, p.id, p.ord, CASE WHEN s.m = p.m THEN 1e0 WHEN (starts_with(p.m, s.m) OR starts_with(s.m, p.m)) AND abs(length(p.m) - length(s.m)) <= 3 THEN 0.9e0 WHEN levenshtein(s.m, p.m) <= 2 THEN 0.85e0 END AS c
        FROM (SELECT *, {_SQ.format('model')} AS m FROM {_SCRAPED}) s JOIN (SELECT *, {_SQ.format('model')} AS m FROM products) p ON s.brand = p.brand) WHERE c IS NOT NULL) WHERE k = 1""",
    "prefix_match": f"""SELECT item, id, concat_ws(',', CASE WHEN abs(w - nw) >= 5 THEN 'w' END, CASE WHEN abs(h - nh) >= 5 THEN 'h' END, CASE WHEN abs(d - nd) >= 5 THEN 'd' END) AS conflicts FROM (SELECT s.item, p.id, p.w, p.h, p.d, s.w AS nw, s.h AS nh, s.d AS nd, row_number() OVER (PARTITION BY s.item ORDER BY p.ord) AS k FROM (SELECT *, {_SQ.format('model')} AS m FROM {_SCRAPED}) s
        JOIN (SELECT *, {_SQ.format('model')} AS m FROM products) p ON s.brand = p.brand AND (starts_with(p.m, s.m) OR starts_with(s.m, p.m)) WHERE TRUE) WHERE k = 1""",
    "offer_upsert": f"""SELECT product_id, arg_min(n, {{'a': nth_, 'b': pos}}) AS n, arg_max(url, {{'a': nth_, 'b': pos}}) FILTER (WHERE url IS NOT NULL) AS url, arg_max(p, {{'a': nth_, 'b': pos}}) AS p, min(pos) AS pos
        FROM (SELECT product_id, pos, n, url, p, 0 AS nth_ FROM offers UNION ALL SELECT product_id, pos, upper(n), NULL, p + 1, 1 FROM offers WHERE pos % 5 = 0) GROUP BY product_id, {_SQ.format('n')}""",
    "evidence_match": f'SELECT evidence_id, id, "by" FROM {_MATCH}',
    "evidence_overlay": f"SELECT cat, m.id IS NOT NULL AS verified, count(*) AS n, CAST(sum(coalesce(e.w, p.w)) AS BIGINT) AS w, CAST(sum(coalesce(e.h, p.h)) AS BIGINT) AS h FROM products p LEFT JOIN {_MATCH} m ON m.id = p.id LEFT JOIN {_EV} e ON e.evidence_id = m.evidence_id GROUP BY ALL",
    "evidence_new": f"SELECT min(evidence_id) AS evidence_id, {_SQ.format('model')} AS token FROM {_FIRST} WHERE evidence_id NOT IN (SELECT evidence_id FROM {_MATCH}) AND {_SQ.format('model')} NOT IN (SELECT {_SQ.format('model')} FROM products) GROUP BY token",
    "manual_retailers": "SELECT id, coalesce(k, 0) AS n_approved, k IS NULL OR unavailable AS unavailable FROM products LEFT JOIN (SELECT product_id, count(*) AS k FROM offers WHERE p > 1000 AND n <> 'Bing Lee' GROUP BY product_id) ON id = product_id",
    "research_lookup": "SELECT id, CASE WHEN ord % 3 = 0 THEN ord END AS value FROM products",
    "brand_alias": f"SELECT brand, count(*) AS n FROM (SELECT coalesce(canonical, brand) AS brand FROM products LEFT JOIN {_ALIAS} ON lower(brand) = lower(alias)) WHERE brand NOT IN (SELECT brand FROM products WHERE brand LIKE '%9') GROUP BY brand",
    "rule_canon": f"SELECT cat, name AS brand, side, rear, top FROM (SELECT *, row_number() OVER (PARTITION BY cat, name ORDER BY brand = name DESC, brand) AS k FROM (SELECT rules.*, coalesce(canonical, brand) AS name FROM rules LEFT JOIN {_ALIAS} ON lower(brand) = lower(alias))) WHERE k = 1",
    "missing_rules": "SELECT cat, brand, 20 AS side, 50 AS rear, 50 AS top FROM (SELECT DISTINCT cat, brand FROM products UNION SELECT DISTINCT cat, '__default__' FROM products) WHERE (cat, brand) NOT IN (SELECT (cat, brand) FROM rules)",
    "first_per_name": "SELECT id, display_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(display_name) ORDER BY ord) AS k FROM products) WHERE k = 1",
    "discovery_delta": "SELECT id, model FROM (SELECT id, 'N' || CAST(ord // 12 AS VARCHAR) AS model, row_number() OVER (PARTITION BY ord // 12 ORDER BY ord) AS k FROM products WHERE ord % 3 = 0) WHERE k = 1",
    "batch_targets": f"SELECT id FROM products p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT {_SQ.format('model')} AS sku FROM products WHERE ord % 100 = 0) WHERE sku = {_SQ.format('p.model')} OR (length(sku) >= 4 AND length({_SQ.format('p.model')}) >= 4 AND (contains({_SQ.format('p.model')}, sku) OR contains(sku, {_SQ.format('p.model')}))))",
    "circuit_breaker": "SELECT n_new, n_bad, n_old, CASE run WHEN 'mutated' THEN 'SCHEMA_MUTATION' ELSE CASE WHEN n_new < 0.8 * n_old THEN 'DATA_LOSS' WHEN n_bad > 0.3 * n_new THEN 'HIGH_ANOMALY_RATE' ELSE 'OK' END END AS verdict, run FROM (SELECT count(*) AS n_new, 0 AS n_bad, count(*) AS n_old, unnest(['all', 'mutated']) AS run FROM products UNION ALL SELECT count(*) FILTER (WHERE ord % 10 < 7), 0, count(*), 'lost' FROM products UNION ALL SELECT count(*), count(*) FILTER (WHERE ord % 2 = 0), count(*), 'odd' FROM products)",
    "issue_triage": "SELECT number, superseded_by FROM (SELECT o_orderkey AS number, o_orderdate AS created, row_number() OVER w AS nth, first_value(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC)) WHERE nth > 1 ORDER BY created, number LIMIT 200",
    "issue_actions": """SELECT action, count(*) AS signatures, CAST(sum(n) AS BIGINT) AS events FROM (SELECT n, CASE WHEN h % 3 = 0 THEN 'create' WHEN h % 3 = 1 THEN 'comment' WHEN h % 15 <= 7 THEN 'reopen' ELSE 'create' END AS action
        FROM (SELECT CAST('0x' || substr(sha256(message || '|' || regexp_extract(source, '[^/]*$') || '|' || CAST(line AS VARCHAR)), 1, 4) AS INTEGER) AS h, count(*) AS n FROM errors GROUP BY message, source, line)) GROUP BY action""",
    "priority_scores": f"""SELECT id, {_TIER} AS tier, CAST(CASE WHEN {_TIER} = 'dropped' THEN 0 ELSE least(100, greatest(0, coalesce(reach, 0) + CASE {_TIER} WHEN 'tier1' THEN 30 WHEN 'tier2' THEN 15 ELSE 0 END + stars * 6 + CASE WHEN DATE '{AS_OF}' - checked > 90 THEN -10 ELSE 0 END)) END AS INTEGER) AS score
        FROM catalog LEFT JOIN (SELECT product_id AS pid, sum(CASE n WHEN 'Harvey Norman' THEN 20 WHEN 'The Good Guys' THEN 20 WHEN 'JB Hi-Fi' THEN 18 WHEN 'Appliances Online' THEN 18 WHEN 'Bing Lee' THEN 10 ELSE 3 END) AS reach FROM offers GROUP BY product_id) ON pid = id""",
    "series_prefix": "SELECT id, 'S-' || prefix AS series FROM (SELECT p.id, s.prefix, row_number() OVER (PARTITION BY p.id ORDER BY length(s.prefix) DESC) AS k FROM products p JOIN (SELECT DISTINCT brand, substr(model, 1, CAST(2 + ord % 3 AS INTEGER)) AS prefix FROM products WHERE ord < 60) s ON s.brand = p.brand AND starts_with(p.model, s.prefix)) WHERE k = 1",
    "door_swing": """SELECT id, CAST(CASE WHEN s IS NOT NULL THEN s ELSE v END AS INTEGER) AS door_swing_mm, s IS NULL AND v IS NOT NULL AS inferred FROM (SELECT id, CASE WHEN ord % 11 = 0 THEN 50 END AS s, CASE WHEN cat IN ('dryer', 'dishwasher') THEN 0
        WHEN cat = 'washing_machine' THEN CASE WHEN ord % 3 = 1 THEN NULL ELSE 0 END WHEN c = 'Chest' OR (k <> '1' AND c = 'Upright' AND (k IN ('7', '5B') OR w >= 800)) THEN 0 WHEN c IN ('Upright', 'Top Mount') AND w >= 400 THEN w END AS v
        FROM (SELECT *, ['Upright', 'Chest', 'Top Mount', 'Bar'][ord // 4 % 4 + 1] AS c, ['1', '7', '5B'][ord // 16 % 3 + 1] AS k FROM products))""",
    "prices": "SELECT id, NOT (coalesce(ord % 2 = 0 AND price > 0, FALSE) OR coalesce(max_p > 0, FALSE)) AS unavailable, min_p AS any_price, least(min_p, CASE WHEN ord % 2 = 0 AND price > 0 THEN price END) AS own_price FROM catalog",
    "field_errors": f"SELECT id, unnest(list_filter([CASE WHEN w IS NULL THEN 'w' END, CASE WHEN h > 2500 THEN 'h' END, CASE WHEN trim(brand) = '' THEN 'brand' END, CASE WHEN price = 0 THEN 'price' END, CASE WHEN NOT (swing = 0 OR swing BETWEEN 5 AND 100 OR swing BETWEEN 400 AND 1200) THEN 'door_swing_mm' END], lambda x: x IS NOT NULL)) AS field FROM {_ERR}",
    "plausibility": "SELECT * FROM (SELECT id, concat_ws(',', CASE WHEN NOT w BETWEEN 500 AND 900 THEN 'w' END, CASE WHEN NOT h BETWEEN 850 AND 1900 THEN 'h' END, CASE WHEN NOT d BETWEEN 520 AND 780 THEN 'd' END) AS odd FROM products) WHERE odd <> ''",
    "accuracy_audit": f"""SELECT grade, issue, count(*) AS n FROM (SELECT grade, unnest(CASE WHEN len(i) > 0 THEN i ELSE ['none'] END) AS issue FROM (SELECT CASE WHEN bad THEN 'F' WHEN verified AND fresh THEN 'A' WHEN verified THEN 'B' ELSE 'C' END AS grade,
        list_filter([CASE WHEN bad THEN 'invalid-url' END, CASE WHEN n_offers = 0 THEN 'no-retailer' END, CASE WHEN verified AND NOT fresh THEN 'stale-price' END, CASE WHEN price IS NULL THEN 'no-price' END], lambda x: x IS NOT NULL) AS i
        FROM (SELECT c.*, n_strict < n_offers AS bad, coalesce(f, FALSE) AS fresh FROM catalog c LEFT JOIN (SELECT product_id AS pid, bool_or(strict AND p > 0 AND DATE '{AS_OF}' - verified_at <= 400) AS f FROM links GROUP BY product_id) ON pid = id))) GROUP BY grade, issue""",
    "coverage": "SELECT cat, brand, count(*) AS total, count(*) FILTER (WHERE price IS NULL) AS missing, CAST(floor(100e0 * count(price) / count(*) + 0.5e0) AS INTEGER) AS pct FROM products GROUP BY cat, brand",
    "category_summary": "SELECT c AS cat, count(id) AS n FROM (SELECT unnest(['fridge', 'washing_machine', 'dishwasher', 'dryer', 'washtower_combo']) AS c) LEFT JOIN products ON cat = c GROUP BY c",
    "brand_casing": f"SELECT lower(brand) AS folded, count(DISTINCT brand) AS spellings, count(*) AS n FROM {_CASED} GROUP BY folded HAVING count(DISTINCT brand) > 1",
    "brand_options": f"SELECT lower(brand) AS folded, arg_min(brand, ord) AS brand FROM {_CASED} GROUP BY folded",
    "metric_winners": """SELECT grp, metric, CASE WHEN count(*) FILTER (WHERE v = best) = 1 THEN min(id) FILTER (WHERE v = best) END AS winner FROM (SELECT *, max(v) OVER (PARTITION BY grp, metric) AS best FROM (SELECT ord // 4 AS grp, id, 'price' AS metric, -price AS v FROM products
        UNION ALL SELECT ord // 4, id, 'stars', stars FROM products UNION ALL SELECT ord // 4, id, 'w', -w FROM products) WHERE v IS NOT NULL) GROUP BY grp, metric""",
}


def oracle() -> dict[str, str]:
    return {n: with_tables(s) for n, s in ORACLE.items()}
