"""Catalog building: ordered upserts, entity resolution, offers, evidence, canonical brands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfit.functions.columns import squash
from spanfit.functions.lineage import cut
from spanfit.operators.facets import ranked
from spanfit.operators.similar import apart, contained, few_edits, prefixes


def upsert(base: DataFrame, sources: list[DataFrame], key: str = "id") -> DataFrame:
    """base overlaid by the sources in order: per field the last value that is not null; new keys are added.

    One union and one group-by, whatever the number of sources. A row is available only where the flag is literally false.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("_at", F.lit(k)) for k, d in enumerate([base, *sources])])
    fields = [c for c in rows.columns if c not in (key, "_at")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in fields]
    out = rows.groupBy(key).agg(*last)
    return out.withColumn("unavailable", ~F.col("unavailable").eqNullSafe(F.lit(False))) if "unavailable" in fields else out


def upsert_by_key(base: DataFrame, rows: DataFrame) -> DataFrame:
    """rows update base by id, else by brand and model folded; what matches neither is new. Fields: last not null, in order of ord."""
    k = F.concat(squash(F.col("brand")), F.lit("|"), squash(F.col("model")))
    known = base.select(F.col("id").alias("known_id"))
    by_key = base.withColumn("fold", k).groupBy("fold").agg(F.min_by("id", "ord").alias("key_id"))
    target = rows.withColumn("fold", k).join(known, F.col("id") == F.col("known_id"), "left").join(by_key, "fold", "left")
    target = target.withColumn("id", F.coalesce("known_id", "key_id", "id")).drop("known_id", "key_id", "fold")
    return upsert_ordered(base.withColumn("_at", F.lit(-1).cast("long")).unionByName(target.withColumn("_at", F.col("ord").cast("long")), allowMissingColumns=True))


def upsert_ordered(rows: DataFrame, key: str = "id") -> DataFrame:
    """Per key and field the value that is not null and has the largest _at."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in rows.columns if c not in (key, "_at")))


def feed_match(feed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Feed rows (item, name, brand, model) to product ids: equal brand and model, else the longest catalog key that the name contains (first of equal ones)."""
    key = F.concat(squash(F.col("brand")), squash(F.col("model")))
    index = catalog.select("id", "ord", key.alias("brand_model"), squash(F.col("model")).alias("model_key"))
    first = index.groupBy("brand_model").agg(F.min_by("id", "ord").alias("exact_id"))
    rows = feed.withColumns({"name_key": squash(F.col("name")), "brand_model": F.when((squash(F.col("brand")) != "") & (squash(F.col("model")) != ""), key)})
    rows = apart(rows).join(apart(first), "brand_model", "left")
    left = rows.where("exact_id is null and name_key <> ''").select("item", "name_key")
    # A name that holds brand and model holds the model.
    pairs = contained(index.select(F.col("id").alias("c_id"), F.col("ord").alias("c_ord"), F.col("brand_model").alias("c_brand_model"), F.col("model_key").alias("c_model")), left, "c_model", "name_key")
    best = pairs.groupBy("item").agg(F.min_by("c_id", F.struct(-F.greatest(F.length("c_brand_model"), F.length("c_model")), "c_ord")).alias("loose_id"))
    return apart(rows).join(apart(best), "item", "left").select("item", F.coalesce("exact_id", "loose_id").alias("id"), F.col("exact_id").isNotNull().alias("exact"))


def fuzzy_match(scraped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scraped (item, brand, model) to the catalog's best model of the same brand: 1 equal, 0.9 prefix within 3 letters, 0.85 within 2 edits."""
    a = scraped.select("item", squash(F.col("brand")).alias("b"), squash(F.col("model")).alias("m"))
    c = catalog.select(F.col("id").alias("c_id"), F.col("ord").alias("c_ord"), squash(F.col("brand")).alias("b"), squash(F.col("model")).alias("c_m"))
    m, n = F.col("m"), F.col("c_m")
    near = F.abs(F.length(m) - F.length(n))
    score = F.when(m == n, 1.0).when((n.startswith(m) | m.startswith(n)) & (near <= 3), 0.9).when((near <= 2) & (F.levenshtein(m, n, 2) >= 0), 0.85)
    asked, known = a.where(m != "").select("b", "m").distinct(), c.where(n != "").select("b", "c_m").distinct()
    longer = apart(known.withColumn("m", F.explode(prefixes(n, dropped=3)))).join(apart(asked), ["b", "m"])
    shorter = apart(asked.withColumn("c_m", F.explode(prefixes(m, dropped=3)))).join(apart(known), ["b", "c_m"])
    begun = cut(longer.unionByName(shorter).distinct())
    # Edits score least: they are asked of those alone that no prefix settles.
    edits = few_edits(apart(asked).join(apart(begun.select("b", "m").distinct()), ["b", "m"], "left_anti"), known, "m", "c_m", 2, ("b",))
    texts = edits.unionByName(begun).withColumn("confidence", score).where("confidence is not null")
    pairs = apart(apart(a).join(apart(texts), ["b", "m"])).join(apart(c), ["b", "c_m"])
    best = pairs.groupBy("item").agg(F.min(F.struct((-F.col("confidence")).alias("worse"), "c_ord", "c_id")).alias("x"))
    return best.select("item", F.col("x.c_id").alias("id"), (-F.col("x.worse")).alias("confidence"))


def prefix_match(extracted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Extracted (item, brand, model, w, h, d) to the first catalog row of the brand with either model a prefix of the other; conflicts of 5 mm or more."""
    a = extracted.select("item", squash(F.col("brand")).alias("b"), squash(F.col("model")).alias("m"), *(F.col(x).alias(f"new_{x}") for x in "whd"))
    c = catalog.select("id", "ord", "w", "h", "d", squash(F.col("brand")).alias("b"), squash(F.col("model")).alias("n"))
    asked, known = a.where("m <> ''").select("b", "m").distinct(), c.where("n <> ''").select("b", "n").distinct()
    longer = apart(known.withColumn("m", F.explode(prefixes(F.col("n"))))).join(apart(asked), ["b", "m"])
    shorter = apart(asked.withColumn("n", F.explode(prefixes(F.col("m"))))).join(apart(known), ["b", "n"])
    pairs = apart(apart(a).join(apart(longer.unionByName(shorter).distinct()), ["b", "m"])).join(apart(c), ["b", "n"])
    best = pairs.groupBy("item").agg(F.min(F.struct("ord", "id", "w", "h", "d", "new_w", "new_h", "new_d")).alias("x")).select("item", "x.*")
    conflicts = F.array_compact(F.array(*(F.when(F.abs(F.col(x) - F.col(f"new_{x}")) >= 5, F.lit(x)) for x in "whd")))
    return best.select("item", "id", F.array_join(conflicts, ",").alias("conflicts"))


def upsert_offers(offers: DataFrame, new: DataFrame, policy: str = "update") -> DataFrame:
    """Offers by product and folded name. update: url and price where given; replace: the new offer as it is; merge: every field last not null."""
    k = squash(F.col("n"))
    rows = offers.withColumns({"_at": F.lit(0), "k": k}).unionByName(new.withColumns({"_at": F.lit(1), "k": k}), allowMissingColumns=True)
    last = lambda c: F.max_by(c, F.struct("_at", "pos")) if policy == "replace" else F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_at", "pos")))
    first = F.min_by("n", F.struct("_at", "pos")) if policy == "update" else last("n")
    return rows.groupBy("product_id", "k").agg(first.alias("n"), last("url").alias("url"), last("p").alias("p"), F.min("pos").alias("pos")).drop("k")


def _tokens(rows: DataFrame, *names: str) -> Column:
    """The squashed values of those columns that exist, in order, without empty and repeated ones."""
    there = [squash(F.col(n)) for n in names if n in rows.columns]
    return F.array_distinct(F.filter(F.array(*there), lambda t: t != ""))


def evidence_keys(evidence: DataFrame) -> DataFrame:
    """(token, evidence_id): model tokens that stand for one file.

    Files are taken in order, each file's tokens (model, sku, extracted_model) in order up to the first that another file
    has already set; that one stands for none from then on. A claim counts if no earlier token of its file collided, and a
    collision is a token's second claim that counts: repeated from all claims, that settles files in order, so the loop
    ends after as many rounds as collisions follow from each other. Of a token's claims only the first two are ranked.
    """
    claims = cut(evidence.select("evidence_id", F.posexplode(_tokens(evidence, "model", "sku", "extracted_model")).alias("pos", "token")))
    live, state = claims, None
    while True:
        second = ranked(live, [F.asc("evidence_id")], ["token"], 2, "nth").where("nth = 2")
        stops = cut(second.groupBy("evidence_id").agg(F.min("pos").alias("stop")))
        now = tuple(stops.agg(F.count("*"), F.bit_xor(F.xxhash64("evidence_id", "stop"))).first())
        if now == state:
            break
        state = now
        live = claims.join(stops, "evidence_id", "left").where(F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))).drop("stop")
    return live.groupBy("token").agg(F.min("evidence_id").alias("evidence_id"), F.count("*").alias("n")).where("n = 1").drop("n")


def match_evidence(evidence: DataFrame, products: DataFrame) -> DataFrame:
    """(evidence_id, id, by): each file to one product.

    A product takes the file that names its id (or else slug), else the one that the first known of its tokens stands for
    (model, sku, id, slug in order). Of files that name the same product only the first counts at all, and of products that
    take the same file the first; the others stay as they are.
    """
    named = ranked(evidence.where(F.coalesce("product_id", F.lit("")) != ""), [F.asc("evidence_id")], ["product_id"], 1, "nth").drop("nth")
    counted = named.unionByName(evidence.where(F.coalesce("product_id", F.lit("")) == ""))
    own = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("id", "slug") if c in products.columns))
    by_id = products.select("id", "ord", own.alias("key")).join(named.select(F.col("product_id").alias("key"), "evidence_id"), "key").select("id", "ord", "evidence_id", F.lit(-1).alias("way"))
    by_token = products.select("id", "ord", F.posexplode(_tokens(products, "model", "sku", "id", "slug")).alias("way", "token")).join(evidence_keys(counted), "token").select("id", "ord", "evidence_id", "way")
    taken = by_id.unionByName(by_token).groupBy("id", "ord").agg(F.min_by(F.struct("evidence_id", "way"), "way").alias("x")).select("id", "ord", "x.*")
    return ranked(taken, [F.asc("ord")], ["evidence_id"], 1, "nth").select("evidence_id", "id", F.when(F.col("way") < 0, "id").otherwise("token").alias("by"))


def manual_evidence(products: DataFrame, manual: DataFrame) -> DataFrame:
    """products with `evidence` (has_pdf_evidence, source_url, verified_at, source_type) of the manual entry that is theirs; null without one that is approved.

    manual: key, ord, brand, model, items (status, verified_at, extraction_date, source_url, pdf_url, has_pdf_evidence,
    source_type, sku). A product's entry is the one under its slug, or its id, or else the first of its brand whose model,
    or whose first approved item's SKU, is the product's model. The entry's first approved item with a date and no bad
    address counts; an entry without one is not replaced by another.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    approved = F.filter("items", lambda x: F.coalesce(x["status"] == "approved", F.lit(False)))
    entries = manual.withColumns({"e_brand": low("brand"), "e_model": low("model"), "e_sku": low(F.get(approved, F.lit(0))["sku"])})
    direct = entries.select(F.col("key").alias("e_key"), "ord", "items")
    way = lambda n, e, cond, p: p.join(e, cond).select(F.col("p_id"), F.struct(F.lit(n).alias("way"), F.col("ord")).alias("at"), "items")
    mine = products.select(F.col("id").alias("p_id"), *(F.trim(F.coalesce(c, F.lit(""))).alias(f"p_{c}") for c in ("slug",) if c in products.columns), low("brand").alias("p_brand"), low("model").alias("p_model"))
    by_model = F.array_distinct(F.array("e_model", "e_sku"))
    named = entries.where("e_brand <> ''").select("ord", "items", "e_brand", F.explode(by_model).alias("e_name")).where("e_name <> ''")
    found = [way(1, direct, F.col("p_id") == F.col("e_key"), mine), way(2, named, (F.col("p_brand") == F.col("e_brand")) & (F.col("p_model") == F.col("e_name")), mine)]
    if "p_slug" in mine.columns:
        found.append(way(0, direct, (F.col("p_slug") != "") & (F.col("p_slug") == F.col("e_key")), mine))
    best = reduce(DataFrame.unionByName, found).groupBy("p_id").agg(F.min_by("items", "at").alias("items"))
    web = lambda u: F.nullif(F.regexp_extract(F.coalesce(u, F.lit("")), r"(?i)^\s*(https?://[^/\s?#]\S*)\s*$", 1), F.lit(""))
    day = lambda d: F.nullif(F.regexp_extract(F.coalesce(d, F.lit("")), r"^\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    patch = lambda x: F.struct(F.coalesce(x["has_pdf_evidence"], F.lit(True)).alias("has_pdf_evidence"), F.coalesce(web(x["source_url"]), web(x["pdf_url"])).alias("source_url"), F.coalesce(day(x["verified_at"]), day(x["extraction_date"])).alias("verified_at"), F.nullif(F.trim(x["source_type"]), F.lit("")).alias("source_type"))
    picked = best.select("p_id", F.get(F.filter(F.transform(approved, patch), lambda x: x["verified_at"].isNotNull()), F.lit(0)).alias("evidence"))
    return products.join(picked, F.col("id") == F.col("p_id"), "left").drop("p_id")


def overlay_evidence(products: DataFrame, matched: DataFrame, evidence: DataFrame) -> DataFrame:
    """Dimensions of matched evidence in place of the product's own; verified marks them."""
    e = matched.join(evidence, "evidence_id").select("id", *(F.col(x).alias(f"e_{x}") for x in "whd"))
    rows = products.join(e, "id", "left")
    return rows.withColumns({**{x: F.coalesce(f"e_{x}", x) for x in "whd"}, "verified": F.col("e_w").isNotNull()}).drop(*(f"e_{x}" for x in "whd"))


def new_from_evidence(evidence: DataFrame, matched: DataFrame, products: DataFrame) -> DataFrame:
    """Evidence that matched nothing, once per model, unless a product has the model; files that name a product which an earlier file names are left out."""
    first = F.row_number().over(Window.partitionBy("product_id").orderBy("evidence_id")) == 1
    named = evidence.where(F.coalesce("product_id", F.lit("")) != "").withColumn("_first", first).where("_first").drop("_first")
    left = named.unionByName(evidence.where(F.coalesce("product_id", F.lit("")) == "")).join(matched, "evidence_id", "left_anti").withColumn("token", squash(F.col("model")))
    known = products.select(squash(F.col("model")).alias("token"))
    return ranked(left.join(known, "token", "left_anti"), [F.asc("evidence_id")], ["token"], 1, "nth").select("evidence_id", "token")


def set_retailers(products: DataFrame, approved: DataFrame, removed: tuple[str, ...] = ()) -> DataFrame:
    """n_approved of each product; without any it is unavailable."""
    per = approved.where(~F.col("n").isin(*removed) if removed else F.lit(True)).groupBy("product_id").agg(F.count("*").alias("n_approved"))
    rows = products.join(per, F.col("id") == F.col("product_id"), "left").drop("product_id")
    return rows.withColumns({"unavailable": F.when(F.col("n_approved").isNull(), F.lit(True)).otherwise(F.col("unavailable")), "n_approved": F.coalesce("n_approved", F.lit(0))})


def lookup(products: DataFrame, research: DataFrame) -> DataFrame:
    """research (key, value) by id, else by model."""
    a, b = (research.select(F.col("key").alias(f"k{x}"), F.col("value").alias(f"v{x}")) for x in "ab")
    return products.join(a, F.col("id") == F.col("ka"), "left").join(b, F.col("model") == F.col("kb"), "left").withColumn("value", F.coalesce("va", "vb")).drop("ka", "va", "kb", "vb")


def canonical_brands(products: DataFrame, aliases: DataFrame, dropped: DataFrame) -> DataFrame:
    """Brands by alias (alias, canonical), case folded; rows of dropped brands go."""
    a = aliases.select(F.lower(F.trim("alias")).alias("alias_key"), "canonical")
    rows = products.join(a, F.lower(F.trim("brand")) == F.col("alias_key"), "left").withColumn("brand", F.coalesce("canonical", "brand")).drop("alias_key", "canonical")
    return rows.join(dropped.select(F.col("brand")), "brand", "left_anti")


def canonical_rules(rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rules under canonical brands; where several meet, the one already so named, else the first."""
    a = aliases.select(F.lower("alias").alias("alias_key"), "canonical")
    named = rules.join(a, F.lower("brand") == F.col("alias_key"), "left").withColumn("name", F.coalesce("canonical", "brand"))
    best = ranked(named, [(F.col("brand") == F.col("name")).desc(), F.asc("brand")], ["cat", "name"], 1, "nth")
    return best.select("cat", F.col("name").alias("brand"), "side", "rear", "top")


def missing_rules(products: DataFrame, rules: DataFrame, default: tuple[int, int, int] = (20, 50, 50)) -> DataFrame:
    """Default rules for (cat, brand) and (cat, `__default__`) that have none."""
    wanted = products.select("cat", "brand").distinct().unionByName(products.select("cat").distinct().withColumn("brand", F.lit("__default__")))
    side, rear, top = default
    return wanted.join(rules, ["cat", "brand"], "left_anti").select("cat", "brand", F.lit(side).alias("side"), F.lit(rear).alias("rear"), F.lit(top).alias("top"))


def first_per_key(rows: DataFrame, key: Column) -> DataFrame:
    """The first row of each key, in order of ord."""
    return ranked(rows.withColumn("_key", key), [F.asc("ord")], ["_key"], 1, "_nth").drop("_key", "_nth")


def discovery_delta(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Found rows whose folded model is new, the first of each."""
    known = catalog.select(squash(F.col("model")).alias("fold")).distinct()
    return first_per_key(found.withColumn("fold", squash(F.col("model"))).join(known, "fold", "left_anti"), F.col("fold")).drop("fold")


def batch_targets(products: DataFrame, skus: DataFrame) -> DataFrame:
    """Products whose folded model equals a wanted SKU, or holds it or is held by it (4 letters at least).

    Both ways meet by their rarest gram.
    """
    s = skus.select(squash(F.col("sku")).alias("sku")).where("sku <> ''").distinct()
    models = products.select(squash(F.col("model")).alias("folded")).where("folded <> ''").distinct()
    long, whole = s.where(F.length("sku") >= 4), models.where(F.length("folded") >= 4)
    hits = s.select(F.col("sku").alias("folded")).unionByName(contained(long, whole, "sku", "folded").select("folded")).unionByName(contained(whole, long, "folded", "sku").select("folded")).distinct()
    return products.withColumn("folded", squash(F.col("model"))).join(hits, "folded", "left_semi").drop("folded")


def breaker(new: DataFrame, old: DataFrame, bad: Column, required: tuple[str, ...], least_kept: float = 0.8, most_bad: float = 0.3) -> DataFrame:
    """One row: n_new, n_old, n_bad and verdict: SCHEMA_MUTATION, DATA_LOSS, HIGH_ANOMALY_RATE or OK (strict inequalities)."""
    n = new.agg(F.count("*").alias("n_new"), F.count(F.when(bad, 1)).alias("n_bad")).crossJoin(old.agg(F.count("*").alias("n_old")))  # one row each
    missing = F.lit(any(c not in new.columns for c in required))
    verdict = F.when(missing & (F.col("n_new") > 0), "SCHEMA_MUTATION").when((F.col("n_old") > 0) & (F.col("n_new") < least_kept * F.col("n_old")), "DATA_LOSS").when((F.col("n_new") > 0) & (F.col("n_bad") > most_bad * F.col("n_new")), "HIGH_ANOMALY_RATE").otherwise("OK")
    return n.withColumn("verdict", verdict)


def raise_if_broken(verdict: DataFrame) -> None:
    """Stops a run whose breaker has tripped."""
    row = verdict.first()
    if row["verdict"] != "OK":
        raise ValueError(f"{row['verdict']}: {row['n_new']} new, {row['n_old']} old, {row['n_bad']} bad")


def triage(issues: DataFrame, most: int) -> DataFrame:
    """Of issues (label, key, number, created), the newest of each group stays; older ones close, oldest first, while there is room."""
    group = Window.partitionBy("label", "key")
    rows = issues.withColumns({"nth": F.row_number().over(group.orderBy(F.desc("created"), F.desc("number"))), "newest": F.first("number").over(group.orderBy(F.desc("created"), F.desc("number")))})
    return rows.where("nth > 1").orderBy("created", "number").limit(most).select("number", F.col("newest").alias("superseded_by"))


def issue_actions(signatures: DataFrame, issues: DataFrame, as_of: str) -> DataFrame:
    """Per error signature: create, comment (open), reopen (closed within 7 days) or create."""
    rows = signatures.join(issues, "signature", "left")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("closed_on"))
    return rows.withColumn("action", F.when(F.col("state").isNull(), "create").when(F.col("state") == "open", "comment").when(age <= 7, "reopen").otherwise("create"))
