"""Lists for pages and stores: bounded stores, slug collisions, page orders, picks by width, link pools, brand records, record filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import by_name, squash
from spanfit.operators.facets import ranked

#: How far a width may be from the hint, products of a page, links of a page, statuses of active records.
NEAR_WIDTH, PAGE_PRODUCTS, LEAST_PRODUCTS, POOL = 120, 6, 3, 24
ACTIVE, APPROVED = "(?i)available|active", "(?i)approved"


def saved_searches(saves: DataFrame, most: int = 3) -> DataFrame:
    """Per user the newest `most` names from a log of saves (user, at, name, id, url): a name saved again has its new URL and its first id."""
    latest = saves.groupBy("user", "name").agg(F.min_by("id", "at").alias("id"), F.max_by("url", "at").alias("url"), F.max("at").alias("at"))
    return ranked(latest, [F.desc("at"), F.asc("name")], ["user"], most, "place")


def slug_winners(groups: DataFrame) -> DataFrame:
    """Of groups (slug, n, ord, ...) with one slug, the larger; the first of equal ones."""
    return ranked(groups, [F.desc("n"), F.asc("ord")], ["slug"], 1, "_nth").drop("_nth")


def page_order(kind: str) -> list[Column]:
    """Order of an index of pages: brand, compare, cavity, doorway or product."""
    return {
        "brand": [F.asc("cat"), F.asc("brand")], "compare": [F.asc("cat"), F.asc("brand_a"), F.asc("brand_b")], "cavity": [F.asc("width")], "doorway": [F.asc("doorway")], "product": [F.asc("slug")],
    }[kind]


def verified_products(products: DataFrame, index: DataFrame) -> DataFrame:
    """Products with verified evidence and whole sizes, by category and name."""
    rows = products.join(index.where("verified").select(F.col("product_id").alias("id")).distinct(), "id", "left_semi")
    return rows.where("w > 0 and h > 0 and d > 0").orderBy("cat", by_name(F.col("display_name")), "ord")


def by_priority(products: DataFrame, most: int) -> DataFrame:
    """rank, id: the `most` products of highest priority (none counts as 0)."""
    return ranked(products, [F.coalesce("priority", F.lit(0)).desc(), F.asc("ord")], most=most).select("rank", "id")


def dataset_of(query: Column) -> Column:
    """Category that a query is about."""
    q = F.lower(query)
    return F.when(F.contains(q, F.lit("dishwasher")), "dishwasher").when(q.rlike("washing machine|washer"), "washing_machine").when(F.contains(q, F.lit("dryer")), "dryer").otherwise("fridge")


def width_hint(query: Column) -> Column:
    """The width in mm that a query names."""
    return F.nullif(F.regexp_extract(query, r"(?i)([0-9]{3,4})\s*mm", 1), F.lit("")).try_cast("int")


def picked_products(queries: DataFrame, products: DataFrame) -> DataFrame:
    """(ord, place, id): of each query (ord, query) the six products of its category with most stars (then by model) near the width it names, or of all if fewer than three are near.

    Of a category and width the best six are enough; near ones come from bands of the allowed distance, cut to six per band
    and width before any query meets them.
    """
    keys = [F.coalesce("stars", F.lit(-1)).desc(), by_name(F.col("model")).asc(), F.asc("p_ord")]
    asked = queries.select("ord", dataset_of(F.col("query")).alias("cat"), width_hint(F.col("query")).alias("hint"))
    rows = products.where("w is not null and h is not null and d is not null").select(F.col("ord").alias("p_ord"), "id", "cat", "w", "stars", "model")
    rows = ranked(rows, keys, ["cat", "w"], PAGE_PRODUCTS, "_k").drop("_k")
    hints = asked.where("hint is not null").select("cat", "hint").distinct()
    band = lambda x: F.floor(x / NEAR_WIDTH)
    bands = hints.withColumn("band", F.explode(F.array(*(band(F.col("hint")) + k for k in (-1, 0, 1)))))
    near = bands.join(rows.withColumn("band", band(F.col("w"))), ["cat", "band"]).where(F.abs(F.col("w") - F.col("hint")) <= NEAR_WIDTH)
    near = ranked(near, keys, ["cat", "hint"], PAGE_PRODUCTS, "place")
    enough = near.groupBy("cat", "hint").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PRODUCTS).drop("n")
    narrow = asked.join(near.join(enough, ["cat", "hint"]), ["cat", "hint"]).select("ord", "place", "id")
    best = ranked(rows, keys, ["cat"], PAGE_PRODUCTS, "place").select("cat", "place", "id")
    wide = asked.join(enough, ["cat", "hint"], "left_anti").join(best, "cat").select("ord", "place", "id")
    return narrow.unionByName(wide)


def link_pool(sources: list[tuple[DataFrame, list[Column], int]], by: str = "page", most: int = POOL) -> DataFrame:
    """(page, place, url, label): links of ordered sources (page, url, label) with a cap on each, internal ones only, the first of equal URLs, `most` a page."""
    capped = [ranked(rows.select(by, "url", "label", *(k for k in rows.columns if k not in (by, "url", "label"))), keys, [by], cap, "_nth").select(by, "url", "label", F.lit(k).alias("_source"), "_nth") for k, (rows, keys, cap) in enumerate(sources)]
    every = reduce(DataFrame.unionByName, capped).where(F.col("url").startswith("/"))
    first = every.groupBy(by, "url").agg(F.min_by(F.struct("_source", "_nth", "label"), F.struct("_source", "_nth")).alias("x")).select(by, "url", "x.*")
    return ranked(first, [F.asc("_source"), F.asc("_nth")], [by], most, "place").select(by, "place", "url", F.coalesce("label", "url").alias("label"))


def brand_records(products: DataFrame, rules: DataFrame, samples: int = 3) -> DataFrame:
    """Per category and brand with a rule: models, unknown door swings, and the first ids by model of its available, archived and all products."""
    first = lambda cond: F.transform(F.slice(F.array_sort(F.collect_list(F.when(cond, F.struct("model", "id")))), 1, samples), lambda x: x["id"])
    few = ranked(products, [F.asc("model"), F.asc("id")], ["cat", "brand", "unavailable"], samples, "_k")  # what the samples can need
    lists = few.groupBy("cat", "brand").agg(first(~F.col("unavailable")).alias("active"), first(F.col("unavailable")).alias("archived"), first(F.lit(True)).alias("top"))
    counts = products.groupBy("cat", "brand").agg(F.count("*").alias("models"), F.count(F.when(F.col("door_swing_mm").isNull(), 1)).alias("pending_swing"))
    return counts.join(lists, ["cat", "brand"]).join(rules, ["cat", "brand"])


def wildcard_match(pattern: Column, sku: Column, prefix: bool = False) -> Column:
    """Whether a model with stars for any letters and digits names a SKU; with prefix, a model of six letters without a star also names what begins with it."""
    clean = lambda x, kept: F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), "/SA$", ""), f"[^A-Z0-9{kept}]+", "")
    p, s = clean(pattern, "*"), clean(sku, "")
    hit = F.rlike(s, F.concat(F.lit("^"), F.regexp_replace(p, r"\*+", "[A-Z0-9]*"), F.lit("$")))
    if prefix:
        hit = hit | (~F.contains(p, F.lit("*")) & (F.length(p) >= 6) & s.startswith(p))
    return (p != "") & (s != "") & hit


def is_active(availability: Column, submitted: Column, dates: list[Column], cutoff: str | None) -> Column:
    """Records not said to be unavailable or unapproved, and with any known date from the cutoff on (or none known)."""
    said = lambda x, p: F.when(F.coalesce(F.trim(x), F.lit("")) == "", True).otherwise(x.rlike(p))
    ok = said(availability, ACTIVE) & said(submitted, APPROVED)
    if cutoff is None:
        return ok
    known = F.array_compact(F.array(*(F.try_to_date(d) for d in dates)))
    return ok & ((F.size(known) == 0) | F.exists(known, lambda x: x >= F.lit(cutoff).cast("date")))


def features(candidates: list[Column], default: str) -> Column:
    """Up to four distinct features that say something; the default if none does."""
    named = F.filter(F.transform(F.array(*candidates), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: ~F.lower(x).isin("", "-", "n/a"))
    return F.when(F.size(named) > 0, F.slice(F.array_distinct(named), 1, 4)).otherwise(F.array(F.lit(default)))


def latest_check(offers: DataFrame, strict: Column) -> DataFrame:
    """product_id and the newest check date of its verified offers."""
    return offers.where(strict).groupBy("product_id").agg(F.max("verified_at").alias("checked"))


def brand_filter(rows: DataFrame, chosen: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows of the chosen brands or of any alias (alias, canonical) of one: a union of sets, met once."""
    key = lambda x: squash(x)
    names = chosen.select(key(F.col("brand")).alias("key"))
    other = aliases.select(key(F.col("alias")).alias("alias_key"), key(F.col("canonical")).alias("key")).join(names, "key", "left_semi").select(F.col("alias_key").alias("key"))
    wanted = names.unionByName(other).distinct()
    return rows.withColumn("key", key(F.col("brand"))).join(wanted, "key", "left_semi").drop("key")
