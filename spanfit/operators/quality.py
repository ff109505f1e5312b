"""Validation, inference, scores and audits of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import is_product_url_audit, js_round

#: Weights of retailers in the priority score (others 3), boosts of brand tiers.
RETAILER_WEIGHTS = {"Harvey Norman": 20, "The Good Guys": 20, "JB Hi-Fi": 18, "Appliances Online": 18, "Bing Lee": 10, "Betta": 8, "Winning Appliances": 12, "Retravision": 6, "2nds World": 4}
TIER_BOOSTS = {"tier1": 30, "tier2": 15, "tier3": 0}
#: Limits of product fields.
LIMITS = {"w": (200, 2500), "h": (200, 2500), "d": (200, 1500), "stars": (1, 6)}


def priority_score(tier: Column, verified_at: Column, as_of: str, research: Column | None = None) -> Column:
    """Retailers' weights, tier, stars, staleness and research, 0 to 100; dropped brands 0."""
    weights = F.create_map(*(F.lit(x) for pair in RETAILER_WEIGHTS.items() for x in pair))
    reach = F.aggregate("retailers", F.lit(0), lambda acc, r: acc + F.coalesce(F.try_element_at(weights, F.trim(r["n"])), F.lit(3)))
    boost = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TIER_BOOSTS.items() for x in pair)), tier), F.lit(0))
    stale = F.when(F.datediff(F.lit(as_of).cast("date"), verified_at) > 90, -10).otherwise(0)
    extra = F.lit(0.0) if research is None else research["available"] * 5 + F.least(research["reviews"], F.lit(500)) / 10
    raw = js_round((reach + boost + F.coalesce("stars", F.lit(0)) * 6 + stale) + F.coalesce(extra, F.lit(0.0)))
    return F.when(tier == "dropped", 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), raw))).cast("int")


def brand_tier(brand: Column, tiers: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit("unknown")
    for name, brands in reversed(tiers.items()):
        out = F.when(F.trim(brand).isin(*brands), name).otherwise(out)
    return out


def longest_prefix(rows: DataFrame, series: DataFrame, token: str = "token") -> DataFrame:
    """The series (brand, prefix, series) with the longest prefix of each row's token; first of equal ones.

    Prefixes are cut from the token at the lengths that occur, so the join is on equal text.
    """
    sizes = series.select(F.length("prefix").alias("size")).distinct()
    cut = rows.select("id", "brand", F.col(token).alias("t")).crossJoin(F.broadcast(sizes)).where(F.col("size") <= F.length("t"))  # lengths of prefixes: a handful
    hit = cut.withColumn("prefix", F.expr("substring(t, 1, size)")).join(series, ["brand", "prefix"])
    return hit.groupBy("id").agg(F.max(F.struct("size", "series")).alias("x")).select("id", F.col("x.series").alias("series"))


def infer_door_swing(rows: DataFrame) -> DataFrame:
    """Where door_swing_mm is null: 0 for front loaders and the fridge kinds without an arc, then the width for wide upright or top-mount fridges. Adds inferred."""
    config, kind, w = F.try_element_at("features", F.lit(1)), F.try_element_at("features", F.lit(2)), F.col("w")
    upright = config == "Upright"
    flat = config.isin("Chest", "Side by Side", "French Door") | (~kind.eqNullSafe(F.lit("1")) & ((upright & (kind == "7")) | (upright & (w >= 800)) | (upright & (kind == "5B"))))
    zero = F.when(F.col("cat").isin("dryer", "dishwasher"), True).when(F.col("cat") == "washing_machine", ~F.coalesce("top_loader", F.lit(False))).when(F.col("cat") == "fridge", F.coalesce(flat, F.lit(False))).otherwise(False)
    wide = (F.col("cat") == "fridge") & config.isin("Upright", "Top Mount") & (w >= 400)
    value = F.when(F.col("door_swing_mm").isNotNull(), F.col("door_swing_mm")).when(zero, 0).when(F.coalesce(wide, F.lit(False)), w)
    return rows.withColumns({"inferred": F.col("door_swing_mm").isNull() & value.isNotNull(), "door_swing_mm": value})


def available_by_price(rows: DataFrame) -> DataFrame:
    """unavailable unless the product or an offer has a positive price."""
    return rows.withColumn("unavailable", ~(F.coalesce(F.col("price") > 0, F.lit(False)) | F.exists("retailers", lambda r: F.coalesce(r["p"] > 0, F.lit(False)))))


def best_price(verified_only: bool = False, own: bool = False) -> Column:
    """The least positive price of the offers: of all or of verified ones; with the product's own or without."""
    kept = F.filter("retailers", lambda r: (r["p"] > 0) & (r["verified_at"].isNotNull() if verified_only else F.lit(True)))
    prices = F.transform(kept, lambda r: r["p"])
    return F.array_min(F.array_append(prices, F.when(F.col("price") > 0, F.col("price"))) if own else prices)


def field_errors(columns: list[str]) -> Column:
    """Names of fields out of their limits; price and door swing may be null."""
    wrong = [F.when(~F.coalesce(F.col(c).between(*LIMITS[c]), F.lit(False)), c) for c in LIMITS if c in columns]
    wrong += [F.when(F.coalesce(F.trim(c), F.lit("")) == "", c) for c in ("id", "cat", "brand", "model") if c in columns]
    if "price" in columns:
        wrong.append(F.when(~F.col("price").between(1, 100_000), "price"))
    if "door_swing_mm" in columns:
        d = F.col("door_swing_mm")
        wrong.append(F.when(~((d == 0) | d.between(5, 100) | d.between(400, 1200)), "door_swing_mm"))
    return F.array_compact(F.array(*wrong))


def plausible(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with `odd`: dimensions outside their category's range (cat, axis, low, high)."""
    wide = ranges.groupBy("cat").agg(F.map_from_entries(F.collect_list(F.struct("axis", F.struct("low", "high")))).alias("r"))
    odd = F.array_compact(F.array(*(F.when(~F.col(a).between(F.col("r")[F.lit(a)]["low"], F.col("r")[F.lit(a)]["high"]), a) for a in "whd")))
    return rows.join(F.broadcast(wide), "cat", "left").withColumn("odd", odd).drop("r")  # a row for each category


def accuracy_grade(bad_url: Column, bad_schema: Column, linked: Column, fresh: Column, inferred: Column, missing: Column) -> Column:
    return F.when(bad_url | bad_schema, "F").when(linked & fresh, "A").when(linked, "B").when(inferred | (missing > 0), "C").otherwise("D")


def audited(catalog: DataFrame, as_of: str, fresh_days: int = 400) -> DataFrame:
    """catalog with issues (array of code) and grade."""
    good = lambda r: is_product_url_audit(r["url"])
    linked = F.exists("retailers", good)
    bad_url = F.exists("retailers", lambda r: ~good(r))
    fresh = F.exists("retailers", lambda r: good(r) & (r["p"] > 0) & (F.datediff(F.lit(as_of).cast("date"), r["verified_at"]) <= fresh_days))
    errors = field_errors(catalog.columns)
    grade = accuracy_grade(bad_url, F.size(errors) > 0, linked, fresh, F.lit(False), F.lit(1))
    issues = F.array_compact(F.array(F.when(bad_url, "invalid-url"), F.when(F.size(errors) > 0, "schema"), F.when(F.size("retailers") == 0, "no-retailer"), F.when(linked & ~fresh, "stale-price"), F.when(F.col("price").isNull(), "no-price")))
    return catalog.withColumns({"issues": issues, "grade": grade})


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0).otherwise(js_round(F.lit(100.0) * part / whole)).cast("int")


def coverage(rows: DataFrame, missing: Column) -> DataFrame:
    per = rows.groupBy("cat", "brand").agg(F.count("*").alias("total"), F.count(F.when(missing, 1)).alias("missing"))
    return per.withColumn("pct", percentage(F.col("total") - F.col("missing"), F.col("total")))


def category_summary(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """n of each known category, zero included."""
    known = rows.sparkSession.createDataFrame([(c,) for c in categories], "cat string")
    return known.join(rows.groupBy("cat").agg(F.count("*").alias("n")), "cat", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def casing_groups(rows: DataFrame) -> DataFrame:
    """Brands spelt in several ways."""
    per = rows.groupBy(F.lower(F.trim("brand")).alias("folded")).agg(F.countDistinct("brand").alias("spellings"), F.count("*").alias("n"))
    return per.where("spellings > 1")


def brand_options(rows: DataFrame) -> DataFrame:
    """Distinct brands, case folded, in their first spelling."""
    return rows.groupBy(F.lower(F.trim("brand")).alias("folded")).agg(F.min_by("brand", "ord").alias("brand"))


def metric_winners(rows: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """Per metric (True: more is better) the row that wins among those with a value; none on a tie."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(m) if more else -F.col(m)).cast("double").alias("v")) for m, more in metrics.items()))
    long = rows.select("grp", "id", F.explode(pairs).alias("x")).select("grp", "id", "x.*").where("v is not null")
    best = long.groupBy("grp", "metric").agg(F.max("v").alias("best"))
    top = long.join(best, ["grp", "metric"]).where("v = best").groupBy("grp", "metric").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    return top.select("grp", "metric", F.when(F.col("k") == 1, F.col("id")).alias("winner"))
