"""Queries of names, slugs, clearance in words and the fit calculator."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfit.operators import naming as n
from spanfit.operators.similar import dealt
from spanfit.plans.oracle import with_tables
from spanfit.sources import adapters

USUAL = {"side": 10, "rear": 10, "top": 15}
BRANDS = [("fisher-paykel", "Fisher & Paykel"), ("samsung", "Samsung"), ("lg", "LG")]
MODEL_BRANDS = [(r"^(RF|RS|WH|DH)[0-9]", "Fisher & Paykel"), (r"^(SRF|SRS|WW)[0-9]", "Samsung")]
WEAK = ("series", "door", "load", "front", "top", "white", "black", "steel", "with")
KINDS = ("Upright", "Built-in  under", "front load", "Heat Pump")


def _p(spark, sf_dir):
    return adapters.products(spark, sf_dir)


def _model():
    k = F.col("ord")
    return F.concat(F.when(k % 2 == 0, F.concat((100 + k % 700).cast("string"), F.lit("L "))).otherwise(""), F.when(k % 3 == 0, F.concat((k % 12).cast("string"), F.lit(".5 kg "))).otherwise(""), F.when(k % 5 == 0, F.lit("14 Place ")).otherwise(""), F.when(k % 7 == 0, F.lit("Top Mount")).otherwise("vented"))


def readable_specs(spark, sf_dir):
    k = F.col("ord")
    rows = _p(spark, sf_dir).withColumns({"model": _model(), "features": F.when(k % 11 != 0, F.array(F.element_at(F.array(*map(F.lit, KINDS)), (F.floor(k / 4) % 4 + 1).cast("int")))), "top_loader": k % 13 == 0})
    return rows.select("id", n.readable_spec().alias("spec"), n.display_name(n.brand_display(F.lower("brand"), {"brand#7": "Seven"}), F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("Series X")), F.col("cat")).alias("name"))


def slug_discovery(spark, sf_dir):
    """Every product as a shop's address: brand, size, colour, model in one or two parts and category words."""
    k = F.col("ord")
    pick = lambda by, *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(k / by) % len(v) + 1).cast("int"))
    url = F.concat(F.lit("https://shop.example.org/a/"), pick(1, "samsung-", "LG-", "fisher-paykel-", ""), pick(4, "500l-", "9kg-", ""), pick(12, "srf", "ww-a", "x", "RS"), k.cast("string"), pick(2, "w-", "-"), pick(3, "french-door-fridge", "hair-dryer", "heat-pump-dryer", "front-load-washer", "toaster"), pick(5, ".html", ""))
    return n.discovered(dealt(_p(spark, sf_dir), "ord").select(url.alias("url")), BRANDS, MODEL_BRANDS, WEAK)


def spec_attributes(spark, sf_dir):
    attribute = lambda name, value: F.struct(F.lit(name).alias("displayName"), value.cast("string").alias("value"))
    groups = F.create_map(F.lit("Size"), F.array(attribute(" Width ", F.col("w")), attribute("Height", F.col("h"))), F.lit("More"), F.when(F.col("ord") % 2 == 0, F.array(attribute("WIDTH", F.lit(1)), attribute("Depth", F.col("d")))).otherwise(F.array(attribute("Other", F.lit(0)))))
    return _p(spark, sf_dir).select("id", n.attribute_value(groups, ("width", "product width")).alias("width"), n.attribute_value(groups, ("DEPTH",)).alias("depth"))


def sku_in_text(spark, sf_dir):
    k = F.col("ord")
    text = F.concat(F.lit("Manual for "), F.when(k % 3 == 0, F.upper("model")).when(k % 3 == 1, F.concat(F.lit("sku "), k.cast("string"), F.lit("-x"))).otherwise("nothing"))
    return _p(spark, sf_dir).select("id", n.holds_sku(text, [F.col("model"), F.concat(k.cast("string"), F.lit("X"))]).alias("held"))


def recent_checks(spark, sf_dir):
    rows = adapters.offers(spark, sf_dir).groupBy("product_id").agg(F.max("verified_at").cast("string").alias("checked"))
    return rows.where(n.within_days(F.concat("checked", F.lit("T00:00:00Z")), 900, "2000-01-01"))


def rule_words(spark, sf_dir):
    own = {a: F.col(a) for a in ("side", "rear", "top")}
    tips = n.install_tips(own, F.when(F.col("cat") == "dryer", F.array(F.lit("Vent it."), F.lit("Vent it."))).otherwise(F.array().cast("array<string>")))
    return adapters.rules(spark, sf_dir).select("cat", "brand", n.clearance_words(own, USUAL).alias("words"), F.array_join(tips, " ").alias("tips"))


def fit_calculator(spark, sf_dir):
    k = F.col("ord")
    rows = _p(spark, sf_dir).withColumns({"h": F.when(k % 17 != 0, F.col("h")), "cw": F.when(k % 19 != 0, F.lit(701))})
    out = n.calculator({"w": F.col("cw"), "h": F.lit(1600), "d": F.lit(700)}, {a: F.col(a) for a in "whd"}, {"left": F.lit(10), "right": F.lit(20), "top": F.lit(30), "rear": F.lit(15)})
    return rows.select("id", *(c.alias(x) for x, c in out.items()))


def verified_signals(spark, sf_dir):
    k = F.col("ord")
    rows = _p(spark, sf_dir).withColumns({"verification_level": F.when(k % 3 == 0, F.lit("verified")).when(k % 3 == 1, F.lit("listed")), "has_evidence": F.when(k % 5 == 0, k % 10 == 0), "data_source": F.when(k % 7 == 0, F.lit("official_pdf")).otherwise("")})
    return rows.groupBy(n.has_signal().alias("signal"), n.is_verified_fit().alias("verified")).agg(F.count("*").alias("n"))


QUERIES = [readable_specs, slug_discovery, spec_attributes, sku_in_text, recent_checks, rule_words, fit_calculator, verified_signals]

_FEATURE = "CASE WHEN ord % 11 <> 0 THEN ['Upright', 'Built-in  under', 'front load', 'Heat Pump'][ord // 4 % 4 + 1] ELSE '' END"
_SPEC = f"""(SELECT *, {_FEATURE} AS f, CASE WHEN ord % 2 = 0 THEN (100 + ord % 700) || 'L ' ELSE '' END || CASE WHEN ord % 3 = 0 THEN (ord % 12) || '.5 kg ' ELSE '' END || CASE WHEN ord % 5 = 0 THEN '14 Place ' ELSE '' END || CASE WHEN ord % 7 = 0 THEN 'Top Mount' ELSE 'vented' END AS m FROM products)"""
_KG = r"CASE WHEN ord % 3 = 0 THEN regexp_extract(m, '([0-9]+\.[0-9]+) kg', 1) || 'kg ' ELSE '' END"
_DOOR = "CASE f WHEN 'Upright' THEN 'Upright' WHEN 'Built-in  under' THEN 'Built-in-Under' WHEN 'front load' THEN 'Front-Load' WHEN 'Heat Pump' THEN 'Heat-Pump' ELSE CASE WHEN ord % 7 = 0 THEN 'Top-Mount' ELSE 'Fridge' END END"
_D = {"side": "side - 10", "rear": "rear - 10", "top": "top - 15"}
_SAID = ", ".join(f"CASE WHEN {d} > 0 THEN 'The {w} is ' || ({d}) || 'mm {m}.' WHEN {d} < 0 THEN 'The {w} is ' || -({d}) || 'mm {l}.' END" for (d, w, m, l) in ((_D["side"], "side gap", "wider than the usual category baseline", "tighter than the usual category baseline"), (_D["rear"], "rear allowance", "deeper than the default figure", "tighter than the default figure"), (_D["top"], "top allowance", "taller than the default figure", "tighter than the default figure")))

ORACLE = {
    "readable_specs": f"""SELECT id, CASE cat WHEN 'fridge' THEN CASE WHEN ord % 2 = 0 THEN (100 + ord % 700) || 'L ' || {_DOOR} ELSE replace({_DOOR}, '-', ' ') END
        WHEN 'dishwasher' THEN CASE WHEN ord % 5 = 0 THEN '14-place Built-in' ELSE 'Built-in Dishwasher' END
        WHEN 'washing_machine' THEN {_KG} || CASE WHEN ord % 13 = 0 THEN 'Top Loader' WHEN contains(f, 'front') THEN 'Front Loader' ELSE 'Front Loader' END ELSE {_KG} || CASE WHEN f = 'Heat Pump' THEN 'Heat Pump' WHEN contains(m, 'vented') THEN 'Vented' ELSE 'Dryer' END END AS spec,
        CASE WHEN lower(brand) = 'brand#7' THEN 'Seven' ELSE lower(brand) END || ' ' || CASE WHEN ord % 4 = 1 THEN 'Series X' ELSE CASE cat WHEN 'fridge' THEN 'Fridge' WHEN 'dishwasher' THEN 'Dishwasher' WHEN 'washing_machine' THEN 'Washing Machine' ELSE 'Dryer' END END AS name FROM {_SPEC}""",
    "spec_attributes": "SELECT id, CAST(w AS VARCHAR) AS width, CASE WHEN ord % 2 = 0 THEN CAST(d AS VARCHAR) END AS depth FROM products",
    "sku_in_text": "SELECT id, ord % 3 < 2 OR FALSE AS held FROM products",
    "recent_checks": "SELECT product_id, CAST(max(verified_at) AS VARCHAR) AS checked FROM offers GROUP BY product_id HAVING abs(max(verified_at) - DATE '2000-01-01') <= 900",
    "rule_words": f"""SELECT cat, brand, CASE WHEN concat_ws(' ', {_SAID}) = '' THEN 'These figures sit close to the category baseline.' ELSE concat_ws(' ', {_SAID}) END AS words,
        array_to_string(list_filter([CASE WHEN cat = 'dryer' THEN 'Vent it.' END, CASE WHEN side > 0 THEN 'Allow at least ' || 2 * side || 'mm of total side room.' END, CASE WHEN rear > 30 THEN 'Keep ' || rear || 'mm behind the cabinet.' END, CASE WHEN top > 30 THEN 'Check for ' || top || 'mm of open space above the cabinet.' END], lambda t: t IS NOT NULL)[1:3], ' ') AS tips FROM rules""",
    "fit_calculator": """SELECT id, status, CASE WHEN status = 'fail' THEN f ELSE '' END AS failures, CASE WHEN status = 'pass' THEN 671 - w END AS spare_w, CASE WHEN status = 'pass' THEN 1570 - h END AS spare_h, CASE WHEN status = 'pass' THEN 685 - d END AS spare_d
        FROM (SELECT *, CASE WHEN ord % 17 = 0 THEN 'invalid' WHEN ord % 19 = 0 THEN 'incomplete' WHEN f <> '' THEN 'fail' ELSE 'pass' END AS status FROM (SELECT *, concat_ws(',', CASE WHEN w > 701 THEN 'width' WHEN 701 - w < 30 THEN concat_ws(',', CASE WHEN (701 - w) // 2 < 10 THEN 'left' END, CASE WHEN 701 - w - (701 - w) // 2 < 20 THEN 'right' END) END,
            CASE WHEN h > 1600 THEN 'height' WHEN 1600 - h < 30 THEN 'top' END, CASE WHEN d > 700 THEN 'depth' WHEN 700 - d < 15 THEN 'rear' END) AS f FROM products))""",
    "verified_signals": "SELECT ord % 3 < 2 OR ord % 10 = 0 OR ord % 7 = 0 AS signal, ord % 3 = 0 OR ord % 10 = 0 OR ord % 7 = 0 AS verified, count(*) AS n FROM products GROUP BY ALL",
}


def oracle() -> dict[str, str]:
    return {name: with_tables(q) for name, q in ORACLE.items()}
