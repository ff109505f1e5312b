"""Replacement: which catalog product does a text name, and which products to suggest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import by_name, is_product_url_strict, model_code, plain_words, squash
from spanfit.functions.lineage import cut
from spanfit.operators.facets import ranked
from spanfit.operators.similar import apart, contained, prefixes

#: Words after a brand that make a name say no more than the category.
GENERIC = ("fridge", "refrigerator", "dishwasher", "dryer", "washing machine", "washer")


def product_label() -> Column:
    """The display name, unless it is empty or just brand and category; else brand and model."""
    brand, model, name = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("brand", "model", "display_name"))
    plain = plain_words(brand)
    generic = (plain != "") & plain_words(name).isin(*(F.concat(plain, F.lit(f" {g}")) for g in GENERIC))
    named = F.array_join(F.filter(F.array(brand, model), lambda x: x != ""), " ")
    return F.when((name != "") & ~generic, name).when(named != "", named).otherwise(name)


def match_score() -> Column:
    """Score of a product (p_*) for a text (q_*): the first rule that holds, in this order; 0 for short texts."""
    has = F.col("p_model") != ""
    return (
        F.when(F.length("q_squashed") < 3, 0)
        .when((F.col("q_code") != "") & (F.col("q_code") == F.col("p_code")), 98)
        .when((F.length("q_code") >= 5) & (F.col("p_code") != "") & F.col("p_code").startswith(F.col("q_code")), 96)
        .when((F.length("q_code") >= 5) & has & F.col("p_model").startswith(F.col("q_code")), 94)
        .when(has & (F.col("p_model") == F.col("q_squashed")), 100)
        .when(has & F.contains("q_squashed", "p_model"), 95)
        .when(has & F.contains("p_model", "q_squashed"), 90)
        .when(F.contains("p_brand_model", "q_words"), 84)
        .when(F.contains("p_name", "q_words"), 78)
        .when(F.contains("p_label", "q_words"), 70)
        .otherwise(0)
    )


def confidence(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 75, "medium").otherwise("low")


def best_sources(asked: DataFrame, products: DataFrame, cat: str | None = None, verified_only: bool = False) -> DataFrame:
    """Of each text (ask, text): ask, id of the product that scores best (then by label), score, confidence.

    cat: products of that category only; verified_only: products with a verified link (column `verified`) only. Candidates of
    each rule meet on equal codes, on prefixes or on the rarest gram of what must be contained.
    """
    texts = asked.select("ask", squash(F.col("text")).alias("q_squashed"), plain_words(F.col("text")).alias("q_words"), model_code(F.col("text")).alias("q_code")).where(F.length("q_squashed") >= 3)
    pool = products.where(F.col("cat") == cat) if cat else products
    pool = pool.where("verified") if verified_only else pool
    label = product_label()
    rows = pool.select("id", "ord", label.alias("label"), squash(F.col("model")).alias("p_model"), model_code(F.col("model")).alias("p_code"), plain_words(F.concat_ws(" ", "brand", "model")).alias("p_brand_model"), plain_words(F.col("display_name")).alias("p_name"), plain_words(label).alias("p_label"))
    begun = F.explode(F.array_distinct(F.filter(F.concat(F.array("p_code"), prefixes(F.col("p_code"), 5), prefixes(F.col("p_model"), 5)), lambda x: x != "")))

    def best_of(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        scored = apart(apart(pairs.distinct()).join(apart(asked), "ask")).join(apart(rows), "id").withColumn("score", match_score()).where("score > 0")
        return scored.groupBy("ask").agg(F.min(F.struct((-F.col("score")).alias("worse"), by_name(F.col("label"), base=True).alias("label"), "ord", "id")).alias("best"))

    met = [
        apart(rows.select("id", begun.alias("code"))).join(apart(texts.where("q_code <> ''").select("ask", F.col("q_code").alias("code"))), "code"),
        contained(rows.select("id", "p_model"), texts.select("ask", "q_squashed"), "p_model", "q_squashed"),
        contained(texts.select("ask", "q_squashed"), rows.select("id", "p_model"), "q_squashed", "p_model"),
    ]
    # Codes and models score best and all such pairs are met here; names are asked of the other texts alone.
    sure = cut(best_of(reduce(DataFrame.unionByName, (x.select("ask", "id") for x in met)), texts).where("best.worse <= -90"))
    others = cut(apart(texts).join(apart(sure.select("ask")), "ask", "left_anti"))
    named = [contained(others.select("ask", "q_words"), rows.select("id", c), "q_words", c).select("ask", "id") for c in ("p_brand_model", "p_name", "p_label")]
    best = sure.unionByName(best_of(reduce(DataFrame.unionByName, named), others))
    score = -F.col("best.worse")
    return best.select("ask", F.col("best.id").alias("id"), score.cast("int").alias("score"), confidence(score).alias("confidence"))


def suggestions(catalog: DataFrame, cat: str, most: int = 160) -> DataFrame:
    """Products of a category with a name, verified links and whole dimensions: most links first, then priority, then by label."""
    n = F.size(F.filter("retailers", lambda r: is_product_url_strict(r["url"]))).cast("long")
    named = (F.coalesce("model", F.lit("")) != "") | (F.coalesce("display_name", F.lit("")) != "")
    rows = catalog.where((F.col("cat") == cat) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("d") > 0) & named).withColumns({"n_strict": n, "label": product_label()}).where("n_strict > 0")
    return ranked(rows, [F.desc("n_strict"), F.coalesce("priority", F.lit(0)).desc(), by_name(F.col("label"), base=True).asc(), F.asc("ord")], most=most)
