"""Facet filters and counts, availability gate and sort orders over a pool of matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfit.functions.columns import fold, is_product_url_lenient, js_round
from spanfit.operators.fit import best_first


@dataclass(frozen=True)
class Facets:
    brands: tuple[str, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    stars: float | None = None
    available_only: bool = False


def is_current() -> Column:
    """Not marked unavailable, with at least one link to a product page."""
    return F.coalesce(~F.col("unavailable"), F.lit(False)) & F.exists("retailers", lambda r: is_product_url_lenient(r["url"]))


def apply_facets(pool: DataFrame, f: Facets) -> DataFrame:
    """Brand, price, stars and availability. A null price counts as 0 against the bounds, null stars as 0."""
    rows = pool
    if f.brands:
        rows = rows.where(fold(F.col("brand")).isin(*(" ".join(b.lower().split()) for b in f.brands)))
    price = F.coalesce("price", F.lit(0))
    if f.price_min is not None:
        rows = rows.where(price >= f.price_min)
    if f.price_max is not None:
        rows = rows.where(price <= f.price_max)
    if f.stars is not None:
        rows = rows.where(F.coalesce("stars", F.lit(0)) >= f.stars)
    return rows.where("current") if f.available_only else rows


def facet_counts(pool: DataFrame) -> DataFrame:
    """facet, value, n: brands, rounded stars, and the two scalars, in one pass over the pool."""
    keyed = pool.select(F.nullif(F.trim("brand"), F.lit("")).alias("brand"), js_round(F.coalesce("stars", F.lit(0)).cast("double")).cast("string").alias("stars"), F.when(F.col("current"), "current").alias("available"), F.lit("priced").alias("priced"))
    pairs = keyed.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in keyed.columns))).alias("x")).select("x.*")
    return pairs.where(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))


def order_for(sort: str) -> list[Column]:
    """Sort keys: best-fit, price-asc, price-desc, popularity, stars; products without price last either way."""
    first = {"price-asc": [F.asc_nulls_last("price")], "price-desc": [F.desc_nulls_last("price")], "popularity": [F.coalesce("priority", F.lit(0)).desc()], "stars": [F.coalesce("stars", F.lit(0)).desc()]}
    return [*first.get(sort, []), *best_first()]


def rating_order(sort: str) -> list[Column]:
    """Sort keys of the rating table: score (null last), price, stars or brand first, then the score."""
    score = [F.coalesce("fit_score_numeric", F.lit(-1)).desc(), *best_first()]
    first = {"price-asc": [F.asc_nulls_last("price")], "price-desc": [F.desc_nulls_last("price")], "stars": [F.coalesce("stars", F.lit(0)).desc()], "brand": [F.asc("brand")], "verified-first": [F.desc("verified")]}
    return [*first.get(sort, []), *score]


def range_filter(rows: DataFrame, bounds: dict[str, tuple[float | None, float | None]], score_min: float | None = None, verified_only: bool = False) -> DataFrame:
    """Sliders: a null fails any bound. verified_only is void where no row of the pool has a verification."""
    out = rows
    for c, (low, high) in bounds.items():
        if low is not None:
            out = out.where(F.col(c) >= low)
        if high is not None:
            out = out.where(F.col(c) <= high)
    if score_min is not None:
        out = out.where(F.col("fit_score_numeric") >= score_min)
    if verified_only:
        some = rows.agg(F.coalesce(F.max("verified"), F.lit(False)).alias("some_verified"))
        out = out.crossJoin(F.broadcast(some)).where("verified or not some_verified").drop("some_verified")  # one row
    return out


def ranked(rows: DataFrame, keys: list[Column], by: list[str] | None = None, most: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered in order of keys within `by`, at most `most` each; without `by` the few best alone are numbered."""
    if not by:
        rows = rows.orderBy(*keys).limit(most)
    out = rows.withColumn(name, F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*keys)).cast("int"))
    return out if most is None or not by else out.where(F.col(name) <= most)
