"""Many searches answered in one plan: a log of cavities against the catalog (Q-S1, Q-S6, Q-S7).

What decides a search is what each product needs: its size and the clearance of the search's mode. So products are listed
by what they need in each mode, in a grid of width, height and depth buckets, and searches of equal content are one. Of each
grid cell its extremes and its number of products are known; they bound the score of every product in it. The cells that
surely hold enough products give a score that the last one shown cannot exceed, and only cells that can do as well are
visited. Searches meet sizes on equal cells, so none is compared with a cavity that it is far from, and products only of
those sizes that hold the best: the work grows with the different sizes, however many products share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfit.functions.lineage import cut
from spanfit.operators.facets import ranked
from spanfit.operators.fit import AXES, MODES, best_first, is_tower, replacement_dimensions, resolve_clearance
from spanfit.operators.replacement import best_sources
from spanfit.operators.session import empty_state
from spanfit.operators.similar import apart, dealt

#: mm of a bucket on each axis, buckets of an axis (what is larger is in the last one), and results shown.
STEPS, BUCKETS, SHOWN = {"w": 50, "h": 100, "d": 50}, 16, 60
ANY = "*"
SHAPE = ["scope", "towers", "w", "h", "d"]


def needs(products: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """scope (mode and category, or mode and `*`), id, tower, need_w, need_h, need_d and what orders equal scores; products without whole sizes fit nowhere by the axes that they lack."""
    tower = is_tower(products)
    rows = []
    for mode in ("physical", "practical", *(["manufacturer"] if rules is not None else [])):
        taken = {"w": F.col("clear_side") * 2, "h": F.col("clear_top"), "d": F.col("clear_rear")}
        each = resolve_clearance(products, mode, rules)
        rows.append(each.select(F.lit(mode).alias("mode"), "cat", tower.alias("tower"), "id", "ord", "priority", "brand", "display_name", *((F.col(a) + taken[a]).cast("int").alias(f"need_{a}") for a in AXES)))
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    groups = F.array_compact(F.array(F.lit(ANY), F.when(~F.col("tower") | (F.col("cat") != "washtower_combo"), F.col("cat")), F.when(F.col("tower"), F.lit("washtower_combo"))))
    return both.withColumn("scope", F.explode(F.transform(groups, lambda g: F.concat_ws("|", "mode", g)))).drop("mode", "cat").withColumn("cell", _cell())


def leading(needed: DataFrame, most: int) -> DataFrame:
    """Of the products that need the same on every axis (one `size`), the `most` that come first, numbered by nth: such products score alike in every search, so no others can be among its best `most`."""
    size = F.concat_ws(",", F.col("tower").cast("string"), *(F.coalesce(F.col(f"need_{a}").cast("string"), F.lit("-")) for a in AXES))
    return ranked(needed.withColumn("size", size), best_first()[1:], ["scope", "size"], most, "nth")


def _cell() -> Column:
    """The number of a product's cell: buckets of the three axes; a missing size counts as bucket 0 and never fits."""
    k = F.lit(0)
    for a in AXES:
        k = k * BUCKETS + F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.coalesce(F.floor(F.col(f"need_{a}") / STEPS[a]), F.lit(0)))).cast("int")
    return k.cast("int")


def grid(needed: DataFrame) -> DataFrame:
    """One row per scope: its cells (at most 2 * BUCKETS^3) with their number of products and least and greatest needs."""
    cells = needed.groupBy("scope", "cell", "tower").agg(F.count(F.when(F.expr("need_w is not null and need_h is not null and need_d is not null"), 1)).alias("n"), *(f(f"need_{a}").alias(f"{k}_{a}") for a in AXES for k, f in (("least", F.min), ("most", F.max))))
    return cells.groupBy("scope").agg(F.collect_list(F.struct("cell", "tower", "n", *(f"{k}_{a}" for a in AXES for k in ("least", "most")))).alias("cells"))


def searched(searches: DataFrame) -> DataFrame:
    """From (cat, w, h, d, mode; search_mode and source_cat for replacement) the columns of SHAPE. Replacement takes products bare; towers replace towers, and never a washer or a dryer."""
    replacing = F.coalesce(F.col("search_mode") == "replacement", F.lit(False)) if "search_mode" in searches.columns else F.lit(False)
    source = F.col("source_cat") if "source_cat" in searches.columns else F.lit(None).cast("string")
    mode = F.when(replacing, "physical").otherwise(F.col("mode"))
    towers = F.when(replacing & (source == "washtower_combo"), "only").when(replacing & source.isin("washing_machine", "dryer"), "none").otherwise("any")
    return searches.withColumns({"scope": F.concat_ws("|", mode, F.coalesce("cat", F.lit(ANY))), "towers": towers})


def _slack(size: Column, need: Column) -> Column:
    """An axis' score: the share of the cavity that stays free, held within -0.05 and 0.5; null for an axis that is not given."""
    return F.greatest(F.lit(-0.05), F.least(F.lit(0.5), (size - need) / size.cast("double")))


def _mean(parts: dict[str, Column]) -> Column:
    """The mean over the axes that are given, added in their order."""
    total, n = F.lit(0.0), F.lit(0)
    for a, p in parts.items():
        total, n = total + F.when(F.col(a).isNotNull(), p).otherwise(0.0), n + F.col(a).isNotNull().cast("int")
    return total / n.cast("double")


def _visits(most: int) -> Column:
    """Cells that can hold one of the best `most`: from the bounds of each cell's score."""

    def fits(x: Column, k: str) -> Column:
        test = F.lit(True)
        for a in AXES:
            test = test & (F.col(a).isNull() | F.coalesce(x[f"{k}_{a}"] <= F.col(a), F.lit(False)))
        return test

    tower = lambda x: (F.col("towers") == "any") | (x["tower"] == (F.col("towers") == "only"))
    some = F.filter("cells", lambda x: fits(x, "least") & tower(x))
    bounds = F.transform(
        some,
        lambda x: F.struct(
            _mean({a: _slack(F.col(a), x[f"least_{a}"]) for a in AXES}).alias("worst"), _mean({a: F.greatest(F.lit(0.0), _slack(F.col(a), x[f"most_{a}"])) for a in AXES}).alias("best"), x["cell"].alias("cell"), F.when(fits(x, "most"), x["n"]).otherwise(F.lit(0)).cast("long").alias("n")
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("limit"))
    step = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.when((acc["n"] < most) & (acc["n"] + x["n"] >= most), x["worst"]).otherwise(acc["limit"]).alias("limit"))
    reached = F.aggregate(F.array_sort(bounds), start, step)["limit"]
    return F.transform(F.array(F.struct(bounds.alias("all"), reached.alias("limit"))), lambda y: F.transform(F.filter(y["all"], lambda x: x["best"] <= y["limit"]), lambda x: x["cell"]))[0]


def batch_matches(searches: DataFrame, products: DataFrame, rules: DataFrame | None = None, limit: int = SHOWN) -> DataFrame:
    """For each different search (columns of SHAPE): rank, id, sort_score, fit_score of its best matches; searches without a match or a size have no row."""
    needed = cut(leading(needs(products, rules), limit))
    sizes = needed.groupBy("scope", "cell", "size", "tower", *(f"need_{a}" for a in AXES)).agg(F.max("nth").alias("n"), F.min_by(F.struct("priority", "display_name", "brand", "ord"), "nth").alias("first"))
    shapes = searched(searches).where("w is not null or h is not null or d is not null").select(*SHAPE).distinct()
    visited = dealt(shapes, *SHAPE).join(grid(needed), "scope").select(*SHAPE, F.explode(F.array_distinct(_visits(limit))).alias("cell"))
    met = apart(visited).join(apart(sizes), ["scope", "cell"])
    for a in AXES:
        met = met.where(F.col(a).isNull() | (F.col(f"need_{a}") <= F.col(a)))
    met = met.where((F.col("towers") == "any") | (F.col("tower") == (F.col("towers") == "only")))
    slack = {a: _slack(F.col(a), F.col(f"need_{a}")) for a in AXES}
    met = met.select(*SHAPE, "size", "n", "first.*", _mean(slack).alias("sort_score"), F.least(*(F.when(F.col(a).isNotNull(), slack[a]) for a in AXES)).alias("fit_score"))
    # A size that comes after `limit` others by their first products, or after `limit` products of better scores, has none of the best.
    near, score = ranked(met, best_first(), SHAPE, limit, "nth"), Window.partitionBy(*SHAPE).orderBy("sort_score")
    better = F.sum("n").over(score.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("n").over(Window.partitionBy(*SHAPE, "sort_score"))
    taken = near.withColumn("better", better).where(F.col("better") < limit).select(*SHAPE, "size", "sort_score", "fit_score")
    found = apart(taken).join(apart(needed.select("scope", "size", "id", "priority", "display_name", "brand", "ord")), ["scope", "size"])
    return ranked(found, best_first(), SHAPE, limit).select(*SHAPE, "rank", "id", "sort_score", "fit_score")


def batch_answers(searches: DataFrame, products: DataFrame, label: Column, rules: DataFrame | None = None, limit: int = SHOWN, key: str = "search_id") -> DataFrame:
    """One row per search: exact and relaxed counts as shown (at most `limit`; tolerance admits nothing that clearance forbids, so both are equal), ids of the best three, title, detail, action."""
    best = batch_matches(searches, products, rules, limit).groupBy(*SHAPE).agg(F.count("*").alias("shown"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "id")))).alias("top"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in SHAPE]
    test = same[0]
    for s in same[1:]:
        test = test & s
    rows = searched(searches).alias("s").join(best.alias("b"), test, "left").select("s.*", F.coalesce("b.shown", F.lit(0)).alias("exact"), F.array_join(F.transform(F.coalesce("b.top", F.array().cast("array<struct<rank:int,id:string>>")), lambda x: x["id"]), ",").alias("best"))
    said = empty_state(F.col("exact"), F.col("exact"), F.regexp_replace(F.col("tolerance").cast("string"), r"\.0$", ""), label)
    return rows.select(key, "exact", F.col("exact").alias("relaxed"), "best", *(c.alias(n) for n, c in said.items()))


def replacement_runs(asked: DataFrame, products: DataFrame, limit: int = SHOWN) -> DataFrame:
    """Each text (ask, text) through the whole run: the product it names, the cavity that one leaves (with its buffer), and what of its category fits there. ask, source, confidence, w, h, d, rank, id; a text without a source, and a source without sizes or fits, end where they end, with nulls."""
    sources = best_sources(asked, products).select("ask", F.col("id").alias("source"), "confidence")
    sized = products.select(F.col("id").alias("source"), "cat", F.when(is_tower(products), "washtower_combo").otherwise(F.col("cat")).alias("source_cat"), *(c.alias(n) for n, c in replacement_dimensions().items()))
    runs = asked.select("ask").join(sources, "ask", "left").join(sized, "source", "left").select("ask", "source", "confidence", "cat", "source_cat", *(F.col(f"cavity_{a}").alias(a) for a in AXES), F.lit("practical").alias("mode"), F.lit("replacement").alias("search_mode"))
    known = searched(runs)
    best = batch_matches(runs.where("source is not null"), products, limit=limit).withColumnsRenamed({c: f"b_{c}" for c in SHAPE})
    test = F.lit(True)
    for c in SHAPE:
        test = test & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return known.join(best, test, "left").select("ask", "source", "confidence", *AXES, "rank", "id")
