"""Page and pair selection: range counts over width spines, brand pairs, top-N picks, neighbours, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanfit.functions.columns import by_name
from spanfit.operators.facets import ranked
from spanfit.operators.fit import width_verdict
from spanfit.operators.similar import apart, dealt

WIDTHS = (500, 1100, 10)
DOORWAYS = (600, 900, 10)
CHECK_WIDTHS = (540, 580, 600, 620, 650, 700, 800, 900)


def spine(spark: SparkSession, low: int, high: int, step: int) -> DataFrame:
    return spark.range(low, high + 1, step).select(F.col("id").cast("int").alias("width"))


def bucket(need: Column, low: int, step: int) -> Column:
    """First step of the spine that is at least need."""
    return F.greatest(F.lit(low), (F.ceil(need / step) * step)).cast("int")


def range_counts(needs: DataFrame, low: int, high: int, step: int) -> DataFrame:
    """width, n: rows whose need is at most the width. One count per bucket and a running sum, no range join."""
    counted = needs.select(bucket(F.col("need"), low, step).alias("width")).groupBy("width").agg(F.count("*").alias("k"))
    steps = spine(needs.sparkSession, low, high, step).join(F.broadcast(counted.where(F.col("width") <= high)), "width", "left")  # at most one row a step
    return steps.select("width", F.sum(F.coalesce("k", F.lit(0))).over(Window.orderBy("width")).cast("long").alias("n"))


def range_top(needs: DataFrame, keys: list[Column], most: int, low: int, high: int, step: int) -> DataFrame:
    """The best rows of each width: the best of each bucket hold the best of every union of buckets, so only those meet the spine."""
    few = ranked(needs.withColumn("step", bucket(F.col("need"), low, step)).where(F.col("step") <= high), keys, ["step"], most)
    return ranked(spine(needs.sparkSession, low, high, step).join(few.drop("rank"), F.col("step") <= F.col("width")), keys, ["width"], most)


def fridge_needs(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Fridges with the cavity width they need by their brand's side clearance (20 without a rule)."""
    side = rules.where("cat = 'fridge'").select(F.col("brand").alias("rule_brand"), "side")
    rows = products.where("cat = 'fridge'").join(side, F.col("brand") == F.col("rule_brand"), "left")
    return rows.withColumn("need", F.col("w") + 2 * F.coalesce("side", F.lit(20))).drop("rule_brand", "side")


def range_brands(needs: DataFrame, most: int, low: int, high: int, step: int) -> DataFrame:
    """The brands with most rows at each width: counts by (bucket, brand), summed along the spine."""
    counted = needs.withColumn("step", bucket(F.col("need"), low, step)).groupBy("step", "brand").agg(F.count("*").alias("k"))
    at = spine(needs.sparkSession, low, high, step).join(counted, F.col("step") <= F.col("width")).groupBy("width", "brand").agg(F.sum("k").alias("n"))
    return ranked(at, [F.desc("n"), F.asc("brand")], ["width"], most)


def brand_ranking(products: DataFrame) -> DataFrame:
    counts = products.groupBy("cat", "brand").agg(F.count("*").alias("n"))
    return ranked(counts, [F.desc("n"), F.asc("brand")], ["cat"])


def offered(catalog: DataFrame) -> Column:
    """Whether a product has an offer: by their number, where the catalog has it, or by the nested ones."""
    return F.col("n_offers") > 0 if "n_offers" in catalog.columns else F.size("retailers") > 0


def pair_score(linked: Column) -> Column:
    """A product's weight in pair selection."""
    return F.when(linked, 10000).otherwise(0) + F.when(~F.col("unavailable"), 5000).otherwise(0) + F.coalesce("priority", F.lit(0)) + F.coalesce("stars", F.lit(0)) * 10


def brand_ranking_by_links(catalog: DataFrame) -> DataFrame:
    rows = catalog.withColumns({"score": pair_score(offered(catalog)), "linked": offered(catalog)})
    best = F.min(F.struct((-F.col("score")).alias("worse"), "model", "linked"))
    per = rows.groupBy("cat", "brand").agg(F.count("*").alias("n"), F.count(F.when(F.col("linked"), 1)).alias("n_linked"), F.max("score").alias("best_score"), best.alias("best"))
    return ranked(per.withColumn("best_linked", F.col("best.linked")).drop("best"), [F.desc("n_linked"), F.desc("n"), F.desc("best_score"), F.asc("brand")], ["cat"])


def comparison_pairs(catalog: DataFrame, rules: DataFrame, brands: int = 8, least_models: int = 3, most: int = 10) -> DataFrame:
    """Pairs of a category's leading brands, each with enough models and a rule, one of them with a link."""
    linked = catalog.groupBy("cat", "brand").agg(F.max("current_link").alias("linked"))
    ok = brand_ranking(catalog).where(F.col("rank") <= brands).where(F.col("n") >= least_models).join(rules.select("cat", "brand").distinct(), ["cat", "brand"], "left_semi").join(linked, ["cat", "brand"])
    a, b = (ok.select("cat", *(F.col(c).alias(f"{c}_{s}") for c in ("brand", "n", "rank", "linked"))) for s in "ab")
    pairs = a.join(b, "cat").where("rank_a < rank_b and (linked_a or linked_b)")
    keys = [(F.col("rank_a") + F.col("rank_b")).asc(), (F.col("n_a") + F.col("n_b")).desc(), F.asc("brand_a"), F.asc("brand_b")]
    return ranked(pairs, keys, ["cat"], most).select("cat", "rank", "brand_a", "brand_b", "n_a", "n_b")


def seeded_pairs(catalog: DataFrame, seeds: int = 5, brands: int = 12, most: int = 100) -> DataFrame:
    """All pairs of each category's first brands, then pairs of more brands, while there is room; a best product must be linked."""
    r = brand_ranking_by_links(catalog).where(F.col("rank") <= brands)
    a, b = (r.select("cat", F.col("brand").alias(f"brand_{s}"), F.col("rank").alias(f"rank_{s}"), F.col("best_linked").alias(f"linked_{s}")) for s in "ab")
    pairs = a.join(b, "cat").where("rank_a < rank_b and (linked_a or linked_b)").withColumn("extra", F.col("rank_b") > seeds)
    order = F.element_at(F.create_map(*(x for k, c in enumerate(("fridge", "dishwasher", "dryer", "washing_machine")) for x in (F.lit(c), F.lit(k)))), F.col("cat"))
    return pairs.orderBy("extra", order, "rank_a", "rank_b").limit(most).select("cat", "brand_a", "brand_b", "extra")


def related_pairs(pairs: DataFrame, most: int = 8) -> DataFrame:
    """For each pair, others of its category: those with a brand in common first, then by number of models."""
    rows = pairs.withColumn("slug", F.concat_ws("-vs-", "brand_a", "brand_b"))
    other = rows.select("cat", *(F.col(c).alias(f"o_{c}") for c in ("brand_a", "brand_b", "n_a", "n_b", "slug")))
    both = rows.join(other, "cat").where("slug <> o_slug").withColumn("shared", F.arrays_overlap(F.array("brand_a", "brand_b"), F.array("o_brand_a", "o_brand_b")))
    return ranked(both, [F.desc("shared"), (F.col("o_n_a") + F.col("o_n_b")).desc(), F.asc("o_slug")], ["cat", "slug"], most).select("cat", "slug", "rank", F.col("o_slug").alias("related"))


def check_combinations(products: DataFrame, top: int = 200) -> DataFrame:
    """The first products by priority with each cavity width: ord, id, width, gap, verdict."""
    few = ranked(products.where("w > 0"), [F.coalesce("priority", F.lit(0)).desc(), by_name(F.col("display_name")).asc(), F.asc("ord")], most=top, name="place")
    rows = few.withColumn("width", F.explode(F.array(*map(F.lit, CHECK_WIDTHS))))
    return rows.withColumns(width_verdict(F.col("width")))


def review_sample(combinations: DataFrame) -> DataFrame:
    """5 perfect, 3 tight and 2 no-fit combinations: products not yet seen first, in order."""
    seen = F.row_number().over(Window.partitionBy("verdict", "id").orderBy("place", "width"))
    rows = ranked(combinations.withColumn("again", (seen > 1).cast("int")), [F.asc("again"), F.asc("place"), F.asc("width")], ["verdict"])
    quota = F.element_at(F.create_map(F.lit("perfect"), F.lit(5), F.lit("tight"), F.lit(3), F.lit("no-fit"), F.lit(2)), F.col("verdict"))
    return rows.where(F.col("rank") <= F.coalesce(quota, F.lit(0))).select("verdict", "rank", "id", "width", "gap")


def alternatives(asked: DataFrame, products: DataFrame, width: int, most: int = 3) -> DataFrame:
    """Available products of the same category with a gap of 5 mm or more, nearest to 20 mm.

    Per category the `most + 1` best are enough whatever product asks, so those alone are joined.
    """
    rows = products.where(~F.col("unavailable")).withColumns(width_verdict(F.lit(width))).where("gap >= 5")
    keys = [F.abs(F.col("gap") - 20).asc(), F.coalesce("priority", F.lit(0)).desc(), by_name(F.col("display_name")).asc(), F.asc("ord")]
    best = ranked(rows, keys, ["cat"], most + 1).select("cat", F.col("id").alias("alternative"), "gap", F.col("rank").alias("place"))
    both = asked.select("id", "cat").join(F.broadcast(best), "cat").where("id <> alternative")  # a few rows for each category
    return ranked(both, [F.asc("place")], ["id"], most).select("id", "rank", "alternative", "gap")


def chassis_candidates(asked: DataFrame, pending: DataFrame, tolerance: int = 5) -> DataFrame:
    """Products of the same brand and category within `tolerance` mm of width: a band join on width bands, whose few bytes are dealt to all tasks, as what they make is much more."""
    size = tolerance + 1
    a = asked.select("id", "cat", "brand", F.col("w").alias("asked_w"), F.explode(F.sequence(F.floor(F.col("w") / size) - 1, F.floor(F.col("w") / size) + 1)).alias("band"))
    b = pending.select("cat", "brand", F.col("id").alias("candidate"), "w", F.floor(F.col("w") / size).alias("band"))
    by = ["cat", "brand", "band"]
    return apart(dealt(a, *by)).join(apart(dealt(b, *by)), by).where((F.abs(F.col("w") - F.col("asked_w")) <= tolerance) & (F.col("id") != F.col("candidate"))).select("id", "candidate", "w")


def neighbours(widths: DataFrame) -> DataFrame:
    """The next smaller and larger of each width; widths are distinct mm, a few thousand at most."""
    w = Window.orderBy("width")
    return widths.select("width", F.lag("width").over(w).alias("previous"), F.lead("width").over(w).alias("next"))


def nearest_widths(widths: DataFrame, most: int = 8) -> DataFrame:
    """The nearest others of each width: they stand among the `most` before and after it."""
    w = Window.orderBy("width").rowsBetween(-most, most)
    near = widths.withColumn("near", F.collect_list("width").over(w)).select("width", F.explode("near").alias("other")).where("other <> width")
    return ranked(near, [F.abs(F.col("other") - F.col("width")).asc(), F.asc("other")], ["width"], most)


def cheapest_offer(offers: DataFrame) -> DataFrame:
    """The cheapest offer of each product (no price last), then by name."""
    price = F.coalesce(F.when(F.col("p") > 0, F.col("p")), F.lit(2**31 - 1))
    best = F.min(F.struct(price.alias("price"), F.lower("n").alias("name"), "pos", "n", "url"))
    return offers.groupBy("product_id").agg(best.alias("x")).select("product_id", F.col("x.n").alias("n"), F.col("x.price").alias("price"), F.col("x.url").alias("url"))


def quota_pick(products: DataFrame, quota: dict[str, int]) -> DataFrame:
    q = F.element_at(F.create_map(*(F.lit(x) for pair in quota.items() for x in pair)), F.col("cat"))
    keys = [F.coalesce("priority", F.lit(0)).desc(), F.coalesce("stars", F.lit(0)).desc(), F.asc("ord")]
    rows = ranked(products, keys, ["cat"], max(quota.values(), default=0))  # a literal, so each task hands on no more
    return rows.where(F.col("rank") <= F.coalesce(q, F.lit(0)))


def latest_per_key(events: DataFrame, owner: str, key: str, most: int) -> DataFrame:
    """Of each owner, the latest event of each key, at most `most` keys, newest first."""
    last = events.groupBy(owner, key).agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return ranked(last.select(owner, key, F.col("x.ts").alias("ts"), F.col("x.event_id").alias("event_id")), [F.desc("ts"), F.desc("event_id")], [owner], most)


def round_robin(rows: DataFrame, group: str, quotas: dict[str, int], total: int) -> DataFrame:
    """Quotas of each group in order, filled up with what is left in order to `total`.

    Each group's first rows are cut by the largest quota, a literal; of all others only the first can be needed.
    """
    q = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col(group)), F.lit(0))
    picked = ranked(rows, [F.asc("ord")], [group], max(quotas.values(), default=0)).where(F.col("rank") <= q).drop("rank").withColumn("left_over", F.lit(False))
    first = rows.orderBy("ord").limit(total + sum(quotas.values())).join(picked.select(F.col("ord").alias("_taken")), F.col("ord") == F.col("_taken"), "left_anti")
    return picked.unionByName(first.withColumn("left_over", F.lit(True))).orderBy("left_over", "ord").limit(total)


def page(rows: DataFrame, keys: list[Column], cursor: int, size: int) -> DataFrame:
    """Rows cursor + 1 to cursor + size in order."""
    return ranked(rows, keys, most=cursor + size).where(F.col("rank") > cursor)


def _clusters(tolerance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        left = pdf.sort_values(["w", "ord"])
        while len(left):
            near = left[(left.w - left.w.iloc[0]).abs() <= tolerance]
            out.append((near.brand.iloc[0], int(near.w.iloc[0]), len(near), int(near.w.min()), int(near.w.max()), float(near.w.median())))
            left = left.drop(near.index)
        return pd.DataFrame(out, columns=["brand", "seed_w", "n", "least_w", "most_w", "median_w"])

    return run


def width_clusters(products: DataFrame, tolerance: int = 5) -> DataFrame:
    """Greedy clusters of a brand's widths, narrowest seed first. Sequential by nature; distinct widths of a brand bound a group."""
    few = products.groupBy("brand", "w").agg(F.min("ord").alias("ord"))
    return few.groupBy("brand").applyInPandas(_clusters(tolerance), "brand string, seed_w int, n long, least_w int, most_w int, median_w double")


def feed(parts: Iterator[tuple[DataFrame, int]], most: int = 50) -> DataFrame:
    """Items (title, url) of several sources with a fixed score each, best first."""
    rows = None
    for df, score in parts:
        own = df.select("title", "url").withColumn("score", F.lit(score))
        rows = own if rows is None else rows.unionByName(own)
    return rows.orderBy(F.desc("score"), F.asc("title")).limit(most)
