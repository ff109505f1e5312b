"""The logical tables (products, rules, offers, rum, errors, search-console rows) over the driver's tables.

Each is deterministic, so a SQL engine over the same files gives the same rows; SQL texts of them stand in
`plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("fridge", "washing_machine", "dishwasher", "dryer")
#: Retailer names by supplier key modulo 6; the last stands for the supplier's own name.
RETAILERS = ("JB Hi-Fi", "Appliances Online", "Harvey Norman", "The Good Guys", "Bing Lee")

#: Line items of a part when they are dealt.
LINES = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(x: Column) -> Column:
    return x.cast("int")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, cat, brand, model, display_name, type, w, h, d, stars, price, unavailable, priority, rated."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("ord"),
        F.concat(F.lit("p"), k.cast("string")).alias("id"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), _int(k % 4) + 1).alias("cat"),
        F.col("p_brand").alias("brand"),
        F.concat("p_name", F.lit(" "), k.cast("string")).alias("model"),
        F.concat("p_brand", F.lit(" "), "p_name").alias("display_name"),
        F.col("p_type").alias("type"),
        _int(450 + (k * 37) % 500).alias("w"),
        _int(800 + (k * 53) % 1200).alias("h"),
        _int(500 + (k * 29) % 300).alias("d"),
        (1 + F.col("p_size") % 6).alias("stars"),
        F.when(k % 5 != 0, _int(F.floor("p_retailprice"))).alias("price"),
        (k % 3 == 0).alias("unavailable"),
        _int((k * 7) % 101).alias("priority"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance rules: cat, brand, side, rear, top; brands whose number is a multiple of 4 have none."""
    n = F.substring("brand", 7, 9).try_cast("int")
    rows = products(spark, sf_dir).select("cat", "brand").distinct().withColumn("n", n).where("n % 4 <> 0")
    return rows.select("cat", "brand", _int(5 * (F.col("n") % 5)).alias("side"), _int(10 * (F.col("n") % 3)).alias("rear"), _int(15 * (F.col("n") % 4)).alias("top"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, pos, n, url, p, verified_at: one row per product and supplier that share a line item.

    Line items are dealt once, by product, in parts whose number grows with the table: what is asked of a product then
    stays where its offers are, and no task holds more as the table grows. (Pairs hardly repeat, so counting before the deal would only fill memory.)
    """
    s = F.col("l_suppkey")
    item = F.col("l_partkey").cast("string")
    lines = read(spark, sf_dir, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, 1 + lines.count() // LINES)  # counted by the footers
    dealt = lines.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", F.concat(F.lit("p"), item).alias("product_id")).repartition(parts, "product_id")
    each = dealt.groupBy("product_id", "l_partkey", "l_suppkey").agg(F.floor(F.min(F.col("l_extendedprice") / F.col("l_quantity"))).cast("int").alias("p"), F.max("l_shipdate").cast("date").alias("verified_at"))
    named = each.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == s)
    case = s % 6
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, RETAILERS)), _int(case) + 1), F.col("s_name"))
    url = (
        F.when(case == 0, F.concat(F.lit("https://www.jbhifi.com.au/products/item-"), item))
        .when(case == 1, F.concat(F.lit("https://www.appliancesonline.com.au/product/item-"), item, F.lit("/")))
        .when(case == 2, F.concat(F.lit("https://www.harveynorman.com.au/item-"), item, F.lit(".html")))
        .when(case == 3, F.concat(F.lit("https://www.thegoodguys.com.au/item-"), item))
        .when(case == 4, F.concat(F.lit("https://www.binglee.com.au/search?q=item"), item))
        .otherwise(F.concat(F.lit("https://shop.example.org/appliance/"), item))
    )
    return named.select("product_id", s.alias("pos"), name.alias("n"), url.alias("url"), "p", "verified_at")


def with_retailers(catalog: DataFrame, offer_rows: DataFrame) -> DataFrame:
    """catalog with its offers as the array `retailers`, in order of pos."""
    nested = offer_rows.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "url", "p", "verified_at"))).alias("retailers"))
    empty = F.array().cast(nested.schema["retailers"].dataType)
    return catalog.join(nested, F.col("id") == F.col("product_id"), "left").drop("product_id").withColumn("retailers", F.coalesce("retailers", empty))


def rum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-vital events: metric, path, value, ts, event_id."""
    kind = F.create_map(*(F.lit(x) for pair in (("view", "LCP"), ("click", "INP"), ("purchase", "CLS"), ("signup", "TTFB")) for x in pair))
    return read(spark, sf_dir, "events").select(F.try_element_at(kind, F.col("event_type")).alias("metric"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), "value", F.col("ts").cast("timestamp").alias("ts"), "event_id")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events: message, source, line, ts, user_id, event_id."""
    number = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.concat(F.lit("E"), number).alias("message"), F.concat(F.lit("/s/"), F.col("user_id").cast("string"), F.lit(".js")).alias("source"), F.floor("value").cast("int").alias("line"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id"
    )


def search_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query (the first four words), page, clicks, impressions, position, ctr of each document."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.array_join(F.slice(words, 1, 4), " ").alias("query"), F.concat(F.lit("/d/"), F.col("source")).alias("page"), (F.col("doc_id") % 7).cast("int").alias("clicks"), F.col("n_chars").cast("int").alias("impressions"), (1 + F.col("doc_id") % 40).cast("double").alias("position"),
        F.when(F.col("n_chars") > 0, (F.col("doc_id") % 7) / F.col("n_chars")).otherwise(F.lit(0.0)).alias("ctr"),
    )


def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slug and url of the site's pages: a page per product name, and one for every second search query, a letter longer than it."""
    slug = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    names = products(spark, sf_dir).select(slug(F.col("display_name")).alias("slug"))
    asked = search_console(spark, sf_dir).where("ord % 2 = 0").select(F.concat(slug(F.col("query")), F.lit("s")).alias("slug"))
    return names.unionByName(asked).distinct().withColumn("url", F.concat(F.lit("https://www.example.org/p/"), "slug"))
