"""Evidence index, work queues, document choice, affiliate links, comparison insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import let, squash
from spanfit.operators.facets import ranked


def pick(items: Column) -> Column:
    """Of an entry's items (status, ...): the first approved, else the first that is not invalid, else the first."""
    approved = F.try_element_at(F.filter(items, lambda e: e["status"] == "approved"), F.lit(1))
    usable = F.try_element_at(F.filter(items, lambda e: ~e["status"].eqNullSafe(F.lit("invalid"))), F.lit(1))
    return F.coalesce(approved, usable, F.try_element_at(items, F.lit(1)))


def evidence_index(manifest: DataFrame) -> DataFrame:
    """product_id, url, verified of entries (product_id, items) that have a usable source."""
    rows = manifest.select("product_id", F.explode(F.array(pick(F.col("items")))).alias("e")).where(F.col("e").isNotNull() & F.coalesce(F.col("e.url") != "", F.lit(False)))
    return rows.select("product_id", F.col("e.url").alias("url"), (F.col("e.status") == "approved").alias("verified"))


def work_queue(products: DataFrame, done: DataFrame, brands: tuple[str, ...] = ()) -> DataFrame:
    """Products without approved evidence, of the wanted brands."""
    left = products.join(done.where("verified").select(F.col("product_id").alias("id")), "id", "left_anti")
    return left.where(F.lower("brand").isin(*(b.lower() for b in brands))) if brands else left


def failure_bucket(reason: Column, error: Column | None = None) -> Column:
    """Cause of a failure, the first that fits: C unverified alias, A missing source, B missing clearance, D unreadable layout."""
    t = reason if error is None else F.concat_ws(" ", reason, error)
    alias = "(?i)alias|model mismatch|does not match|engineering model|marketing model"
    source = "(?i)PDP Not Found|source missing|official fetch failed|HTTP 404|source URL not found"
    return F.when(t.rlike(alias), "C").when(t.rlike(source), "A").when(t.rlike("(?i)clearance"), "B").otherwise("D")


def failures(rows: DataFrame, index: DataFrame, products: DataFrame) -> DataFrame:
    """bucket, n, resolved: failures (sku, reason) that the index has by id or by model meanwhile, and the others."""
    have = index.select(F.col("product_id").alias("id")).join(products.select("id", squash(F.col("model")).alias("token")), "id")
    keys = have.select(F.col("id").alias("key")).unionByName(have.select(F.col("token").alias("key"))).distinct().withColumn("hit", F.lit(True))
    found = rows.join(keys, F.coalesce("id", squash(F.col("sku"))) == F.col("key"), "left")
    return found.groupBy(failure_bucket(F.col("reason")).alias("bucket")).agg(F.count("*").alias("n"), F.count("hit").alias("resolved"))


def document_score(url: Column, model: Column, official: Column) -> Column:
    """How likely a document is a model's specification: model, official host (array of the brand's hosts), wording."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    own = let({"host": host}, lambda x: F.exists(official, lambda h: (x["host"] == h) | x["host"].endswith(F.concat(F.lit("."), h))))
    says = lambda words, points: F.when(url.rlike(f"(?i){words}"), points).otherwise(0)
    named = let({"url": squash(url), "model": squash(model)}, lambda x: F.when((x["model"] != "") & F.contains(x["url"], x["model"]), 60).otherwise(0))
    return (
        named + F.when(F.coalesce(own, F.lit(False)), 35).otherwise(0) + says("spec|data.?sheet|fact.?sheet", 30) + says("install|manual|quick.?reference|qrg", 15) + says("warranty|energy|label|catalog|brochure", -20)
    ).cast("int")


#: Words of a manual's name, description and address, and of a fallback document's address, with their points.
MANUAL_WORDS = ((r"spec|specification|data\s*sheet|datasheet|fact\s*sheet|factsheet", 50), ("quick|reference|qrg", 25), ("install|installation", 20), ("manual", 10), ("warranty|energy|label|brochure|catalogue|catalog", -20))
FALLBACK_WORDS = (("spec|data|dimension|install|manual|guide|qrg", 12), (r"commercial\.appliancesonline\.com\.au", 10), (r"appliancesonline\.com\.au", 8), (r"manualslib|usermanuals|device\.report", 4))
PDF = r"(?i)\.pdf($|[?#])"


def _points(text: Column, words: tuple[tuple[str, int], ...]) -> Column:
    total = F.lit(0)
    for pattern, points in words:
        total = total + F.when(text.rlike(f"(?i){pattern}"), points).otherwise(0)
    return total


def manual_score(name: Column, description: Column, url: Column) -> Column:
    """How useful a listed manual is; what is no PDF has -100."""
    said = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (name, description, url)))
    return F.when(F.coalesce(url, F.lit("")).rlike(PDF), _points(said, MANUAL_WORDS)).otherwise(-100).cast("int")


def best_manual(rows: DataFrame) -> DataFrame:
    """Of each product's manuals (id, name, description, url, place, pos) the best PDF: by score, its own place (999 if none), then pos. Scores below 0 are no choice."""
    scored = rows.withColumn("score", manual_score(F.col("name"), F.col("description"), F.col("url"))).where(F.col("score") >= 0)
    return ranked(scored, [F.desc("score"), F.coalesce("place", F.lit(999)).asc(), F.asc("pos")], ["id"], 1, "nth").select("id", "url", "score")


def fallback_score(url: Column, sku: Column, brand: Column, trusted: Column) -> Column:
    """How likely a third party's document is a model's: PDF, SKU, brand, wording and site; -1000 for a site that is not trusted."""
    holds = lambda x, name, points: F.when((x[name] != "") & F.contains(x["url"], x[name]), points).otherwise(0)
    named = let({"url": squash(url), "sku": squash(sku), "brand": squash(brand)}, lambda x: holds(x, "sku", 50) + holds(x, "brand", 10))
    return F.when(F.coalesce(trusted, F.lit(False)), F.when(url.rlike(PDF), 50).otherwise(0) + named + _points(url, FALLBACK_WORDS)).otherwise(-1000).cast("int")


def best_document(rows: DataFrame) -> DataFrame:
    """Of each product's documents (id, model, url, pos, official) the best: score, then place."""
    scored = rows.withColumn("score", document_score(F.col("url"), F.col("model"), F.col("official")))
    return ranked(scored, [F.desc("score"), F.asc("pos")], ["id"], 1, "nth").select("id", "url", "score")


def affiliate_url(templates: list[str], fields: dict[str, Column]) -> Column:
    """The first template whose placeholders {name} all have a value, filled in."""
    options = []
    for t in templates:
        filled, ok = F.lit(t), F.lit(True)
        for name, value in fields.items():
            if f"{{{name}}}" in t:
                filled = F.replace(filled, F.lit(f"{{{name}}}"), F.coalesce(F.url_encode(value), F.lit("")))
                ok = ok & F.coalesce(value != "", F.lit(False))
        options.append(F.when(ok, filled))
    return F.coalesce(*options)


def stale_days(checked: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), checked)


def research_confidence(found: Column, asked: Column) -> Column:
    return F.when(found >= asked, "high").when(found >= 2, "medium").otherwise("low")


def compare_insights(tray: DataFrame) -> DataFrame:
    """Per tray (grp): the rows of the best score, most links and lowest price; the first place wins ties."""
    best = lambda key: F.min(F.struct(key.alias("k"), "place", "id"))["id"]
    big = F.lit(2**31 - 1)
    return tray.groupBy("grp").agg(best(-F.coalesce("score", F.lit(-1))).alias("best_fit"), best(-F.size("retailers")).alias("most_retailers"), best(F.coalesce(F.when(F.col("price") > 0, F.col("price")), big)).alias("lowest_price"))


def compare_summary(tray: DataFrame) -> DataFrame:
    """Per tray: tight and blocked rows, how many have a price, links."""
    return tray.groupBy("grp").agg(F.count(F.when(F.col("gap").between(0, 9), 1)).alias("tight"), F.count(F.when(F.col("gap") < 0, 1)).alias("blocked"), F.count("price").alias("priced"), F.sum(F.size("retailers")).alias("links"))


def footprint_verdict(pairs: DataFrame) -> DataFrame:
    """Of pairs with rules (side_a, rear_a, top_a, ... _b): the total clearance of each and which needs less room."""
    total = {s: (F.col(f"side_{s}") * 2 + F.col(f"rear_{s}") + F.col(f"top_{s}")).cast("int") for s in "ab"}
    return pairs.withColumns({"room_a": total["a"], "room_b": total["b"]}).withColumn("verdict", F.when(F.col("room_a") < F.col("room_b"), F.concat("brand_a", F.lit(" needs less room"))).when(F.col("room_a") > F.col("room_b"), F.concat("brand_b", F.lit(" needs less room"))).otherwise("equal"))
