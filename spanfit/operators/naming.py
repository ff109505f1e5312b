"""What names and slugs say: readable specifications, display names, products behind URLs, clearance in words, the fit calculator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import squash

#: Category labels, and words of a slug by category, in order of the tests.
LABELS = {"fridge": "Fridge", "dishwasher": "Dishwasher", "washing_machine": "Washing Machine", "dryer": "Dryer"}
SLUG_WORDS = {
    "dishwasher": "dishwasher|dish-washer|dishwash|fstand-dish|bench-dishwasher|dish-ss|dish-silv",
    "washing_machine": "washing-machine|washer-dryer|combo-washer|front-load-washing|top-load-washing|front-loader|front-load|top-load|fronload|washer",
    "dryer": "heat-pump-dryer|condenser-dryer|vented-dryer|clothes-dryer|dryer",
    "fridge": "fridge-freezer|fridges-freezers|refrigerator|fridge|freezer|top-mount|bottom-mount|french-door|quad-door|side-by-side|sbs",
}
#: Slugs of other goods; units of a size; words that are no model; letters that begin a model written in two parts.
OTHER_GOODS = "baby-bottle-washer|dishwasher-bonus|finish-dishwasher-bonus|hair-dryer|hand-dryer|dehumidifier|pressure-washer|washer-fluid|stacking-kit|trim-kit"
SIZE_TOKEN = r"^\d+(l|kg|cm|mm|place|pl|p|star|stars)$"
MODEL_LETTERS = "^(gf|gb|gs|gt|wv|wd|rf|rs|wh|dh|ww|sr|sp|sm|ctm|cbm)$"


def brand_display(brand: Column, names: dict[str, str]) -> Column:
    """A brand as shown: by the table of names, all capitals as they are, all small letters with capitals."""
    b = F.trim(F.coalesce(brand, F.lit("")))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), b) if names else F.lit(None).cast("string")
    return F.coalesce(known, F.when(b.rlike(r"^[a-z][a-z\s&/-]*$"), F.initcap(b)).otherwise(b))


def display_name(brand: Column, series: Column, cat: Column) -> Column:
    """Brand and series, else brand and category."""
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), cat), F.lit("Appliance"))
    return F.trim(F.concat(F.coalesce(brand, F.lit("")), F.lit(" "), F.coalesce(F.nullif(series, F.lit("")), label)))


def readable_spec() -> Column:
    """A few words on a product (cat, model, features, top_loader): capacity and kind, by category."""
    model, first, every = F.coalesce("model", F.lit("")), F.trim(F.coalesce(F.get("features", 0), F.lit(""))), F.array_join(F.coalesce("features", F.array().cast("array<string>")), " ")
    found = lambda p: F.nullif(F.regexp_extract(model, f"(?i){p}", 1), F.lit(""))
    litres, kg, places = found(r"([0-9]{2,4})\s*L\b"), found(r"([0-9]+(?:\.[0-9]+)?)\s*kg\b"), found(r"([0-9]{1,2})\s*Place\b")
    says = lambda text, p: text.rlike(f"(?i){p}")
    named = F.regexp_replace(F.regexp_replace(F.initcap(F.regexp_replace(first, r"\s+", " ")), r"\bAnd\b", "and"), " ", "-")
    door = F.when(first != "", named)
    for words, kind in (("French Door", "French-Door"), ("Top Mount", "Top-Mount"), ("Bottom Mount", "Bottom-Mount"), ("Side by Side", "Side-by-Side")):
        door = door.when(says(model, words), kind)
    door = door.otherwise("Fridge")
    built = F.when(says(first, "built.?in"), "Built-in").when(says(first, "drawer"), "Drawer").when(says(first, "freestanding"), "Freestanding").otherwise("Built-in")
    load = F.when(F.col("top_loader"), "Top Loader").when(says(every, "front") | says(model, "front loader"), "Front Loader").when(says(every, "top") | says(model, "top loader"), "Top Loader").otherwise("Front Loader")
    heat = F.lit(None).cast("string")
    for words, kind in (("vented", "Vented"), ("condenser", "Condenser"), ("heat pump", "Heat Pump")):
        heat = F.when(says(every, words) | says(model, words), kind).otherwise(heat)
    sized = lambda kind: F.coalesce(F.concat(kg, F.lit("kg "), kind), kind)
    return (
        F.when(F.col("cat") == "fridge", F.coalesce(F.concat(litres, F.lit("L "), door), F.replace(door, F.lit("-"), F.lit(" ")))).when(F.col("cat") == "dishwasher", F.coalesce(F.concat(places, F.lit("-place "), built), F.concat(built, F.lit(" Dishwasher"))))
        .when(F.col("cat") == "washing_machine", sized(load)).when(F.col("cat") == "dryer", sized(F.coalesce(heat, F.lit("Dryer")))).otherwise("Appliance")
    )


def discovered(urls: DataFrame, brands: list[tuple[str, str]], model_brands: list[tuple[str, str]] = (), weak: tuple[str, ...] = ()) -> DataFrame:
    """(url, category, brand, model) of product URLs whose last part tells all three.

    brands: (slug prefix, brand) in order; model_brands: (pattern of a model, brand) in order, for slugs without a brand; weak:
    tokens that are no model. Of a slug's tokens the one that looks most like a model wins, alone or with the token after it.
    """
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    last = F.lower(F.coalesce(F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1), F.lit("")))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.html?$", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = urls.select("url", slug.alias("slug")).where("slug <> ''")
    category = F.when(F.col("slug").rlike(OTHER_GOODS), None)
    for name, needles in SLUG_WORDS.items():
        category = category.when(F.col("slug").rlike(needles), name)
    prefix = own = F.lit(None).cast("string")
    for p, b in reversed(brands):
        here = (F.col("slug") == p) | F.col("slug").startswith(f"{p}-")
        prefix, own = F.when(here, p).otherwise(prefix), F.when(here, b).otherwise(own)
    rows = rows.withColumns({"category": category, "own": own, "tokens": F.filter(F.split(F.substring("slug", F.coalesce(F.length(prefix), F.lit(0)) + 1, F.length("slug")), "-"), lambda t: t != "")})

    mixed = lambda t: t.rlike("[a-z]") & t.rlike("[0-9]")
    size = lambda t: t.rlike(SIZE_TOKEN)

    def points(t: Column) -> Column:
        letters, digits, n = F.length(F.regexp_replace(t, "[^a-z]", "")), F.length(F.regexp_replace(t, "[^0-9]", "")), F.length(t)
        plus = lambda c, k: F.when(c, k).otherwise(0)
        good = n + plus(letters >= 2, 6) + plus(digits >= 2, 6) + plus(n >= 6, 6) + plus(t.rlike("^[a-z]{1,4}[0-9]"), 4)
        return F.when(~mixed(t) | size(t), -100).when(t.isin(*weak) if weak else F.lit(False), -50).otherwise(good)

    def candidates(t: Column, i: Column) -> Column:
        after = F.coalesce(F.get("tokens", i + 1), F.lit(""))
        pair = (mixed(t) | t.rlike(MODEL_LETTERS)) & (F.length(t) <= 5) & ~size(t) & mixed(after) & ~size(after)
        both = F.struct((F.greatest(points(t), F.lit(0)) + points(after) + 8).cast("int").alias("score"), (-2 * i).cast("int").alias("at"), F.upper(F.concat(t, F.lit("-"), after)).alias("model"))
        alone = F.struct(points(t).cast("int").alias("score"), (-2 * i - 1).cast("int").alias("at"), F.upper(t).alias("model"))
        return F.array(F.when(pair, both), F.when(mixed(t), alone))

    best = F.array_max(F.filter(F.array_compact(F.flatten(F.transform("tokens", candidates))), lambda c: c["score"] > 0))
    rows = rows.withColumn("model", best["model"])
    guessed = F.lit(None).cast("string")
    for p, b in reversed(model_brands):
        guessed = F.when(F.col("model").rlike(f"(?i){p}"), b).otherwise(guessed)
    return rows.select("url", "category", F.coalesce("own", guessed).alias("brand"), "model").where("category is not null and brand is not null and model is not null")


def attribute_value(groups: Column, names: tuple[str, ...]) -> Column:
    """Of grouped attributes (map of group to array of (displayName, value)) the value of the first that has one of the names, case folded."""
    every = F.flatten(F.map_values(groups))
    return F.get(F.filter(every, lambda a: F.lower(F.trim(a["displayName"])).isin(*(n.lower() for n in names))), 0)["value"]


def holds_sku(text: Column, candidates: list[Column]) -> Column:
    """Whether a document's text holds one of the model's names, all but letters and digits aside."""
    folded = squash(text)
    hit = F.lit(False)
    for c in candidates:
        hit = hit | ((squash(c) != "") & F.contains(folded, squash(c)))
    return hit


def within_days(date: Column, days: int, now: str) -> Column:
    """Whether a date text lies at most so many days before (or after) now; false for what is no date."""
    return F.coalesce(F.abs(F.datediff(F.lit(now).cast("date"), F.try_to_date(F.substring(date, 1, 10)))) <= days, F.lit(False))


def clearance_words(own: dict[str, Column], usual: dict[str, int]) -> Column:
    """How a rule's side, rear and top differ from the category's usual figures."""
    names = {"side": ("side gap", "wider than the usual category baseline", "tighter than the usual category baseline"), "rear": ("rear allowance", "deeper than the default figure", "tighter than the default figure"), "top": ("top allowance", "taller than the default figure", "tighter than the default figure")}
    notes = []
    for axis, (what, more, less) in names.items():
        d = own[axis] - usual[axis]
        notes.append(F.when(d != 0, F.concat(F.lit(f"The {what} is "), F.abs(d).cast("string"), F.lit("mm "), F.when(d > 0, more).otherwise(less), F.lit("."))))
    text = F.array_join(F.array_compact(F.array(*notes)), " ")
    return F.when(text == "", "These figures sit close to the category baseline.").otherwise(text)


def install_tips(own: dict[str, Column], base: Column) -> Column:
    """The first three distinct tips: the category's own (an array), then those that the rule's figures ask for."""
    mm = lambda x: x.cast("string")
    more = F.array_compact(
        F.array(
            F.when(own["side"] > 0, F.concat(F.lit("Allow at least "), mm(own["side"] * 2), F.lit("mm of total side room."))), F.when(own["rear"] > 30, F.concat(F.lit("Keep "), mm(own["rear"]), F.lit("mm behind the cabinet."))),
            F.when(own["top"] > 30, F.concat(F.lit("Check for "), mm(own["top"]), F.lit("mm of open space above the cabinet."))),
        )
    )
    return F.slice(F.array_distinct(F.concat(base, more)), 1, 3)


def calculator(cabinet: dict[str, Column], product: dict[str, Column], room: dict[str, Column]) -> dict[str, Column]:
    """status (invalid, incomplete, fail, pass), failures in order and spare mm of a cabinet (w, h, d) for a product with clearances left, right, top, rear."""
    known = product["w"].isNotNull() & product["h"].isNotNull() & product["d"].isNotNull()
    asked = cabinet["w"].isNotNull() & cabinet["h"].isNotNull() & cabinet["d"].isNotNull()
    over = {a: product[a] - cabinet[a] for a in "whd"}
    half = F.floor(-over["w"] / 2)
    short = (-over["w"]) < room["left"] + room["right"]
    failed = F.array_compact(
        F.array(
            F.when(over["w"] > 0, "width"), F.when((over["w"] <= 0) & short & (half < room["left"]), "left"), F.when((over["w"] <= 0) & short & (-over["w"] - half < room["right"]), "right"),
            F.when(over["h"] > 0, "height").when(-over["h"] < room["top"], "top"), F.when(over["d"] > 0, "depth").when(-over["d"] < room["rear"], "rear"),
        )
    )
    status = F.when(~known, "invalid").when(~asked, "incomplete").when(F.size(failed) > 0, "fail").otherwise("pass")
    spare = {"w": -over["w"] - room["left"] - room["right"], "h": -over["h"] - room["top"], "d": -over["d"] - room["rear"]}
    return {"status": status, "failures": F.when(status == "fail", F.array_join(failed, ",")).otherwise(""), **{f"spare_{a}": F.when(status == "pass", x).cast("int") for a, x in spare.items()}}


def has_signal() -> Column:
    """Any sign of verification on a row (verification_level, has_evidence, data_source)."""
    return F.coalesce(F.col("verification_level") != "", F.lit(False)) | F.coalesce("has_evidence", F.lit(False)) | F.coalesce(F.col("data_source") != "", F.lit(False))


def is_verified_fit() -> Column:
    """Strong verification: the level says so, evidence from a document, or an official source."""
    return F.coalesce(F.col("verification_level") == "verified", F.lit(False)) | F.coalesce("has_evidence", F.lit(False)) | F.coalesce(F.col("data_source") == "official_pdf", F.lit(False))
