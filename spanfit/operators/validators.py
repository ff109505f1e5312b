"""Validators of JSON records: field rules as data, compiled to one array of errors (P-39, P-40, P-60).

A record is a VARIANT, so types are those of its JSON: "5" is no number and 5.0 is a whole one. A rule names a field, what
it has to be, and whether it may be null or absent; `[]` after a list's name leads to its elements. Errors read
`field: what`, in the order of the rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanfit.functions.columns import js_round


class Rule(NamedTuple):
    """kind: text (not blank), integer, number, rounded (whole when rounded), boolean, date, datetime, url, https, list, texts (a list of them), object, one of (values), like (a pattern), unlike."""

    path: str
    kind: str
    ranges: tuple[tuple[float, float], ...] = ()
    null: bool = False
    absent: bool = False
    values: tuple[str, ...] = ()


#: Fields of a product, of extracted dimensions and of a manual evidence entry, and their limits.
PRODUCT = (
    *(Rule(f, "text") for f in ("id", "cat", "brand", "model", "emoji")),
    Rule("w", "integer", ((200, 2500),)), Rule("h", "integer", ((200, 2500),)), Rule("d", "integer", ((200, 1500),)), Rule("kwh_year", "integer", ((50, 2000),)), Rule("stars", "integer", ((1, 6),)),
    Rule("price", "integer", ((1, 100_000),), null=True), Rule("door_swing_mm", "integer", ((0, 0), (5, 100), (400, 1200)), null=True), Rule("features", "texts"), Rule("retailers", "list"),
    Rule("retailers[].n", "text"), Rule("retailers[].url", "text"), Rule("retailers[].p", "integer", ((0, float("inf")),), null=True), Rule("sponsored", "boolean"), Rule("unavailable", "boolean"),
    Rule("direct_url", "https", null=True, absent=True), Rule("inferred_door_swing", "boolean", absent=True),
    Rule("evidence", "object", absent=True), Rule("evidence.has_pdf_evidence", "boolean"), Rule("evidence.source_url", "url", absent=True), Rule("evidence.verified_at", "date"),
)
CATEGORIES = ("FRIDGE", "DISHWASHER", "OVEN", "WASHING_MACHINE", "DRYER", "WASHTOWER_COMBO")
_MM, _ROOM = ((1, float("inf")),), ((0, float("inf")),)
EXTRACTED = (
    Rule("brand", "text"), Rule("sku", "text"), Rule("category", "one of", values=CATEGORIES),
    *(Rule(f"dimensions.{f}", "rounded", _MM) for f in ("height_mm", "width_mm", "depth_mm")), Rule("dimensions.door_open_90_depth_mm", "rounded", _MM, null=True),
    *(Rule(f"clearance_requirements.{f}", "rounded", _ROOM) for f in ("top_mm", "left_mm", "right_mm", "rear_mm")),
    Rule("flags.requires_plumbing", "boolean"), Rule("flags.ventilation_required", "boolean"), Rule("flags.reversible_door", "boolean", null=True),
    Rule("metadata.source_pdf_url", "url"), Rule("metadata.extraction_date", "datetime"), Rule("metadata.confidence_score", "number", ((0, 1),)), Rule("metadata.verified_alias", "text", absent=True), Rule("metadata.source_type", "text", absent=True),
)
#: Strict objects: keys that they may have.
EXTRACTED_KEYS = {
    "": ("brand", "sku", "category", "dimensions", "clearance_requirements", "flags", "metadata"), "dimensions": ("height_mm", "width_mm", "depth_mm", "door_open_90_depth_mm"), "clearance_requirements": ("top_mm", "left_mm", "right_mm", "rear_mm"),
    "flags": ("requires_plumbing", "ventilation_required", "reversible_door"), "metadata": ("source_pdf_url", "extraction_date", "confidence_score", "verified_alias", "source_type"),
}
MANUAL = (
    Rule("type", "one of", values=("manufacturer_manual", "installation_manual", "spec_sheet", "energy_label", "retailer_product_page")), Rule("status", "one of", values=("candidate", "extracted", "approved", "rejected")), Rule("source_url", "url"),
    Rule("local_path", "unlike", null=True, absent=True, values=("^/",)), Rule("sha256", "like", null=True, absent=True, values=("(?i)^([a-f0-9]{64})?$",)),
)
CATEGORY_NAMES = {"fridge": "FRIDGE", "refrigerator": "FRIDGE", "dishwasher": "DISHWASHER", "oven": "OVEN", "dryer": "DRYER", "washer": "WASHING_MACHINE", "washing_machine": "WASHING_MACHINE", "washing-machine": "WASHING_MACHINE", **dict.fromkeys(("washtower_combo", "washtower-combo", "washtower", "wash tower", "laundry tower"), "WASHTOWER_COMBO")}
SURENESS = {"high": 0.9, "medium": 0.65, "low": 0.35}
URL, DATE, TIME = r"(?i)^https?://[^/\s?#]+", r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"


def _at(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "variant")


def _kind(x: Column) -> Column:
    """What a value's JSON type is: number, text, boolean, list, object or null; null where there is none."""
    t = F.schema_of_variant(x)
    return F.when(t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number").when(t == "STRING", "text").when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object").when(t == "VOID", "null")


def _wrong(x: Column, rule: Rule) -> Column:
    """What is wrong with a value: absent, null, its kind, or its range; null if nothing is."""
    kind, text, number = _kind(x), F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "double")
    is_text = kind == "text"
    number = js_round(number) if rule.kind == "rounded" else number
    within = F.lit(not rule.ranges)
    for low, high in rule.ranges:
        within = within | number.between(F.lit(float(low)), F.lit(float(high)))
    tests = {
        "text": is_text & (F.trim(text) != ""), "integer": (kind == "number") & (number == F.floor(number)), "number": kind == "number", "rounded": kind == "number", "boolean": kind == "boolean", "list": kind == "list", "object": kind == "object",
        "date": is_text & text.rlike(DATE) & F.try_to_date(text).isNotNull(), "datetime": is_text & text.rlike(TIME) & F.try_to_timestamp(text).isNotNull(), "url": is_text & text.rlike(URL), "https": is_text & text.startswith("https://"),
        "one of": is_text & text.isin(*rule.values), "like": is_text & text.rlike(rule.values[0] if rule.values else ""), "unlike": ~(is_text & text.rlike(rule.values[0] if rule.values else "")),
        "texts": (kind == "list") & F.forall(F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.coalesce((_kind(e) == "text") & (F.trim(F.try_variant_get(e, "$", "string")) != ""), F.lit(False))),
    }
    absent = None if rule.absent else "absent"
    null = None if rule.null else "null"
    good = F.coalesce(tests[rule.kind], F.lit(False))
    return F.when(x.isNull(), absent).when(kind == "null", null).when(~good, rule.kind).when(F.lit(bool(rule.ranges)) & ~F.coalesce(within, F.lit(False)), "range")


def _each(record: Column, head: str, rest: str, rule: Rule) -> Column:
    """The errors of one field of a list's elements."""
    none = F.array().cast("array<variant>")
    return F.array_compact(F.transform(F.coalesce(F.try_variant_get(record, f"$.{head}", "array<variant>"), none), lambda e, i: F.concat(F.lit(f"{head}["), i.cast("string"), F.lit(f"].{rest}: "), _wrong(_at(e, rest), rule))))


def _unknown(x: Column, before: str, known: tuple[str, ...]) -> Column:
    """Keys of an object that it may not have."""
    more = F.array_except(F.when(_kind(x) == "object", F.json_object_keys(F.to_json(x))), F.array(*map(F.lit, known)))
    return F.coalesce(F.transform(F.array_sort(more), lambda k: F.concat(F.lit(before), k, F.lit(": unknown"))), F.array().cast("array<string>"))


def errors(record: Column, rules: tuple[Rule, ...], keys: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The errors of a record: an array, empty for a good one; a record that is no object has the one error `record: object`. keys: objects that may have no others."""
    found = []
    for rule in rules:
        head, _, rest = rule.path.partition("[].")
        if rest:
            found.append(_each(record, head, rest, rule))
            continue
        wrong = F.concat(F.lit(f"{rule.path}: "), _wrong(_at(record, rule.path), rule))
        parent = rule.path.rpartition(".")[0]
        if parent and any(r.path == parent and r.absent for r in rules):
            wrong = F.when(_kind(_at(record, parent)) == "object", wrong)  # the parent's own rule speaks for what is not there
        found.append(F.array_compact(F.array(wrong)))
    for path, known in (keys or {}).items():
        found.append(_unknown(_at(record, path) if path else record, f"{path}." if path else "", known))
    return F.when(F.coalesce(_kind(record) == "object", F.lit(False)), F.concat(*found)).otherwise(F.array(F.lit("record: object")))


def normalised(record: Column) -> Column:
    """An extracted record in its one form, from older names of its fields and their defaults."""

    def first(*paths: str, otherwise: str = "null") -> Column:
        there = [F.when(~F.is_variant_null(_at(record, p)), _at(record, p)) for p in paths]
        return F.coalesce(*there, F.parse_json(F.lit(otherwise)))

    def text(*paths: str) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(record, f"$.{p}", "string")), F.lit("")) for p in paths))

    name = text("category")
    table = F.create_map(*(F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair))
    sure = F.create_map(*(F.lit(x) for pair in SURENESS.items() for x in pair))
    score = F.when(_kind(_at(record, "metadata.confidence_score")) == "number", F.try_variant_get(record, "$.metadata.confidence_score", "double")).otherwise(F.coalesce(F.try_element_at(sure, F.lower(text("confidence"))), F.lit(0.0)))
    given = lambda *paths: F.coalesce(*(_at(record, p) for p in paths))
    struct = F.struct(
        text("brand").alias("brand"), text("sku", "model").alias("sku"), F.coalesce(F.try_element_at(table, F.lower(name)), name).alias("category"),
        F.struct(first("dimensions.height_mm", "dimensions_mm.height").alias("height_mm"), first("dimensions.width_mm", "dimensions_mm.width").alias("width_mm"), first("dimensions.depth_mm", "dimensions_mm.depth").alias("depth_mm"), first("dimensions.door_open_90_depth_mm", "door_swing_mm").alias("door_open_90_depth_mm")).alias("dimensions"),
        F.struct(
            first("clearance_requirements.top_mm", "clearance_mm.top", otherwise="0").alias("top_mm"), *(first(f"clearance_requirements.{s}_mm", f"clearance_mm.{s}", "clearance_mm.side", otherwise="0").alias(f"{s}_mm") for s in ("left", "right")), first("clearance_requirements.rear_mm", "clearance_mm.rear", otherwise="0").alias("rear_mm")
        ).alias("clearance_requirements"),
        F.struct(first("flags.requires_plumbing", otherwise="false").alias("requires_plumbing"), first("flags.ventilation_required", otherwise="true").alias("ventilation_required"), first("flags.reversible_door").alias("reversible_door")).alias("flags"),
        F.struct(given("metadata.source_pdf_url", "source_pdf_url").alias("source_pdf_url"), given("metadata.extraction_date", "extraction_date").alias("extraction_date"), score.alias("confidence_score"), given("metadata.verified_alias", "verified_alias").alias("verified_alias"), given("metadata.source_type", "source_type").alias("source_type")).alias("metadata"),
    )
    return F.parse_json(F.to_json(struct))


def needs_review(record: Column, least: float = 0.8) -> Column:
    """Of a normalised record without errors: whether its confidence asks for a look."""
    return F.try_variant_get(record, "$.metadata.confidence_score", "double") < least
