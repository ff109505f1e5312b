"""Rules of records: types as in JSON, nulls, ranges, dates, unknown keys, older names."""

import json

import pytest
from pyspark.sql import functions as F

from spanfit.operators import validators as v

GOOD = {"id": "a", "cat": "fridge", "brand": "b", "model": "m", "emoji": "x", "w": 600, "h": 1700, "d": 650.0, "kwh_year": 300, "stars": 4, "price": None, "door_swing_mm": 0, "features": ["f"], "retailers": [{"n": "r", "url": "u", "p": None}], "sponsored": False, "unavailable": True}


def said(spark, record, rules, keys=None):
    text = record if isinstance(record, str) else json.dumps(record)
    return spark.createDataFrame([(text,)], "j string").select(v.errors(F.try_parse_json("j"), rules, keys).alias("e")).first().e


@pytest.mark.parametrize(("change", "want"), [
    ({}, []),
    ({"w": 199, "h": "1700", "d": 650.5, "stars": 0, "kwh_year": None}, ["w: range", "h: integer", "d: integer", "kwh_year: null", "stars: range"]),
    ({"price": 0, "door_swing_mm": 200}, ["price: range", "door_swing_mm: range"]),
    ({"price": "5", "door_swing_mm": 400, "id": " ", "brand": 5}, ["id: text", "brand: text", "price: integer"]),
    ({"features": ["a", " "], "retailers": [{"n": "", "url": "u", "p": -1}, 7], "sponsored": "no"}, ["features: texts", "retailers[0].n: text", "retailers[1].n: absent", "retailers[1].url: absent", "retailers[0].p: range", "retailers[1].p: absent", "sponsored: boolean"]),
    ({"features": None, "retailers": {}}, ["features: null", "retailers: list"]),
    ({"direct_url": "http://x", "inferred_door_swing": 1, "evidence": 5}, ["direct_url: https", "inferred_door_swing: boolean", "evidence: object"]),
    ({"direct_url": None, "inferred_door_swing": True, "evidence": {"has_pdf_evidence": True, "verified_at": "2024-02-30", "source_url": "ftp://x"}}, ["evidence.source_url: url", "evidence.verified_at: date"]),
    ({"evidence": {"has_pdf_evidence": True, "verified_at": "2024-02-28"}, "unknown": 1}, []),
])
def test_products(spark, change, want):
    assert said(spark, GOOD | change, v.PRODUCT) == want


def test_what_is_no_record(spark):
    assert said(spark, "{no", v.PRODUCT) == said(spark, "[1]", v.PRODUCT) == said(spark, "null", v.PRODUCT) == ["record: object"]
    assert said(spark, {}, v.MANUAL) == ["type: absent", "status: absent", "source_url: absent"]


def test_manual_entries(spark):
    good = {"type": "spec_sheet", "status": "approved", "source_url": "https://a.example/x", "local_path": "a/b.pdf", "sha256": "A" * 64}
    assert said(spark, good, v.MANUAL) == [] == said(spark, good | {"local_path": None, "sha256": ""}, v.MANUAL)
    assert said(spark, {"type": "x", "status": 5, "source_url": "a", "local_path": "/etc", "sha256": "z" * 64}, v.MANUAL) == ["type: one of", "status: one of", "source_url: url", "local_path: unlike", "sha256: like"]


def test_extracted_records_of_both_forms(spark):
    old = {"brand": " LG ", "model": "X1", "category": "Wash Tower", "dimensions_mm": {"height": 1700.4, "width": 600, "depth": 650}, "clearance_mm": {"side": 5, "left": 7, "rear": None}, "confidence": "High", "source_pdf_url": "https://a.example/x.pdf", "extraction_date": "2024-05-06T07:08:09.1Z"}
    row = spark.createDataFrame([(json.dumps(old),)], "j string").select(v.normalised(F.parse_json("j")).alias("r")).select(F.to_json("r").alias("j"), v.errors(F.col("r"), v.EXTRACTED, v.EXTRACTED_KEYS).alias("e"), v.needs_review(F.col("r")).alias("n")).first()
    got = json.loads(row.j)
    assert row.e == [] and row.n is False and got["brand"] == "LG" and got["category"] == "WASHTOWER_COMBO" and got["sku"] == "X1"
    assert got["clearance_requirements"] == {"top_mm": 0, "left_mm": 7, "right_mm": 5, "rear_mm": 0} and got["flags"] == {"requires_plumbing": False, "ventilation_required": True, "reversible_door": None}
    bad = got | {"extra": 1, "dimensions": {"height_mm": 0.4, "width_mm": "600", "depth_mm": 650.6, "door_open_90_depth_mm": None, "more": 2}, "metadata": got["metadata"] | {"extraction_date": "2024-05-06", "confidence_score": 1.5, "verified_alias": " "}}
    assert said(spark, bad, v.EXTRACTED, v.EXTRACTED_KEYS) == ["dimensions.height_mm: range", "dimensions.width_mm: rounded", "metadata.extraction_date: datetime", "metadata.confidence_score: range", "metadata.verified_alias: text", "extra: unknown", "dimensions.more: unknown"]
