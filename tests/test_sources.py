"""Broken files next to good ones: nothing is dropped without a trace."""

import json

import pytest

from spanfit.operators import resolve
from spanfit.sources import adapters, records

PRODUCT = "products array<struct<id:string,cat:string,w:int>>"


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, value in files.items():
        (folder / name.replace("_json", ".json").replace("_ndjson", ".ndjson")).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
    return f"file://{folder}"


def test_catalog_files_in_order_with_broken_ones_kept(spark, tmp_path):
    path = write(tmp_path / "c", b_json={"products": [{"id": "b1"}, {"id": "b2", "cat": "x"}]}, a_json={"products": [{"id": "a1", "w": 5}]}, broken_json='{"products": [', list_json="[1, 2]", odd_json={"products": "none"}, empty_json="")
    read = records.read_json(spark, f"{path}/*.json", PRODUCT)
    rows = records.items(read.rows, "products", {"a.json": "fridge", "b.json": "dryer"}).orderBy("ord").collect()
    assert [(r.id, r.cat, r.w) for r in rows] == [("a1", "fridge", 5), ("b1", "dryer", None), ("b2", "x", None)]
    assert sorted(r.file for r in read.quarantine.collect()) == ["broken.json", "list.json", "odd.json"]


def test_a_document_without_its_list_is_an_error(spark, tmp_path):
    path = write(tmp_path / "m", a_json={"products": []}, b_json={"other": 1})
    read = records.read_json(spark, f"{path}/*.json", PRODUCT)
    with pytest.raises(Exception, match="b.json has no products"):
        records.items(read.rows, "products").collect()
    only = records.read_json(spark, f"{path}/a.json", PRODUCT)
    assert records.items(only.rows, "products").collect() == []


def test_lines_that_are_no_records_are_kept(spark, tmp_path):
    path = write(tmp_path / "n", r_ndjson='{"metric": "LCP", "value": 1}\nnot json\n\n{"metric": "CLS", "value": "high"}\n{"metric": "INP"}\n')
    read = records.read_json(spark, f"{path}/*.ndjson", "metric string, value double", lines=True)
    assert sorted((r.metric, r.value) for r in read.rows.where("value is not null").collect()) == [("LCP", 1.0)]
    assert {r.text for r in read.quarantine.collect()} == {"not json", '{"metric": "CLS", "value": "high"}'}
    assert read.rows.count() == 2


def test_evidence_files_go_on_to_the_match(spark, tmp_path):
    good = {"product_id": "p1", "model": "A12", "extracted": {"sku": "A-12", "dimensions": {"width_mm": 600.4, "height_mm": 1700, "depth_mm": 650}, "clearance_requirements": {}, "flags": {}}}
    path = write(tmp_path / "e", z_json=good, a_json=good | {"product_id": None, "model": "B7", "extracted": good["extracted"] | {"sku": None}}, no_flags_json={"product_id": "p2", "extracted": {"dimensions": {}, "clearance_requirements": {}}}, bad_json="{")
    read = records.read_evidence(spark, path)
    assert [(r.evidence_id, r.w, r.h, r.d) for r in read.rows.orderBy("evidence_id").collect()] == [("a.json", 600, 1700, 650), ("z.json", 600, 1700, 650)]
    assert {(r.file, r.reason) for r in read.quarantine.collect()} == {("no_flags.json", "incomplete"), ("bad.json", "no such record")}
    products = spark.createDataFrame([("p9", 0, "b-7"), ("p1", 1, "x")], "id string, ord int, model string")
    assert {(r.evidence_id, r.id, r.by) for r in resolve.match_evidence(read.rows, products).collect()} == {("a.json", "p9", "token"), ("z.json", "p1", "id")}


def test_console_rows(spark, tmp_path):
    path = write(tmp_path / "g", a_json={"rows": [{"keys": ["fridge 600", "/p"], "clicks": 2, "impressions": 120, "position": 14.2}, {"keys": [" "]}, {"clicks": 1}]}, b_json={}, c_json="nope")
    read = records.read_console(spark, path)
    assert [(r.query, r.page, r.clicks, r.ctr, r.position) for r in read.rows.collect()] == [("fridge 600", "/p", 2.0, 0.0, 14.2)]
    assert sorted(r.reason for r in read.quarantine.collect()) == ["no query", "no query", "no such record"]


def test_offers_are_dealt_once_in_parts_that_grow(spark, monkeypatch):
    """What is asked of a product stays where its offers are, in as many tasks as the line items need (F15, F16, F20)."""
    from spanfit.operators import resolve, selection

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(adapters, "LINES", 500)
    rows = adapters.offers(spark, sf)
    parts = 1 + spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500
    assert parts > spark.sparkContext.defaultParallelism and rows.rdd.getNumPartitions() == parts
    assert rows.count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    for found in (selection.cheapest_offer(rows), resolve.upsert_offers(rows, rows.select("product_id", "pos", "n", "url", "p").where("false"))):
        assert plan(found).count("Exchange hashpartitioning(product_id") <= 2


def test_parts_of_an_address_are_evaluated_once(spark):
    """A condition that names a value several times evaluates it once (F19, F21)."""
    from pyspark.sql import functions as F

    from spanfit.functions.columns import is_product_url_strict
    from spanfit.operators.evidence import document_score, fallback_score

    plan = lambda c: spark.range(1).select(F.col("id").cast("string").alias("u")).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    u = F.col("u")
    assert plan(is_product_url_strict(u)).count("Evaluator(null,HOST") == 1 and plan(is_product_url_strict(u)).count("Evaluator(null,PATH") == 1
    assert plan(fallback_score(u, u, u, u == "x")).count("regexp_replace(") == 3 and plan(document_score(u, u, F.array(u))).count("Evaluator(null,HOST") == 1
