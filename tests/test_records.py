"""Spec sheets by rules, evidence files and manual entries against plain readings."""

import random

import pytest

from spanfit.operators import outside, resolve, sheets

FRIDGE = """Refrigerator
User manual
STEP 1 Select a site
Clearance
Depth “A” 723 mm
Width “B” 912 mm
Height “C” 1748 mm
Overall Height “D” 1779 mm
01 more than 50 mm
03 1472 mm
Before you start"""
WASHER = """Washing Machine
Alcove installation
The minimum clearances are
Sides - 25 mm
Top: 30 mm
Rear 50 mm
Specification sheet
Model name WW80AA
Dimensions
A (Width) 1 mm
B (Height) 2 mm
C (Depth) 3 mm
Model name WW9*DG5*****
Dimensions
A (Width) 600 mm
B (Height) 850 mm
C (Depth) 594.5 mm"""
LG = """LG Washing Machine
Specifications W 600 D 560 D” 1100 H 850
clearances of at least 20 mm at the sides and 100 mm behind the appliance"""
TYPES = "Refrigerator Size (mm) - Type 1 Type 2 " + " ".join(f"{c} {100 + k} {200 + k}" for k, c in enumerate("ABCDEFGH")) + " Allow over 50 mm of clearance from each adjacent wall"


@pytest.mark.parametrize(("brand", "cat", "sku", "text", "want", "problem"), [
    ("samsung", "fridge", "SRF1", FRIDGE, (912, 1779, 723, 1472, 50, 50, 50, 50), None),
    ("samsung", None, "SRF1", FRIDGE.replace("Overall Height “D” 1779 mm", ""), (912, 1748, 723, 1472, 50, 50, 50, 50), None),
    ("samsung", "dryer", "SRF1", FRIDGE, (None,) * 8, "the text is about fridge"),
    ("samsung", "washing_machine", "WW90DG5XYZA/SA", WASHER, (600, 850, 595, None, 30, 25, 25, 50), None),
    ("samsung", "washing_machine", "WW80AAXX", WASHER, (1, 2, 3, None, 30, 25, 25, 50), None),
    ("samsung", "washing_machine", "WW10", WASHER, (None,) * 8, "no dimensions"),
    ("LG ", "washing_machine", "WV5", LG, (600, 850, 560, 1100, 0, 20, 20, 100), None),
    ("lg", "washing_machine", "WV5", LG + " Keep at least 5 mm between the top of the appliance and", (600, 850, 560, 1100, 5, 20, 20, 100), None),
    ("lg", "fridge", "GB910", TYPES, (100, 101, 102, 107, 0, 50, 50, 50), None),
    ("lg", "fridge", "GB455", TYPES, (200, 201, 202, 207, 0, 50, 50, 50), None),
    ("lg", "fridge", "GB455", TYPES.replace("Allow over", "Allow"), (200, 201, 202, 207, None, None, None, None), "no clearance"),
    ("acme", "fridge", "X", FRIDGE, (None,) * 8, "no rules"),
    ("samsung", "fridge", None, None, (None,) * 8, "no dimensions"),
    (None, None, None, "", (None,) * 8, "no rules"),
])
def test_sheets_of_makers(spark, brand, cat, sku, text, want, problem):
    row = sheets.parse_sheets(spark.createDataFrame([(1, brand, cat, sku, text)], "id long, brand string, cat string, sku string, text string")).first()
    assert (tuple(row[f] for f in sheets.FIELDS), row.problem) == (want, problem)


def test_a_new_layout_is_another_row(spark):
    rule = sheets.Rule("acme", "fridge", "dimensions", 1, "whole", "first", r"(\d+) by (\d+) by (\d+)", "width_mm=1 height_mm=2 depth_mm=3")
    room = sheets.Rule("acme", "fridge", "clearance", 1, "whole", "first", "flush", "top_mm=:0 left_mm=:0 right_mm=:0 rear_mm=:0")
    row = sheets.parse_sheets(spark.createDataFrame([(1, "Acme", "fridge", "X", "600 by 1700 by 650, flush")], "id long, brand string, cat string, sku string, text string"), (*sheets.RULES, rule, room)).first()
    assert (row.width_mm, row.height_mm, row.depth_mm, row.rear_mm, row.problem) == (600, 1700, 650, 0, None)


def test_flags(spark):
    rows = spark.createDataFrame([(1, "fridge", "non-plumbed plumbed"), (2, "fridge", "Water  line"), (3, "dryer", "Heat Pump drain hose direct drain"), (4, "dryer", None), (5, "dishwasher", "Door reversal")], "id int, cat string, text string")
    got = rows.select("id", *(c.alias(n) for n, c in sheets.sheet_flags().items())).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(False, True, None), (True, True, None), (True, False, None), (False, True, None), (True, False, True)]


def merged(files, products):
    """The reference run: files in order into an index, products in order out of it."""

    def squash(x):
        return "".join(c for c in (x or "").lower() if c.isascii() and c.isalnum())

    by_id, by_sku, ambiguous, dropped = {}, {}, set(), set()
    for e in sorted(files, key=lambda e: e[0]):
        if e[1]:
            if e[1] in by_id:
                dropped.add(e[0])
                continue
            by_id[e[1]] = e[0]
        for token in dict.fromkeys(t for t in map(squash, e[2:5]) if t):
            if token in ambiguous:
                continue
            if token not in by_sku:
                by_sku[token] = e[0]
            elif by_sku[token] != e[0]:
                del by_sku[token]
                ambiguous.add(token)
                break
    used, out = set(), {}
    for p in sorted(products, key=lambda p: p[1]):
        found = by_id.get(p[0]) or next((by_sku[t] for t in map(squash, (p[2], p[3], p[0])) if t in by_sku), None)
        if found and found not in used:
            used.add(found)
            out[found] = p[0]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_evidence_is_matched_file_by_file(spark, seed):
    r = random.Random(seed)
    word = lambda: r.choice([None, "", "A12", "a-12", "A 1 2", "b7", "B-7", "c", "D/9", "e5", "F6", "g-7", "p3", "P-4"])
    files = [(f"f{k:03d}", r.choice([None, "", f"p{r.randrange(12)}"]), word(), word(), word()) for k in range(30)]
    products = [(f"p{k}", k, word(), word()) for k in range(25)]
    e = spark.createDataFrame(files, "evidence_id string, product_id string, model string, sku string, extracted_model string")
    p = spark.createDataFrame(products, "id string, ord int, model string, sku string")
    got = {x.evidence_id: x.id for x in resolve.match_evidence(e, p).collect()}
    assert got == merged(files, products)


def test_the_same_model_of_two_products_takes_the_named_one(spark):
    e = spark.createDataFrame([("RF730.json", "fridge-a", "RF730QNUVX1", "RF730QNUVX1")], "evidence_id string, product_id string, model string, sku string")
    p = spark.createDataFrame([("fridge-b", 0, "RF730QNUVX1"), ("fridge-a", 1, "RF730QNUVX1")], "id string, ord int, model string")
    # The first in order has the model and takes the file; the one that is named finds it used.
    assert [(x.id, x.by) for x in resolve.match_evidence(e, p).collect()] == [("fridge-b", "token")]
    q = spark.createDataFrame([("fridge-a", 0, "RF730QNUVX1"), ("fridge-b", 1, "RF730QNUVX1")], "id string, ord int, model string")
    assert [(x.id, x.by) for x in resolve.match_evidence(e, q).collect()] == [("fridge-a", "id")]
    assert resolve.match_evidence(e.limit(0), p).collect() == []


def test_manual_entries(spark):
    item = "array<struct<status:string,verified_at:string,extraction_date:string,source_url:string,pdf_url:string,has_pdf_evidence:boolean,source_type:string,sku:string>>"
    ok = ("approved", "2025-01-02T03", None, "https://a.example/x", None, None, "manual", "SKU9")
    manual = spark.createDataFrame([
        ("slug-1", 1, "Acme", "M1", [ok]), ("p1", 2, "Acme", "M1", []), ("x", 3, " ACME ", "m2", [("pending", "2024-01-01", None, None, None, None, None, "S"), ok]), ("y", 4, "acme", "other", [ok]),
        ("z", 5, "acme", "M3", [("approved", "soon", None, None, None, None, None, None)]), ("w", 6, "acme", "M3", [ok]), ("v", 7, "", "M4", [ok]), ("u", 8, "acme", "M5", None),
    ], f"key string, ord int, brand string, model string, items {item}")
    products = spark.createDataFrame([("p1", "slug-1", "acme", "M1"), ("p2", "", "Acme", " M2"), ("p3", None, "Acme", "sku9"), ("p4", None, "ACME", "M3"), ("p5", None, "", "M4"), ("p6", None, "acme", "M5"), ("p7", None, None, None)], "id string, slug string, brand string, model string")
    got = {x.id: x.evidence and x.evidence.asDict() for x in resolve.manual_evidence(products, manual).collect()}
    patch = {"has_pdf_evidence": True, "source_url": "https://a.example/x", "verified_at": "2025-01-02", "source_type": "manual"}
    assert got == {"p1": patch, "p2": patch, "p3": patch, "p4": None, "p5": None, "p6": None, "p7": None}


def test_energy_rows_take_any_headers(spark):
    a = spark.createDataFrame([("1", "Acme", "600.5 mm", "", "0", "")], "k string, Brand string, Width string, `Width (mm)` string, `New Star` string, Odd string")
    b = spark.createDataFrame([("2", "", "Late", "1,700", "n/a", "3.5")], "k string, Brand string, brand_2 string, height string, `Star2009` string, `Star Rating` string").withColumnRenamed("brand_2", "Brand Name")
    got = {r.k: r for r in outside.energy_rows(outside.as_maps([a, b], "k")).collect()}
    assert (got["1"].brand, got["1"].w, got["1"].h, got["1"].stars) == ("Acme", 601, None, None)
    assert (got["2"].brand, got["2"].w, got["2"].h, got["2"].stars) == ("Late", None, 1700, 4)
    newer = outside.ENERGY_HEADERS | {"w": ("integer", ("Breadth", *outside.ENERGY_HEADERS["w"][1]))}
    c = spark.createDataFrame([("3", "555", "600")], "k string, Breadth string, Width string")
    assert outside.energy_rows(outside.as_maps([c], "k"), newer).first().w == 555


def test_decisions_of_retailers(spark):
    text = "intro | no table\n| A & B | x | y | green RED-ish |\n|a and b|x|y|z|\n| C | RED |\n| D | reddish | credit | |yellow|\n|  | a | b | RED |"
    audit = spark.createDataFrame([("t", text), ("n", None)], "audit string, text string")
    assert {(r.retailer, r.decision) for r in outside.legal_decisions(audit).collect()} == {("a and b", "RED"), ("d", "YELLOW")}
    offers = spark.createDataFrame([("a AND b!",), ("D",), ("zz",), (None,)], "n string")
    got = {r.n: (r.decision, r.refused) for r in outside.decided(offers, outside.legal_decisions(audit)).collect()}
    assert got == {"a AND b!": ("RED", True), "D": ("YELLOW", False), "zz": ("UNKNOWN", False), None: ("UNKNOWN", False)}
