"""Queries of records that come from outside: spec sheets, energy rows, evidence files, decisions, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfit.functions import columns as c
from spanfit.operators import evidence, fit, outside, sheets, validators
from spanfit.operators import resolve as r
from spanfit.operators.similar import dealt
from spanfit.plans.oracle import with_tables
from spanfit.sources import adapters

#: Sheets planted before a document's text, by its number modulo 6; {w}, {h}, {d} and {c} are numbers of the document.
PLANTED = (
    ("Samsung", "fridge", "RF1", "Refrigerator user manual\nInstallation requirements\nClearance\n01 {c} mm 10 mm\nSpecifications\nWidth (mm) {w}\nHeight (mm) {h}\nDepth w. Door (mm) {d}\nMemo\n"),
    ("samsung ", "washing_machine", "WW90BB2", "Front loading washing machine\nAlcove installation\nminimum clearance\nSides Top Front Rear\n{c} mm 25 mm 550 mm 50 mm\nSpecification sheet\nModel name WW70AA****\nDimensions\nWidth 1 mm\nHeight 2 mm\nDepth 3 mm\nModel name WW90BB****\nDimensions\nWidth {w} mm\nHeight {h} mm\nDepth {d}.4 mm\nMemo\n"),
    ("LG", "dishwasher", "XD3", "Dishwasher manual\nDimension (Width X Height X Depth) {w} mm X {h} mm X {d} mm\nallow minimum clearance of at least {c} mm between the appliance and an adjacent cabinet or wall\n"),
    ("westinghouse", "fridge", "WBE4500", "Fridge\nmodel height width depth open\nWBE4500SC-L {h} {w} {d} 1200\nWBE4500 {h} {w} {d} 1200\nAirspace side top rear\nWBE4500 {c} 50 20\n"),
    ("samsung", "dryer", "DV9", "Heat Pump Dryer\nnothing else\n"),
    ("lg", "fridge", "GB1", "Dishwasher leaflet\nSize (mm)\n"),
)


def sheet_values(spark, sf_dir):
    """Every document with a sheet before it, read by its maker's rules."""
    k = F.col("doc_id")
    pick = lambda at: F.element_at(F.array(*(F.lit(p[at]) for p in PLANTED)), (k % len(PLANTED) + 1).cast("int"))
    sheet = pick(3)
    for name, number in (("w", 500 + k % 400), ("h", 800 + k % 900), ("d", 500 + k % 200), ("c", k % 60)):
        sheet = F.replace(sheet, F.lit(f"{{{name}}}"), number.cast("string"))
    rows = adapters.read(spark, sf_dir, "documents").select(k.alias("id"), pick(0).alias("brand"), pick(1).alias("cat"), pick(2).alias("sku"), F.concat(sheet, F.coalesce("text", F.lit(""))).alias("text"))
    return sheets.parse_sheets(rows)


def manual_evidence(spark, sf_dir):
    """Every product with the manual entry that is its own: by slug, id, or brand with model or SKU; one in three has none."""
    p = adapters.products(spark, sf_dir).withColumn("slug", F.concat(F.lit("s-"), "id"))
    k = F.col("ord")
    item = lambda status, day, url: F.struct(status.alias("status"), day.alias("verified_at"), F.lit("2024-05-06T07").alias("extraction_date"), url.alias("source_url"), F.lit("http://pdf.example.org/x").alias("pdf_url"), F.when(k % 2 == 0, False).alias("has_pdf_evidence"), F.lit(" ").alias("source_type"), F.concat(F.lit(" "), F.upper("model")).alias("sku"))
    items = F.array(item(F.lit("pending"), F.lit("2020-01-01"), F.lit("https://no.example.org")), item(F.when(k % 12 != 0, "approved").otherwise("rejected"), F.when(k % 5 != 0, "2025-01-02"), F.when(k % 4 == 1, "https://docs.example.org/a").when(k % 4 == 2, "ftp://x")))
    manual = p.where("ord % 3 <> 0").select(F.when(k % 3 == 1, F.when(k % 2 == 0, F.col("slug")).otherwise(F.col("id"))).otherwise(F.concat(F.lit("other-"), "id")).alias("key"), (k * 2).alias("ord"), F.upper("brand").alias("brand"), F.when(k % 6 == 2, F.col("model")).alias("model"), items.alias("items"))
    rows = r.manual_evidence(p, manual.unionByName(manual.where("ord % 7 = 0").withColumns({"ord": F.col("ord") + 1, "key": F.concat(F.lit("late-"), "key"), "items": F.filter("items", lambda x: F.lit(False))})))
    return rows.select("id", "evidence.has_pdf_evidence", "evidence.source_url", "evidence.verified_at", "evidence.source_type")


def energy_rows(spark, sf_dir):
    """Every product's energy row, under headers of three generations."""
    p, k = adapters.products(spark, sf_dir), F.col("ord")
    text = lambda c: F.col(c).cast("string")
    new = p.where("ord % 3 = 0").select("id", "cat", F.col("brand").alias("Brand"), F.col("model").alias("Model No"), F.concat(text("w"), F.lit(" mm")).alias("Width"), text("h").alias("Height"), F.lit("").alias("Depth"), text("d").alias("Depth (mm)"), (k % 900).cast("string").alias("Labelled energy consumption (kWh/year)"), F.concat((k % 15).cast("string"), F.lit(".5")).alias("New Star"))
    old = p.where("ord % 3 = 1").select("id", "cat", F.col("brand").alias("Brand Name"), F.col("model").alias("Model Name"), F.lit("n/a").alias("width"), text("h").alias("height"), F.concat(text("d"), F.lit(".49")).alias("depth"), F.lit("1,234 kWh").alias("Annual Energy Consumption"), F.lit("none").alias("Star2009"), text("stars").alias("Star Rating"), F.lit("-").alias("Door Swing"))
    plain = p.where("ord % 3 = 2").select("id", "cat", "brand", text("w").alias("Width (mm)"), text("stars").alias("stars"), F.lit("12.5").alias("door_swing_mm"))
    return outside.energy_rows(outside.as_maps([new, old, plain], "id", "cat")).drop("row")


def retailer_decisions(spark, sf_dir):
    """Offers by what an audit of their retailers decided; the audit is a table in a text."""
    table = F.lit("# Audit\n| Retailer | Terms | Robots | Decision |\n| --- | --- | --- | --- |\n| JB Hi-Fi | fine | fine | Green, not red |\n| jb  hi fi | - | - | YELLOW |\n| The Good Guys | ok | ok | GREEN |\n| Bing Lee | ok | yellow |\n| Harvey Norman | ok | ok | amber |\n|Appliances Online|a|b|yellow|\n")
    audit = spark.range(1).select(F.lit("2026").alias("audit"), table.alias("text"))
    return outside.decided(adapters.offers(spark, sf_dir), outside.legal_decisions(audit)).groupBy("decision", "refused").agg(F.count("*").alias("n"))


def record_errors(spark, sf_dir):
    """What is wrong with every product's record, extracted sheet and manual entry, some of which are broken on purpose."""
    p, k = dealt(adapters.products(spark, sf_dir), "ord"), F.col("ord")  # small rows that take long
    quoted = F.when(k % 5 == 0, F.concat(F.lit('"'), F.col("w").cast("string"), F.lit('"'))).otherwise(F.col("w").cast("string"))
    product = F.concat(
        F.lit('{"id": "'), "id", F.lit('", "cat": "'), "cat", F.lit('", "brand": "'), F.when(k % 7 == 0, " ").otherwise("b"), F.lit('", "model": "m", "emoji": "e", "w": '), quoted, F.lit(', "h": '), F.col("h").cast("string"), F.lit(', "d": 650.0, "kwh_year": 300, "stars": '), F.when(k % 11 == 0, "7").otherwise("4"),
        F.lit(', "price": null, "door_swing_mm": '), F.when(k % 13 == 0, "200").otherwise("0"), F.lit(', "features": [], "retailers": [{"n": "r", "url": "u", "p": '), F.when(k % 17 == 0, "-1").otherwise("5"), F.lit('}], "sponsored": false, "unavailable": true'), F.when(k % 19 == 0, ', "evidence": {"has_pdf_evidence": true, "verified_at": "2024-13-01"}').otherwise(""), F.lit("}"),
    )
    sheet = F.concat(F.lit('{"brand": "b", "model": "m", "category": "Washer", "dimensions_mm": {"height": '), F.col("h").cast("string"), F.lit(', "width": '), F.when(k % 5 == 0, "0.2").otherwise("600.4"), F.lit(', "depth": 600}, "confidence": "low", "source_pdf_url": "'), F.when(k % 7 == 0, "ftp://x").otherwise("https://e.org/x"), F.lit('", "extraction_date": "2024-05-06T07:08:09Z"}'))
    entry = F.concat(F.lit('{"type": "spec_sheet", "status": "'), F.when(k % 3 == 0, "seen").otherwise("approved"), F.lit('", "source_url": "https://e.org/x", "local_path": "'), F.when(k % 5 == 0, "/").otherwise(""), F.lit('a.pdf"'), F.when(k % 9 != 0, "}").otherwise(""))
    docs = p.select("id", F.try_parse_json(product).alias("p"), validators.normalised(F.try_parse_json(sheet)).alias("s"), F.try_parse_json(entry).alias("m"))
    found = F.concat(*(F.transform(e, _named(kind)) for kind, e in (("product", validators.errors(F.col("p"), validators.PRODUCT)), ("sheet", validators.errors(F.col("s"), validators.EXTRACTED, validators.EXTRACTED_KEYS)), ("entry", validators.errors(F.col("m"), validators.MANUAL)))))
    return docs.select("id", F.explode(found).alias("error"))


MANUALS = (("Spec sheet", "a.pdf"), ("Quick reference", "guide.PDF?x=1"), ("User manual", "manual.pdf#p"), ("Energy label", "label.pdf"), ("Specification", "spec.html"))


def best_manual(spark, sf_dir):
    """Every offer as a listed manual of its product; the best of each."""
    o, k = adapters.offers(spark, sf_dir), F.col("pos") % len(MANUALS)
    pick = lambda at: F.element_at(F.array(*(F.lit(m[at]) for m in MANUALS)), (k + 1).cast("int"))
    return evidence.best_manual(o.select(F.col("product_id").alias("id"), pick(0).alias("name"), F.lit(None).cast("string").alias("description"), F.concat(F.lit("https://m.example.org/"), F.col("pos").cast("string"), F.lit("/"), pick(1)).alias("url"), F.when(F.col("pos") % 2 == 0, 5).alias("place"), "pos"))


def fallback_documents(spark, sf_dir):
    """Scores of third parties' documents for every offer's product."""
    rows = adapters.offers(spark, sf_dir).join(adapters.products(spark, sf_dir), F.col("product_id") == F.col("id"))
    site = F.element_at(F.array(*map(F.lit, ("commercial.appliancesonline.com.au/", "www.manualslib.com/", "away.example.org/"))), (F.col("pos") % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://"), site, F.when(F.col("pos") % 2 == 0, F.regexp_replace("model", "[^A-Za-z0-9]+", "-")).otherwise("x"), F.when(F.col("pos") % 5 == 0, "-guide.pdf").otherwise(".html"))
    score = evidence.fallback_score(url, F.col("model"), F.col("brand"), F.col("pos") % 3 < 2)
    return rows.select(score.alias("score")).groupBy("score").agg(F.count("*").alias("n"))


def parsed_fields(spark, sf_dir):
    """Texts of sizes and names of every product, read and normalised."""
    k, w = F.col("ord"), F.col("w").cast("string")
    size = F.when(k % 4 == 0, F.concat(F.lit(" "), w, F.lit(".5 "))).when(k % 4 == 1, F.concat(w, F.lit("mm"))).when(k % 4 == 2, w).otherwise("0.4")
    short = F.when(k % 3 == 0, F.concat(F.floor(F.col("w") / 10).cast("string"), F.lit(",5"))).when(k % 3 == 1, w).otherwise("-5")
    name = F.concat(F.lit(" "), "display_name", F.lit(" & Co. "))
    return adapters.products(spark, sf_dir).select(
        "id", c.to_mm(size).alias("mm"), c.cm_shorthand(short).alias("from_cm"), c.squash(name).alias("squashed"), c.plain_words(name).alias("words"), c.slug(name).alias("slug"), c.slug(name, 12).alias("short_slug"), c.fold(F.concat(F.lit("  A  B "), "brand")).alias("folded"), c.number_in(F.concat(F.lit("1,"), w, F.lit(" kWh"))).alias("number")
    )


def towers(spark, sf_dir):
    """Towers among products, by category or by what their texts say, and what replaces what."""
    k = F.col("ord")
    rows = adapters.products(spark, sf_dir).withColumns({"display_name": F.when(k % 7 == 0, F.concat("display_name", F.lit(" Wash  Tower"))).otherwise(F.col("display_name")), "model": F.when(k % 11 == 0, F.concat(F.lit("x WK"), k.cast("string"))).otherwise(F.col("model")), "cat": F.when(k % 13 == 0, "washtower_combo").otherwise(F.col("cat"))})
    found = rows.withColumn("tower", fit.is_tower(rows))
    tall = fit.not_quarantined(rows, fit.FitQuery(h=1000, replacement=True, source_category="fridge")).groupBy("cat").agg(F.count("*").alias("n_replacing"))
    return found.groupBy("cat").agg(F.count(F.when(F.col("tower"), 1)).alias("n_towers"), F.count("*").alias("n")).join(tall, "cat", "left")


def best_limited(spark, sf_dir):
    """The result limit: at least one row, also where none is asked for."""
    p = adapters.products(spark, sf_dir)
    each = [fit.find_matches(p, fit.FitQuery(w=700, cat="dryer"), limit=n).select(F.lit(n).alias("asked"), "id") for n in (0, 1, 7)]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _named(kind):
    return lambda x: F.concat(F.lit(f"{kind} "), x)


QUERIES = [sheet_values, manual_evidence, energy_rows, retailer_decisions, record_errors, best_manual, fallback_documents, parsed_fields, towers, best_limited]

_SQ = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
_SHEET = "CASE doc_id % 6 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} END"


def _by_sheet(name: str, *values: object) -> str:
    return f"CAST({_SHEET.format(*('NULL' if v is None else v for v in values))} AS INTEGER) AS {name}"


_W, _H, _D, _C = "500 + doc_id % 400", "800 + doc_id % 900", "500 + doc_id % 200", "doc_id % 60"
ORACLE = {
    "sheet_values": f"""SELECT doc_id AS id, {_by_sheet("width_mm", _W, _W, _W, _W)}, {_by_sheet("height_mm", _H, _H, _H, _H)}, {_by_sheet("depth_mm", _D, _D, _D, _D)}, {_by_sheet("door_open_90_depth_mm", None, None, None, 1200)},
        {_by_sheet("top_mm", _C, 25, 0, 50)}, {_by_sheet("left_mm", _C, _C, _C, _C)}, {_by_sheet("right_mm", _C, _C, _C, _C)}, {_by_sheet("rear_mm", _C, 50, 0, 20)},
        CASE doc_id % 6 WHEN 4 THEN 'no dimensions' WHEN 5 THEN 'the text is about dishwasher' END AS problem FROM documents""",
    "manual_evidence": """SELECT id, CASE WHEN good THEN ord % 2 <> 0 END AS has_pdf_evidence, CASE WHEN good THEN CASE WHEN ord % 4 = 1 THEN 'https://docs.example.org/a' ELSE 'http://pdf.example.org/x' END END AS source_url,
        CASE WHEN good THEN CASE WHEN ord % 5 <> 0 THEN '2025-01-02' ELSE '2024-05-06' END END AS verified_at, CAST(NULL AS VARCHAR) AS source_type FROM (SELECT *, ord % 3 <> 0 AND ord % 12 <> 0 AS good FROM products)""",
    "energy_rows": """SELECT id, cat, brand, CASE WHEN ord % 3 < 2 THEN model END AS model, CASE WHEN ord % 3 <> 1 THEN w END AS w, CASE WHEN ord % 3 < 2 THEN h END AS h, CASE WHEN ord % 3 < 2 THEN d END AS d, CAST(CASE ord % 3 WHEN 0 THEN ord % 900 WHEN 1 THEN 1234 END AS INTEGER) AS kwh_year,
        CAST(CASE WHEN ord % 3 > 0 THEN stars WHEN ord % 15 + 1 BETWEEN 1 AND 6 THEN ord % 15 + 1 END AS INTEGER) AS stars, CASE WHEN ord % 3 = 2 THEN 12.5e0 END AS door_swing_mm FROM products""",
    "retailer_decisions": "SELECT decision, decision = 'RED' AS refused, count(*) AS n FROM (SELECT CASE n WHEN 'JB Hi-Fi' THEN 'RED' WHEN 'The Good Guys' THEN 'GREEN' WHEN 'Appliances Online' THEN 'YELLOW' ELSE 'UNKNOWN' END AS decision FROM offers) GROUP BY decision",
    "best_manual": """SELECT product_id AS id, 'https://m.example.org/' || pos || '/' || file AS url, score FROM (SELECT *, ['a.pdf', 'guide.PDF?x=1', 'manual.pdf#p', 'label.pdf'][pos % 5 + 1] AS file, CAST([50, 25, 10, -20, -100][pos % 5 + 1] AS INTEGER) AS score FROM offers) WHERE score >= 0
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, CASE WHEN pos % 2 = 0 THEN 5 ELSE 999 END, pos) = 1""",
    "fallback_documents": f"""SELECT CAST(CASE WHEN pos % 3 = 2 THEN -1000 ELSE CASE WHEN pos % 5 = 0 THEN 50 ELSE 0 END + CASE WHEN contains(u, {_SQ.format('model')}) THEN 50 ELSE 0 END + CASE WHEN contains(u, {_SQ.format('brand')}) THEN 10 ELSE 0 END
        + CASE WHEN regexp_matches(url, '(?i)spec|data|dimension|install|manual|guide|qrg') THEN 12 ELSE 0 END + CASE WHEN pos % 3 = 0 THEN 18 ELSE 4 END END AS INTEGER) AS score, count(*) AS n FROM (SELECT *, {_SQ.format('url')} AS u FROM (SELECT o.pos, p.model, p.brand,
        'https://' || ['commercial.appliancesonline.com.au/', 'www.manualslib.com/', 'away.example.org/'][o.pos % 3 + 1] || CASE WHEN o.pos % 2 = 0 THEN regexp_replace(p.model, '[^A-Za-z0-9]+', '-', 'g') ELSE 'x' END || CASE WHEN o.pos % 5 = 0 THEN '-guide.pdf' ELSE '.html' END AS url
        FROM offers o JOIN products p ON p.id = o.product_id)) GROUP BY 1""",
    "parsed_fields": r"""SELECT id, CAST(CASE ord % 4 WHEN 0 THEN w + 1 WHEN 2 THEN w END AS INTEGER) AS mm, CAST(CASE ord % 3 WHEN 0 THEN (w // 10) * 10 + 5 WHEN 1 THEN w END AS INTEGER) AS from_cm, regexp_replace(n, '[^a-z0-9]+', '', 'g') AS squashed, trim(regexp_replace(n, '[^a-z0-9]+', ' ', 'g')) AS words,
        s AS slug, regexp_replace(substr(s, 1, 12), '-+$', '') AS short_slug, 'a b ' || lower(brand) AS folded, CAST('1' || w AS DOUBLE) AS number FROM (SELECT *, trim(regexp_replace(n, '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT *, lower(display_name) || ' & co. ' AS n FROM products))""",
    "towers": """SELECT cat, count(*) FILTER (WHERE tower) AS n_towers, count(*) AS n, nullif(count(*) FILTER (WHERE NOT tower OR h < 1200), 0) AS n_replacing FROM (SELECT CASE WHEN ord % 13 = 0 THEN 'washtower_combo' ELSE cat END AS cat, h, ord % 7 = 0 OR ord % 11 = 0 OR ord % 13 = 0 AS tower FROM products) GROUP BY 1""",
    "best_limited": """SELECT n AS asked, id FROM (SELECT id, row_number() OVER (ORDER BY 700 - w - 10, priority DESC, display_name, ord) AS k FROM products WHERE cat = 'dryer' AND w <= 690), (VALUES (0), (1), (7)) v(n) WHERE k <= greatest(1, n)""",
    "record_errors": """SELECT id, unnest(list_filter([CASE WHEN ord % 7 = 0 THEN 'product brand: text' END, CASE WHEN ord % 5 = 0 THEN 'product w: integer' END, CASE WHEN ord % 11 = 0 THEN 'product stars: range' END, CASE WHEN ord % 13 = 0 THEN 'product door_swing_mm: range' END,
        CASE WHEN ord % 17 = 0 THEN 'product retailers[0].p: range' END, CASE WHEN ord % 19 = 0 THEN 'product evidence.verified_at: date' END, CASE WHEN ord % 5 = 0 THEN 'sheet dimensions.width_mm: range' END, CASE WHEN ord % 7 = 0 THEN 'sheet metadata.source_pdf_url: url' END,
        CASE WHEN ord % 9 = 0 THEN 'entry record: object' END, CASE WHEN ord % 3 = 0 AND ord % 9 > 0 THEN 'entry status: one of' END, CASE WHEN ord % 5 = 0 AND ord % 9 > 0 THEN 'entry local_path: unlike' END], lambda e: e IS NOT NULL)) AS error FROM products""",
}


def oracle() -> dict[str, str]:
    return {name: with_tables(q) for name, q in ORACLE.items()}
