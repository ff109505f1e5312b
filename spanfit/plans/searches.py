"""Queries of many searches at once, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfit.operators import batch
from spanfit.operators.session import read_urls
from spanfit.plans.oracle import with_tables
from spanfit.sources import adapters

LABELS = {"fridge": "Refrigerators", "washing_machine": "Washing Machines", "dishwasher": "Dishwashers", "dryer": "Dryers"}


def search_log(spark, sf_dir):
    """Every event as a logged search URL: a category or none, one to three sizes, a tolerance, a mode; every eleventh in replacement mode."""
    k = F.col("event_id")
    size = lambda name, least, step, n, by: F.concat(F.lit(f"&{name}="), (least + step * ((k * by) % n)).cast("string"))
    url = F.concat(
        F.lit("?tol="), (k % 23).cast("string"), F.when(k % 5 != 0, F.concat(F.lit("&cat="), F.element_at(F.array(*map(F.lit, adapters.CATEGORIES)), (k % 4 + 1).cast("int")))).otherwise(""),
        F.when(k % 9 != 0, size("w", 500, 20, 23, 7)).otherwise(""), F.when(k % 7 != 0, size("h", 850, 50, 21, 11)).otherwise(""), F.when(k % 6 != 0, size("d", 520, 20, 15, 13)).otherwise(""),
        F.when(k % 8 == 0, F.lit("&mode=physical")).when(k % 8 == 1, F.lit("&mode=manufacturer")).otherwise(""), F.when(k % 11 == 0, F.concat(F.lit("&searchMode=replacement&replaceCat="), F.when(k % 2 == 0, F.lit("dryer")).otherwise("fridge"))).otherwise(""),
    )
    return read_urls(adapters.read(spark, sf_dir, "events").select(k.alias("search_id"), url.alias("query")))


def search_matches(spark, sf_dir):
    """The best 60 of every different search of the log."""
    return batch.batch_matches(search_log(spark, sf_dir), adapters.products(spark, sf_dir), adapters.rules(spark, sf_dir)).drop("fit_score")


def search_answers(spark, sf_dir):
    """What every search of the log is answered."""
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in LABELS.items() for x in p)), F.col("cat")), F.lit("Appliances"))
    return batch.batch_answers(search_log(spark, sf_dir), adapters.products(spark, sf_dir), label, adapters.rules(spark, sf_dir))


def replacement_runs(spark, sf_dir):
    """The whole replacement run for products asked for by name: those whose number is divisible by 100, against all."""
    p = adapters.products(spark, sf_dir)
    asked = p.where("ord % 100 = 0").select(F.col("ord").alias("ask"), F.concat("display_name", F.lit(" "), F.col("ord").cast("string")).alias("text"))
    return batch.replacement_runs(asked, p)


QUERIES = [search_matches, search_answers, replacement_runs]

_LOG = """(SELECT search_id, tolerance, cat, w, h, d, mode, replacing, source_cat, CASE WHEN replacing THEN 'physical' ELSE mode END || '|' || coalesce(cat, '*') AS scope,
    CASE WHEN replacing AND source_cat = 'dryer' THEN 'none' ELSE 'any' END AS towers FROM (SELECT event_id AS search_id, CASE WHEN event_id % 23 = 0 THEN 5 ELSE least(20, event_id % 23) END AS tolerance,
        CASE WHEN event_id % 5 <> 0 THEN ['fridge', 'washing_machine', 'dishwasher', 'dryer'][event_id % 4 + 1] END AS cat, CASE WHEN event_id % 9 <> 0 THEN CAST(500 + 20 * (event_id * 7 % 23) AS INTEGER) END AS w,
        CASE WHEN event_id % 7 <> 0 THEN CAST(850 + 50 * (event_id * 11 % 21) AS INTEGER) END AS h, CASE WHEN event_id % 6 <> 0 THEN CAST(520 + 20 * (event_id * 13 % 15) AS INTEGER) END AS d,
        CASE event_id % 8 WHEN 0 THEN 'physical' WHEN 1 THEN 'manufacturer' ELSE 'practical' END AS mode, event_id % 11 = 0 AS replacing, CASE WHEN event_id % 2 = 0 THEN 'dryer' ELSE 'fridge' END AS source_cat FROM events))"""
_NEED = """(SELECT p.*, 'physical' AS mode, p.w AS nw, p.h AS nh, p.d AS nd FROM products p UNION ALL SELECT p.*, 'practical', p.w + 10, p.h + 20, p.d + 10 FROM products p
    UNION ALL SELECT p.*, 'manufacturer', p.w + 2 * coalesce(r.side, 5), p.h + coalesce(r.top, 20), p.d + coalesce(r.rear, 10) FROM products p LEFT JOIN rules r ON r.cat = p.cat AND r.brand = p.brand)"""


def _axis(a: str) -> str:
    return f"CASE WHEN s.{a} IS NULL THEN 0e0 ELSE greatest(-0.05e0, least(0.5e0, CAST(s.{a} - n.n{a} AS DOUBLE) / s.{a})) END"


def _ranked(shapes: str) -> str:
    return f"""(SELECT s.*, n.id, sort_score, row_number() OVER (PARTITION BY s.scope, s.towers, s.w, s.h, s.d ORDER BY sort_score, n.priority DESC, n.display_name, n.ord) AS rank FROM {shapes} s
        JOIN {_NEED} n ON n.mode = split_part(s.scope, '|', 1) AND split_part(s.scope, '|', 2) IN ('*', n.cat) AND (s.w IS NULL OR n.nw <= s.w) AND (s.h IS NULL OR n.nh <= s.h) AND (s.d IS NULL OR n.nd <= s.d),
        LATERAL (SELECT ({" + ".join(_axis(a) for a in "whd")}) / ((s.w IS NOT NULL)::INT + (s.h IS NOT NULL)::INT + (s.d IS NOT NULL)::INT) AS sort_score) QUALIFY rank <= 60)"""


_SHAPES = f"(SELECT DISTINCT scope, towers, w, h, d FROM {_LOG} WHERE w IS NOT NULL OR h IS NOT NULL OR d IS NOT NULL)"
_SQUASH, _PLAIN = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')", "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_CODE = "coalesce(list_filter(string_split(" + _PLAIN + ", ' '), lambda t: length(t) >= 4 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]'))[1], '')"
_ASKED = f"""(SELECT ord AS ask, {_SQUASH.format(x="t")} AS q, {_PLAIN.format(x="t")} AS t, {_CODE.format(x="t")} AS qc FROM (SELECT ord, display_name || ' ' || ord AS t FROM products WHERE ord % 100 = 0))"""
_NAMED = f"""(SELECT *, {_SQUASH.format(x="model")} AS pm, {_CODE.format(x="model")} AS pc, {_PLAIN.format(x="brand || ' ' || model")} AS bm, {_PLAIN.format(x="display_name")} AS dn FROM products)"""
_SOURCES = f"""(SELECT ask, p.id AS source, p.cat, p.w + 10 AS w, p.h + 20 AS h, p.d + 10 AS d, CASE WHEN s >= 90 THEN 'high' WHEN s >= 75 THEN 'medium' ELSE 'low' END AS confidence FROM {_ASKED} a, {_NAMED} p,
    LATERAL (SELECT CASE WHEN qc <> '' AND pc = qc THEN 98 WHEN length(qc) >= 5 AND starts_with(pc, qc) THEN 96 WHEN length(qc) >= 5 AND starts_with(pm, qc) THEN 94 WHEN pm = q THEN 100 WHEN contains(q, pm) THEN 95 WHEN contains(pm, q) THEN 90
        WHEN contains(bm, t) THEN 84 WHEN contains(dn, t) THEN 78 ELSE 0 END AS s) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY ask ORDER BY s DESC, display_name, p.ord) = 1)"""


def oracle() -> dict[str, str]:
    return {
        "search_matches": with_tables(f"SELECT scope, towers, w, h, d, CAST(rank AS INTEGER) AS rank, id, sort_score FROM {_ranked(_SHAPES)}"),
        "search_answers": with_tables(f"""SELECT search_id, shown AS exact, shown AS relaxed, best, shown || ' exact matches.' AS title,
            CASE WHEN shown > 0 THEN shown || ' fit with +' || tolerance || 'mm tolerance.' ELSE 'No ' || lower(label) || ' fit yet. Try a preset or relax the tolerance.' END AS detail, CASE WHEN shown > 0 THEN 'Relax to ' || tolerance || 'mm' ELSE 'Try a preset' END AS action
            FROM (SELECT l.*, coalesce(n, 0) AS shown, coalesce(top, '') AS best, CASE l.cat WHEN 'fridge' THEN 'Refrigerators' WHEN 'washing_machine' THEN 'Washing Machines' WHEN 'dishwasher' THEN 'Dishwashers' WHEN 'dryer' THEN 'Dryers' ELSE 'Appliances' END AS label
            FROM {_LOG} l LEFT JOIN (SELECT scope, towers, w, h, d, count(*) AS n, string_agg(id, ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS top FROM {_ranked(_SHAPES)} GROUP BY ALL) b
            ON l.scope = b.scope AND l.towers = b.towers AND l.w IS NOT DISTINCT FROM b.w AND l.h IS NOT DISTINCT FROM b.h AND l.d IS NOT DISTINCT FROM b.d)"""),
        "replacement_runs": with_tables(f"""SELECT ask, source, confidence, w, h, d, CAST(rank AS INTEGER) AS rank, id FROM (SELECT ord AS ask FROM products WHERE ord % 100 = 0) LEFT JOIN {_SOURCES} USING (ask)
            LEFT JOIN (SELECT ask, rank, id FROM (SELECT ask, 'physical|' || cat AS scope, cat AS towers, w, h, d FROM {_SOURCES}) JOIN {_ranked(f"(SELECT DISTINCT 'physical|' || cat AS scope, cat AS towers, w, h, d FROM {_SOURCES})")} USING (scope, towers, w, h, d)) USING (ask)"""),
    }
