"""The logical tables as SQL, for the twins of the queries."""

from __future__ import annotations

import re

PRODUCT_URL = r"""(regexp_matches({u}, '^https?://[^/?#]+/[^?#]*[^/?#]') AND NOT regexp_matches({u}, '[?&](q|query|searchterm|text|keyword)(=|&|$)')
    AND NOT regexp_matches(lower({u}), '^https?://[^/?#]+[^?#]*/(search|searchdisplay|catalogsearch|collections?|category|categories|cart|checkout)(/|$|\?)')
    AND CASE WHEN regexp_matches({u}, '^https?://[^/?#]*jbhifi\.com\.au/') THEN regexp_matches({u}, '\.au/products/')
        WHEN regexp_matches({u}, '^https?://[^/?#]*appliances-?online\.com\.au/') THEN regexp_matches({u}, '\.au/product/')
        WHEN regexp_matches({u}, '^https?://[^/?#]*binglee\.com\.au/') THEN regexp_matches({u}, '\.au/products/')
        WHEN regexp_matches({u}, '^https?://[^/?#]*harveynorman\.com\.au/') THEN regexp_matches({u}, '\.html$')
        WHEN regexp_matches({u}, '^https?://[^/?#]*thegoodguys\.com\.au/') THEN regexp_matches({u}, '\.au/[^/]+-[^/]+$')
        ELSE {other} END)"""

TABLES = {
    "products": """SELECT p_partkey AS ord, 'p' || CAST(p_partkey AS VARCHAR) AS id,
        CASE p_partkey % 4 WHEN 0 THEN 'fridge' WHEN 1 THEN 'washing_machine' WHEN 2 THEN 'dishwasher' ELSE 'dryer' END AS cat,
        p_brand AS brand, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS model, p_brand || ' ' || p_name AS display_name, p_type AS type,
        CAST(450 + (p_partkey * 37) % 500 AS INTEGER) AS w, CAST(800 + (p_partkey * 53) % 1200 AS INTEGER) AS h,
        CAST(500 + (p_partkey * 29) % 300 AS INTEGER) AS d, 1 + p_size % 6 AS stars,
        CASE WHEN p_partkey % 5 <> 0 THEN CAST(floor(p_retailprice) AS INTEGER) END AS price, p_partkey % 3 = 0 AS unavailable,
        CAST((p_partkey * 7) % 101 AS INTEGER) AS priority FROM part""",
    "rules": """SELECT cat, brand, CAST(5 * (n % 5) AS INTEGER) AS side, CAST(10 * (n % 3) AS INTEGER) AS rear, CAST(15 * (n % 4) AS INTEGER) AS top
        FROM (SELECT DISTINCT cat, brand, CAST(substr(brand, 7) AS INTEGER) AS n FROM products) WHERE n % 4 <> 0""",
    "offers": """SELECT 'p' || CAST(l_partkey AS VARCHAR) AS product_id, l_suppkey AS pos,
        CASE l_suppkey % 6 WHEN 0 THEN 'JB Hi-Fi' WHEN 1 THEN 'Appliances Online' WHEN 2 THEN 'Harvey Norman' WHEN 3 THEN 'The Good Guys' WHEN 4 THEN 'Bing Lee' ELSE any_value(s_name) END AS n,
        CASE l_suppkey % 6 WHEN 0 THEN 'https://www.jbhifi.com.au/products/item-' || CAST(l_partkey AS VARCHAR)
            WHEN 1 THEN 'https://www.appliancesonline.com.au/product/item-' || CAST(l_partkey AS VARCHAR) || '/'
            WHEN 2 THEN 'https://www.harveynorman.com.au/item-' || CAST(l_partkey AS VARCHAR) || '.html'
            WHEN 3 THEN 'https://www.thegoodguys.com.au/item-' || CAST(l_partkey AS VARCHAR)
            WHEN 4 THEN 'https://www.binglee.com.au/search?q=item' || CAST(l_partkey AS VARCHAR)
            ELSE 'https://shop.example.org/appliance/' || CAST(l_partkey AS VARCHAR) END AS url,
        CAST(floor(min(l_extendedprice / l_quantity)) AS INTEGER) AS p, CAST(max(l_shipdate) AS DATE) AS verified_at
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey, l_suppkey""",
    "links": f"""SELECT *, {PRODUCT_URL.format(u="url", other="TRUE")} AS lenient, {PRODUCT_URL.format(u="url", other="FALSE")} AS strict FROM offers""",
    "per_product": """SELECT product_id, count(*) AS n_offers, bool_or(lenient) AS linked, bool_or(strict) AS verified, count(*) FILTER (WHERE strict) AS n_strict,
        count(*) FILTER (WHERE lenient) AS n_lenient, min(p) FILTER (WHERE p > 0) AS min_p, max(p) AS max_p, max(verified_at) AS checked FROM links GROUP BY product_id""",
    "catalog": """SELECT products.*, coalesce(n_offers, 0) AS n_offers, coalesce(linked, FALSE) AS linked, coalesce(verified, FALSE) AS verified, coalesce(n_strict, 0) AS n_strict,
        coalesce(n_lenient, 0) AS n_lenient, min_p, max_p, checked, NOT unavailable AND coalesce(linked, FALSE) AS current FROM products LEFT JOIN per_product ON id = product_id""",
    "rum": """SELECT CASE event_type WHEN 'view' THEN 'LCP' WHEN 'click' THEN 'INP' WHEN 'purchase' THEN 'CLS' WHEN 'signup' THEN 'TTFB' END AS metric,
        '/u/' || CAST(user_id AS VARCHAR) AS path, value, ts, event_id FROM events""",
    "errors": """SELECT 'E' || (props::JSON->>'k') AS message, '/s/' || CAST(user_id AS VARCHAR) || '.js' AS source, CAST(floor(value) AS INTEGER) AS line, ts, user_id, event_id
        FROM events WHERE event_type = 'error'""",
    "gsc": """SELECT doc_id AS ord, array_to_string(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')[1:4], ' ') AS query, '/d/' || source AS page,
        CAST(doc_id % 7 AS INTEGER) AS clicks, CAST(n_chars AS INTEGER) AS impressions, CAST(1 + doc_id % 40 AS DOUBLE) AS position, CASE WHEN n_chars > 0 THEN CAST(doc_id % 7 AS DOUBLE) / n_chars ELSE 0e0 END AS ctr FROM documents""",
    "sitemap": """SELECT *, 'https://www.example.org/p/' || slug AS url FROM (SELECT trim(regexp_replace(lower(display_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM products
        UNION SELECT trim(regexp_replace(lower(query), '[^a-z0-9]+', '-', 'g'), '-') || 's' FROM gsc WHERE ord % 2 = 0)""",
}


def fit_sql(w: int | None, h: int | None, d: int | None, cat: str | None = None, mode: str = "practical", replacement: bool = False) -> str:
    """Rows that fit, with gaps and scores, as a subquery over `catalog` (and `rules` in mode manufacturer)."""
    size = {a: v for a, v in (("w", w), ("h", h), ("d", d)) if v}
    literal = {"physical": (0, 0, 0), "practical": (5, 20, 10)}.get(mode)
    own = ("side", "top", "rear") if literal else ("coalesce(r.side, 5)", "coalesce(r.top, 20)", "coalesce(r.rear, 10)")
    side, top, rear = map(str, literal) if literal else own
    need = {"w": f"2 * ({side})", "h": f"({top})", "d": f"({rear})"}
    taken = dict.fromkeys(need, "0") if replacement else need
    gap = {a: f"({v} - c.{a} - {taken[a]})" for a, v in size.items()}
    axis = {a: f"least(0.5e0, greatest(-0.05e0, CAST({gap[a]} AS DOUBLE) / {v}e0))" for a, v in size.items()}
    weight = {"w": "0.4e0", "h": "0.3e0", "d": "0.3e0"}
    score = "0e0" + "".join(f" + least(1e0, (CAST(greatest(0, {gap[a]}) AS DOUBLE) / {v}e0) / 0.2e0) * {weight[a]}" for a, v in size.items())
    tight = f"least({', '.join(gap.values())})" if len(gap) > 1 else next(iter(gap.values()))
    numeric = "CAST(NULL AS INTEGER)" if replacement else f"CAST(least(100, greatest(0, floor(({score}) * 100e0 * CASE WHEN {tight} < 5 THEN 0.85e0 WHEN {tight} < 10 THEN 0.95e0 ELSE 1e0 END + 0.5e0))) AS INTEGER)"
    first = "CASE " + " ".join(f"WHEN {gap[a]} = {tight} THEN '{ {'w': 'width', 'h': 'height', 'd': 'depth'}[a] }'" for a in size) + " END"
    out = "".join(f", CAST({g} AS INTEGER) AS gap_{a}" for a, g in gap.items())
    out += "".join(f", CAST(c.{a} + {need[a]} AS INTEGER) AS required_{a}, CAST({size.get(a, 0)} - c.{a} AS INTEGER) AS size_gap_{a}" for a in "whd")
    where = " AND ".join([*(f"{g} >= 0" for g in gap.values()), *([f"c.cat = '{cat}'"] if cat else [])])
    join = "" if literal else " LEFT JOIN rules r ON r.cat = c.cat AND r.brand = c.brand"
    return f"""(SELECT c.*{out}, ({' + '.join(axis.values())}) / {len(axis)}e0 AS sort_score, {numeric} AS fit_score_numeric, {first} AS binding_axis, CAST({tight} AS INTEGER) AS tightest_gap_mm
        FROM catalog c{join} WHERE {where})"""


def with_tables(sql: str) -> str:
    """sql behind the definitions of the logical tables that it needs, directly or through others."""
    needed: set[str] = set()

    def find(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                find(TABLES[name])

    find(sql)
    if not needed:
        return sql
    defs = ", ".join(f"{n} AS ({q})" for n, q in TABLES.items() if n in needed)
    return f"WITH {defs} {sql}"
