"""Queries of telemetry and of text, link and search-console analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanfit.operators import links
from spanfit.operators import telemetry as t
from spanfit.operators import text as x
from spanfit.plans.oracle import with_tables
from spanfit.sources import adapters

REWRITES = ("/t:rest", "/el/:all*", "/:first/:second", "/the", "/(.*)", "no-slash")
LINT = {"shout": "!!", "table": r"\|", "stars": r"\*\*\*", "money": r"[0-9]+\$"}


def _docs(spark, sf_dir):
    return adapters.read(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))


def _pages(spark, sf_dir):
    return adapters.read(spark, sf_dir, "pages")


def rum_clean(spark, sf_dir):
    return t.sanitised_rum(adapters.rum(spark, sf_dir)).select("event_id", "metric", "path", "value")


def rum_percentiles(spark, sf_dir):
    return t.rum_percentiles(adapters.rum(spark, sf_dir))


def rum_daily(spark, sf_dir):
    """Percentiles by day, from counts of values as the streaming roll-up keeps them."""
    return t.count_percentiles(t.value_counts(adapters.rum(spark, sf_dir)), ("day", "path", "metric")).withColumn("day", F.col("day").cast("string"))


def rum_by_metric(spark, sf_dir):
    """Percentiles of a whole metric from counts: a key with a third of all events is spread over its buckets."""
    return t.count_percentiles(t.value_counts(adapters.rum(spark, sf_dir)), ("metric",))


def rum_status(spark, sf_dir):
    return t.rum_status(adapters.rum(spark, sf_dir))


def bad_vitals(spark, sf_dir):
    rows = adapters.rum(spark, sf_dir).withColumn("value", F.when(F.col("metric") == "LCP", F.col("value") * 40).when(F.col("metric") == "INP", F.col("value") * 3).otherwise(F.col("value") / 1000))
    return t.fix_plan(t.bad_vitals(t.rum_percentiles(rows)), t.rum_status(rows)).select("rank", "path", "metric", "p75")


def error_clean(spark, sf_dir):
    stack = F.concat(F.lit("at f (/s/x.js?v=1)\n\nhttps://Cdn.example.net/app.js#k by a.b@c.org\n3\n4\n5 +61.2.9999.0000\n6 "), "message")
    source = F.when(F.col("line") % 3 == 0, F.concat(F.lit("https://CDN.example.net"), "source")).otherwise(F.col("source"))
    rows = adapters.errors(spark, sf_dir).withColumns({"message": F.concat("message", F.lit(" from a.b@c.org or +61.2 (9999) 0000")), "source": F.concat(source, F.lit("?v=1#x")), "col": F.col("line") % 7 - 1, "stack": stack})
    return t.sanitised_errors(rows).select("event_id", "message", "source", "line", "col", "stack")


def error_signatures(spark, sf_dir):
    return t.error_signatures(adapters.errors(spark, sf_dir)).select("signature", "n", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "sample")


def error_daily_firsts(spark, sf_dir):
    return t.daily_firsts(adapters.errors(spark, sf_dir)).select("event_id")


def rum_sample(spark, sf_dir):
    return t.sampled(adapters.rum(spark, sf_dir)).select("event_id")


def window_limiter(spark, sf_dir):
    return t.window_limited(adapters.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", 3, 86_400.0)


def bucket_limiter(spark, sf_dir):
    return t.bucket_limited(adapters.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", 2.0, 1 / 40_000)


def plan_cap(spark, sf_dir):
    return t.capped_plan(adapters.search_console(spark, sf_dir).select("ord", "page"))


def text_lint(spark, sf_dir):
    return x.phrase_lint(_docs(spark, sf_dir), LINT).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"), F.max("line").alias("last_line"))


def text_ngrams(spark, sf_dir):
    return x.repeated_ngrams(_docs(spark, sf_dir))


def text_pairs(spark, sf_dir):
    return x.shingle_pairs(_docs(spark, sf_dir)).select("a", "b", (F.floor(F.col("similarity") * 1000 + 0.5) / 1000).alias("similarity"))


def page_words(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", x.word_count(x.html_text(F.col("html"))).alias("words"))


def _marked(spark, sf_dir):
    """Pages with structured data, links to shops and inner pages, and placeholders added to some."""
    k = F.col("page_id")
    add = F.concat(
        F.when(k % 3 == 0, F.lit('<script type="application/ld+json"> {"@type": "Article"} </script>')).otherwise(""), F.when(k % 5 == 0, F.lit('<script type="application/ld+json">{"@type": </script>')).otherwise(""),
        F.when(k % 2 == 0, F.lit('<a class="x" href="/cavity/600"><b>600</b></a>')).otherwise(""), F.when(k % 7 == 0, F.lit("<p>FixMe</p>")).otherwise(""),
        F.when(k % 3 == 1, F.lit('<a href="https://www.jbhifi.com.au/products/a">Buy from JB</a>')).otherwise(""), F.when(k % 4 == 1, F.lit('<a href="https://shop.example.net/search?q=a">x</a><a href="https://www.binglee.com.au/">Home</a>')).otherwise(""),
        F.lit('<a href="https://fonts.googleapis.com/css">f</a><a href="https://www.example.org/about">about</a>'),
    )
    return _pages(spark, sf_dir).withColumn("html", F.concat("html", add))


def page_gate(spark, sf_dir):
    return x.quality_gate(_marked(spark, sf_dir))


def page_index(spark, sf_dir):
    return x.index_audit(_pages(spark, sf_dir))


def link_graph(spark, sf_dir):
    edges = x.link_edges(_pages(spark, sf_dir))
    nodes = edges.select(F.col("dst").alias("url")).unionByName(_pages(spark, sf_dir).select("url"))
    return x.degrees(edges, nodes)


def broken_links(spark, sf_dir):
    edges = x.link_edges(_pages(spark, sf_dir))
    targets = edges.select(F.col("dst").alias("url")).where("length(url) % 2 = 0")
    return x.broken_links(edges, targets)


def checked_links(spark, sf_dir):
    """Targets of links that are no page, no file and no rewritten route."""
    edges = x.link_edges(_pages(spark, sf_dir))
    pages = edges.select(F.col("dst").alias("url")).where("length(url) % 4 = 0")
    files = edges.select(F.col("dst").alias("path")).where("length(dst) % 4 = 1")
    rules = links.rewrite_rules(spark.createDataFrame([(r,) for r in REWRITES], "source string"))
    return links.broken_targets(links.checked_links(edges, pages, rules, files))


def orphan_gate(spark, sf_dir):
    return links.orphan_gate(link_graph(spark, sf_dir))


def indexing_issues(spark, sf_dir):
    """Every page's route against pages of which some are missing, hidden or of another address."""
    k, route = F.col("page_id"), F.concat(F.lit("/p/"), F.col("page_id").cast("string"))
    head = F.concat(F.when(k % 5 == 0, '<META content="noindex, nofollow" name="robots">').when(k % 5 == 1, "<meta name='robots' content='all'>").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("<link href='https://www.example.org"), route, F.lit("' rel='canonical'>"))).when(k % 3 == 1, F.lit('<link rel="canonical" href=" https://else.example.org/x ">')).otherwise(""))
    pages = _pages(spark, sf_dir).where("page_id % 7 <> 0").select(route.alias("route"), F.concat(head, "html").alias("html"))
    sitemap = _pages(spark, sf_dir).select(F.concat(F.lit("https://www.example.org"), route, F.when(k % 2 == 0, "/?q=1").otherwise("")).alias("url"))
    return links.indexing_issues(sitemap, pages, "https://www.example.org")


def route_diff(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return x.two_sided(p.where("page_id % 3 <> 0"), p.where("page_id % 4 <> 0"))


def sitemap_scan(spark, sf_dir):
    xml = _pages(spark, sf_dir).select("page_id", F.concat(F.lit("<urlset><url><loc> "), "url", F.lit("\n</loc></url><url><loc>/p/"), F.col("page_id").cast("string"), F.lit("</loc></url></urlset>")).alias("xml"))
    return xml.select("page_id", F.explode(x.sitemap_urls(F.col("xml"))).alias("loc"))


def link_classes(spark, sf_dir):
    return x.link_classes(_marked(spark, sf_dir), ("example.org",))


def link_summary(spark, sf_dir):
    return x.link_summary(link_classes(spark, sf_dir))


def buy_links(spark, sf_dir):
    return x.buy_links(_marked(spark, sf_dir), ("example.org",))


def query_intents(spark, sf_dir):
    return adapters.search_console(spark, sf_dir).groupBy(x.intent(F.col("query")).alias("intent")).agg(F.count("*").alias("n"), F.sum("impressions").alias("impressions"))


def console_summary(spark, sf_dir):
    return x.console_summary(adapters.search_console(spark, sf_dir))


def keyword_gaps(spark, sf_dir):
    return x.keyword_gaps(adapters.search_console(spark, sf_dir), adapters.sitemap(spark, sf_dir))


def coverage_similarity(spark, sf_dir):
    """A search: the queries whose number is divisible by 100, against all slugs."""
    return x.coverage_similarity(adapters.search_console(spark, sf_dir).where("ord % 100 = 0"), adapters.sitemap(spark, sf_dir))


def covered_queries(spark, sf_dir):
    return x.covered_queries(adapters.search_console(spark, sf_dir), adapters.sitemap(spark, sf_dir))


def candidate_cascade(spark, sf_dir):
    return x.candidate_cascade(adapters.search_console(spark, sf_dir), adapters.sitemap(spark, sf_dir))


QUERIES = [rum_clean, rum_percentiles, rum_daily, rum_by_metric, rum_status, bad_vitals, error_clean, error_signatures, error_daily_firsts, rum_sample, window_limiter, bucket_limiter, plan_cap, text_lint, text_ngrams, text_pairs, page_words, page_gate, page_index, link_graph, broken_links, checked_links, orphan_gate, indexing_issues, route_diff, sitemap_scan, link_classes, link_summary, buy_links, query_intents, console_summary, keyword_gaps, coverage_similarity, covered_queries, candidate_cascade]

_SIG = "sha256(message || '|' || regexp_extract(source, '[^/]*$') || '|' || CAST(line AS VARCHAR))"
_RUM = "(SELECT metric, path, CASE metric WHEN 'LCP' THEN value * 40 WHEN 'INP' THEN value * 3 ELSE value / 1000 END AS value FROM rum WHERE metric IN ('LCP', 'CLS', 'INP'))"
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
_GRAMS = "list_transform(range(1, len(w) - {n} + 2), lambda k: array_to_string(w[k:k + {n} - 1], ' '))"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
_NWORDS = f"CASE WHEN {_TEXT} = '' THEN 0 ELSE len(string_split({_TEXT}, ' ')) END"
_HREFS = "(SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"
_PATH = "regexp_replace(trim(href), '[?#].*$', '')"
_EDGES = f"(SELECT DISTINCT src, dst FROM (SELECT url AS src, CASE WHEN length({_PATH}) > 1 THEN regexp_replace({_PATH}, '/+$', '') ELSE {_PATH} END AS dst FROM {_HREFS} WHERE starts_with({_PATH}, '/') AND NOT starts_with({_PATH}, '//')) WHERE src <> dst)"
_KEY = "trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'))"
_SLUG = "left(trim(regexp_replace(lower(query), '[^a-z0-9]+', '-', 'g'), '-'), 72)"
_RATIO = "1e0 - CAST(levenshtein(q, slug) AS DOUBLE) / greatest(length(q), length(slug))"
_SIM = f"(SELECT ord, max({_RATIO}) AS similarity FROM (SELECT ord, {_SLUG} AS q FROM gsc), sitemap WHERE q <> '' AND {_RATIO} > 0.9e0 GROUP BY ord)"
_CONSOLE = r"trim(regexp_replace(regexp_replace(lower(query), '[^a-z0-9\s-]+', ' ', 'g'), '\s+', ' ', 'g'))"
_INTENT = rf"CASE WHEN regexp_matches({_CONSOLE}, '^how\b|\bhow to\b') THEN 'how-to' WHEN regexp_matches({_CONSOLE}, 'sydney|melbourne|brisbane|perth|adelaide|canberra|hobart|darwin') THEN 'location' WHEN regexp_matches({_CONSOLE}, '\b(door|doorway|entry)\b') THEN 'doorway' WHEN regexp_matches({_CONSOLE}, '\b(cavity|mm)\b') THEN 'cavity' ELSE 'brand' END"
_MARKED = """(SELECT page_id, url, html || CASE WHEN page_id % 3 = 0 THEN '<script type="application/ld+json"> {"@type": "Article"} </script>' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<script type="application/ld+json">{"@type": </script>' ELSE '' END
    || CASE WHEN page_id % 2 = 0 THEN '<a class="x" href="/cavity/600"><b>600</b></a>' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '<p>FixMe</p>' ELSE '' END || CASE WHEN page_id % 3 = 1 THEN '<a href="https://www.jbhifi.com.au/products/a">Buy from JB</a>' ELSE '' END
    || CASE WHEN page_id % 4 = 1 THEN '<a href="https://shop.example.net/search?q=a">x</a><a href="https://www.binglee.com.au/">Home</a>' ELSE '' END || '<a href="https://fonts.googleapis.com/css">f</a><a href="https://www.example.org/about">about</a>' AS html FROM pages)"""
_ANCHOR = r"""'(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>'"""
_LINKED = rf"""(SELECT url, CASE WHEN NOT regexp_matches(h, '^https?://') THEN 'non_external' WHEN regexp_matches(h, 'fonts\.googleapis|fonts\.gstatic|example\.org') THEN 'non_buy_external' WHEN contains(t, 'buy from') OR t = 'buy now' THEN 'product_like_buy'
    WHEN contains(t, 'search at') OR regexp_matches(h, '/search[/?]|[?&](q|query|text|search|keyword)=') THEN 'retailer_search' WHEN regexp_matches(h, '(harveynorman|thegoodguys|jbhifi|appliances-?online|binglee)\.com\.au/?$') THEN 'retailer_homepage' ELSE 'product_like_buy' END AS kind
    FROM (SELECT url, lower(regexp_extract(a, {_ANCHOR}, 1)) AS h, lower(trim(regexp_replace(regexp_replace(regexp_extract(a, {_ANCHOR}, 2), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS t FROM (SELECT url, unnest(regexp_extract_all(html, {_ANCHOR})) AS a FROM {_MARKED})))"""
_PAGE_LINKS = f"""(SELECT url, b + s + h AS buy_links, b AS product_like_buy, s AS retailer_search, h AS retailer_homepage, CASE WHEN b > 0 THEN 'strong' WHEN s > 0 THEN 'search_only' WHEN h > 0 THEN 'homepage_only' ELSE 'none' END AS tier
    FROM (SELECT p.url, count(*) FILTER (WHERE kind = 'product_like_buy') AS b, count(*) FILTER (WHERE kind = 'retailer_search') AS s, count(*) FILTER (WHERE kind = 'retailer_homepage') AS h FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN {_LINKED} l ON l.url = p.url GROUP BY p.url))"""
_BARE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<nav.*?</nav>', ' ', 'g'), '(?is)<footer.*?</footer>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '\s+', ' ', 'g'))"
_NBARE = f"CASE WHEN {_BARE} = '' THEN 0 ELSE len(string_split({_BARE}, ' ')) END"
_BLOCKS = r"""list_transform(regexp_extract_all(html, '(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>', 1), lambda x: trim(x))"""
_NERR = f"len(list_filter({_BLOCKS}, lambda x: NOT json_valid(x)))"
_REDACTED = r"regexp_replace(regexp_replace({x}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[redacted-email]', 'g'), '\+?[0-9][0-9\s().-]{{7,}}[0-9]', '[redacted-phone]', 'g')"
_SHINGLED = r"list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))), ' '), lambda w: w <> '')"

ORACLE = {
    "rum_clean": "SELECT event_id, metric, path, CASE WHEN metric = 'CLS' THEN floor(value * 10000 + 0.5e0) / 10000 ELSE floor(value + 0.5e0) END AS value FROM rum WHERE metric IS NOT NULL AND value BETWEEN 0 AND 60000",
    "rum_percentiles": "SELECT path, metric, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75, quantile_disc(value, 0.95) AS p95 FROM rum WHERE metric IN ('LCP', 'CLS', 'INP') GROUP BY path, metric",
    "rum_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, path, metric, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75, quantile_disc(value, 0.95) AS p95 FROM rum WHERE metric IN ('LCP', 'CLS', 'INP') GROUP BY ALL",
    "rum_by_metric": "SELECT metric, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.75) AS p75, quantile_disc(value, 0.95) AS p95 FROM rum WHERE metric IN ('LCP', 'CLS', 'INP') GROUP BY ALL",
    "rum_status": "SELECT count(*) AS n, count(DISTINCT path) AS paths, CASE WHEN count(*) < 100 THEN 'insufficient_samples' ELSE 'ok' END AS status FROM rum WHERE metric IN ('LCP', 'CLS', 'INP')",
    "bad_vitals": f"SELECT CAST(row_number() OVER (ORDER BY s, p75 DESC, path) AS INTEGER) AS rank, path, metric, p75 FROM (SELECT path, metric, quantile_disc(value, 0.75) AS p75, CASE metric WHEN 'LCP' THEN 0 WHEN 'INP' THEN 1 ELSE 2 END AS s FROM {_RUM} GROUP BY path, metric) WHERE (SELECT count(*) FROM {_RUM}) >= 100 AND p75 > CASE metric WHEN 'LCP' THEN 2500 WHEN 'INP' THEN 200 ELSE 0.1e0 END ORDER BY rank LIMIT 5",
    "error_clean": f"""SELECT event_id, {_REDACTED.format(x="message || ' from a.b@c.org or +61.2 (9999) 0000'")} AS message, CASE WHEN line % 3 = 0 THEN 'https://cdn.example.net' ELSE 'https://www.example.org' END || source AS source, line, line % 7 - 1 AS col,
        'https://www.example.org/at%20f%20(/s/x.js' || chr(10) || 'https://cdn.example.net/app.js' || chr(10) || 'https://www.example.org/3' || chr(10) || 'https://www.example.org/4' || chr(10) || 'https://www.example.org/5%20[redacted-phone]' AS stack FROM errors WHERE line >= 0 AND line % 7 >= 1""",
    "error_signatures": f"SELECT {_SIG} AS signature, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_min(source, event_id) AS sample FROM errors GROUP BY 1",
    "error_daily_firsts": f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, {_SIG}, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM errors) WHERE k = 1",
    "plan_cap": "SELECT ord, page, k <= 10 AS selected, CASE WHEN k > 10 THEN 'cap' END AS reason FROM (SELECT ord, page, row_number() OVER (ORDER BY ord) AS k FROM gsc)",
    "text_lint": "SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS docs, CAST(max(line) AS INTEGER) AS last_line FROM (SELECT doc_id, line, unnest(list_filter([CASE WHEN contains(body, '!!') THEN 'shout' END, CASE WHEN contains(body, '|') THEN 'table' END, CASE WHEN contains(body, '***') THEN 'stars' END, CASE WHEN regexp_matches(body, '[0-9]+\\$') THEN 'money' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)) GROUP BY rule",
    "text_ngrams": f"SELECT gram, CAST(sum(k) AS BIGINT) AS n, count(*) AS docs, CAST(row_number() OVER (ORDER BY sum(k) DESC, gram) AS INTEGER) AS rank FROM (SELECT doc_id, gram, count(*) AS k FROM (SELECT doc_id, unnest({_GRAMS.format(n=3)} || {_GRAMS.format(n=4)} || {_GRAMS.format(n=5)}) AS gram FROM (SELECT doc_id, {_WORDS} AS w FROM documents)) GROUP BY ALL) GROUP BY gram HAVING sum(k) >= 5 ORDER BY rank LIMIT 25",
    "text_pairs": f"""WITH s AS (SELECT doc_id AS id, CASE WHEN len(w) >= 5 THEN list_distinct({_GRAMS.format(n=5)}) WHEN len(w) > 0 THEN list_distinct(w) ELSE [''] END AS g FROM (SELECT doc_id, {_SHINGLED} AS w FROM documents)), e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM s)
        SELECT a, b, floor(k / greatest(na, nb)::DOUBLE * 1000 + 0.5e0) / 1000 AS similarity FROM (SELECT p.id AS a, q.id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.id < q.id GROUP BY ALL) WHERE k / greatest(na, nb)::DOUBLE >= 0.8e0""",
    "page_words": f"SELECT page_id, {_NWORDS} AS words FROM pages",
    "page_gate": rf"""SELECT url, {_NBARE} AS words, {_NERR} AS schema_errors, concat_ws(',', CASE WHEN {_NBARE} < 300 THEN 'min_word_count' END, CASE WHEN NOT regexp_matches(html, '(?i)<(table|dl)(\s|>)') THEN 'missing_data_block' END, CASE WHEN NOT regexp_matches(html, '/(cavity|doorway|brands)/') THEN 'missing_internal_link' END,
        CASE WHEN regexp_matches(html, '(?i)lorem ipsum|todo|fixme|<placeholder>') THEN 'placeholder_content' END, CASE WHEN {_NERR} > 0 THEN 'schema_errors' END) AS failures FROM {_MARKED}""",
    "page_index": """SELECT url, regexp_matches(html, '(?i)<meta[^>]*name="robots"[^>]*noindex') AS noindex, regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical,
        regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) NOT IN ('', url) AS elsewhere FROM pages""",
    "link_graph": f"SELECT url, coalesce(i, 0) AS n_in, coalesce(o, 0) AS n_out FROM (SELECT dst AS url FROM {_EDGES} UNION SELECT url FROM pages) LEFT JOIN (SELECT dst, count(*) AS i FROM {_EDGES} GROUP BY dst) ON dst = url LEFT JOIN (SELECT src, count(*) AS o FROM {_EDGES} GROUP BY src) ON src = url",
    "checked_links": f"SELECT dst, count(*) AS n FROM {_EDGES} WHERE length(dst) % 4 > 1 AND NOT regexp_full_match(dst, '/t[^/]+|/el/.+|/[^/]+/[^/]+|/the') GROUP BY dst",
    "orphan_gate": f"SELECT count(*) AS pages, CAST(sum(n) AS BIGINT) AS edges, count(*) FILTER (WHERE n = 0) AS orphans, count(*) FILTER (WHERE n = 0) = 0 AS ok FROM (SELECT url, count(dst) AS n FROM (SELECT dst AS url FROM {_EDGES} UNION SELECT url FROM pages) LEFT JOIN {_EDGES} ON dst = url GROUP BY url)",
    "indexing_issues": """SELECT '/p/' || page_id AS route, issue, CASE WHEN issue = 'canonical-mismatch' THEN 'https://else.example.org/x' END AS found FROM (SELECT page_id, unnest(list_filter(CASE WHEN page_id % 7 = 0 THEN ['missing-file'] ELSE
        [CASE WHEN page_id % 5 = 0 THEN 'noindex' END, CASE page_id % 3 WHEN 1 THEN 'canonical-mismatch' WHEN 2 THEN 'missing-canonical' END] END, lambda i: i IS NOT NULL)) AS issue FROM pages)""",
    "broken_links": f"SELECT dst, count(*) AS n FROM {_EDGES} WHERE length(dst) % 2 <> 0 GROUP BY dst",
    "route_diff": "SELECT DISTINCT url, 'missing' AS side FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 0) UNION ALL SELECT DISTINCT url, 'unexpected' FROM pages WHERE page_id % 4 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 <> 0)",
    "sitemap_scan": "SELECT page_id, trim(url) AS loc FROM pages UNION ALL SELECT page_id, '/p/' || CAST(page_id AS VARCHAR) FROM pages",
    "link_classes": f"SELECT * FROM {_PAGE_LINKS}",
    "link_summary": f"SELECT count(*) AS pages, count(*) FILTER (WHERE tier = 'strong') AS strong_pages, count(*) FILTER (WHERE tier = 'search_only') AS search_only_pages, count(*) FILTER (WHERE tier = 'homepage_only') AS homepage_only_pages, count(*) FILTER (WHERE tier = 'none') AS none_pages, CAST(sum(product_like_buy) AS BIGINT) AS product_like_buy_links, CAST(sum(retailer_search) AS BIGINT) AS retailer_search_links, CAST(sum(retailer_homepage) AS BIGINT) AS retailer_homepage_links FROM {_PAGE_LINKS}",
    "buy_links": f"SELECT url, external, buy, buy > 0 AS has_buy FROM (SELECT p.url, count(*) FILTER (WHERE kind <> 'non_external') AS external, count(*) FILTER (WHERE kind IN ('product_like_buy', 'retailer_search', 'retailer_homepage')) AS buy FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN {_LINKED} l ON l.url = p.url GROUP BY p.url)",
    "query_intents": f"SELECT {_INTENT} AS intent, count(*) AS n, CAST(sum(impressions) AS BIGINT) AS impressions FROM gsc GROUP BY 1",
    "console_summary": "SELECT count(*) AS n, count(DISTINCT query) AS queries, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, floor(sum(clicks)::DOUBLE / sum(impressions) * 10000 + 0.5e0) / 10000 AS ctr, floor(avg(position) * 100 + 0.5e0) / 100 AS position FROM gsc",
    "keyword_gaps": f"""SELECT 'page-2' AS kind, ord, impressions FROM gsc WHERE position BETWEEN 11 AND 20 UNION ALL SELECT 'gap', ord, impressions FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY impressions DESC, ord) AS nth FROM (
        SELECT g.*, list_filter(string_split({_KEY}, ' '), lambda t: length(t) >= 3 AND t NOT IN ('a', 'and', 'appliance', 'au', 'australia', 'for', 'fit', 'in', 'mm', 'of', 'the', 'to', 'with')) AS tokens, hay FROM gsc g, (SELECT string_agg(trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')), ' ') AS hay FROM sitemap))
        WHERE impressions > 0 AND len(tokens) > 0 AND len(list_filter(tokens, lambda t: contains(hay, t))) = 0) WHERE nth = 1""",
    "coverage_similarity": f"SELECT ord, max({_RATIO}) AS similarity FROM (SELECT ord, {_SLUG} AS q FROM gsc WHERE ord % 100 = 0), sitemap GROUP BY ord",
    "covered_queries": f"SELECT ord, similarity FROM {_SIM}",
    "candidate_cascade": f"""SELECT ord, reason, CASE WHEN reason IS NULL THEN {_SLUG} END AS slug, CASE WHEN reason IS NULL THEN {_INTENT} END AS kind FROM (SELECT g.*, CASE WHEN trim(query) = '' THEN 'empty_query' WHEN row_number() OVER (PARTITION BY {_CONSOLE}, trim(query) = '' ORDER BY ord) > 1 THEN 'duplicate_query'
        WHEN regexp_matches({_CONSOLE}, 'buy|cheap|deal|coupon|discount|free shipping') THEN 'blacklist' WHEN len(list_filter(string_split({_CONSOLE}, ' '), lambda t: t <> '')) < 3 THEN 'query_too_short' WHEN impressions < 50 THEN 'low_impressions' WHEN position < 11 OR position > 30 THEN 'position_out_of_range'
        WHEN ctr >= 0.05e0 THEN 'ctr_not_low_enough' WHEN similarity IS NOT NULL THEN 'already_covered' END AS reason FROM (SELECT g.*, x.similarity FROM gsc g LEFT JOIN {_SIM} x ON x.ord = g.ord) g)""",
}


def oracle() -> dict[str, str]:
    return {n: q if q.lstrip().startswith("WITH") else with_tables(q) for n, q in ORACLE.items()}
