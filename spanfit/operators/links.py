"""Where links lead: pages, files and rewritten routes, the orphan gate, and the indexing audit of a site's routes (X-14 to X-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rewrite_rules(sources: DataFrame) -> DataFrame:
    """(prefix, pattern) of rewrite sources (source): the fixed part up to the first variable or group, cut at its last slash, and the source as a pattern. `:name` is one part of a path, `:name*` any; the rule for everything says nothing."""
    s = F.col("source")
    pattern = F.regexp_replace(F.regexp_replace(s, r":[a-zA-Z0-9_]+\*", ".+"), ":[a-zA-Z0-9_]+", "[^/]+")
    fixed = F.regexp_extract(s, r"^[^:(*.\[?+\\]*", 0)
    prefix = F.when(fixed == s, s).otherwise(F.regexp_extract(fixed, "^(.*/)", 1))
    return sources.where(s.startswith("/") & (s != "/(.*)")).select(prefix.alias("prefix"), F.concat(F.lit("^"), pattern, F.lit("$")).alias("pattern")).distinct()


def _prefixes(path: Column) -> Column:
    """The path itself and all its beginnings up to a slash."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(path), F.lit(1))), lambda k: F.substring(path, k, F.lit(1)) == "/")
    return F.array_distinct(F.array_append(F.transform(at, lambda k: F.substring(path, F.lit(1), k)), path))


def rewritten(paths: DataFrame, rules: DataFrame, path: str = "dst") -> DataFrame:
    """The distinct paths that a rule takes. Paths meet rules on equal prefixes, so no path is tried against all rules."""
    each = paths.select(path).distinct().select(path, F.explode(_prefixes(F.col(path))).alias("prefix"))
    return each.join(rules, "prefix").where(F.regexp_like(path, F.col("pattern"))).select(path).distinct()


def checked_links(edges: DataFrame, pages: DataFrame, rules: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """edges (src, dst) with ok: dst is a page (url), a file (path) or a path that is rewritten. What is a page or a file never meets the rules."""
    known = pages.select(F.col("url").alias("dst"))
    known = known if files is None else known.unionByName(files.select(F.col("path").alias("dst")))
    known = known.distinct()
    if rules is not None:
        known = known.unionByName(rewritten(edges.join(known, "dst", "left_anti"), rules))
    return edges.join(known.withColumn("ok", F.lit(True)), "dst", "left").select("src", "dst", F.coalesce("ok", F.lit(False)).alias("ok"))


def broken_targets(checked: DataFrame) -> DataFrame:
    """dst, n: targets of broken links by the number of their sources."""
    return checked.where(~F.col("ok")).groupBy("dst").agg(F.count("*").alias("n"))


def orphan_gate(degrees: DataFrame, allowed: int = 0) -> DataFrame:
    """One row: pages, edges, orphans (pages without links to them) and whether there are no more than allowed. From (url, n_in, n_out)."""
    rows = degrees.agg(F.count("*").alias("pages"), F.coalesce(F.sum("n_in"), F.lit(0)).alias("edges"), F.count(F.when(F.col("n_in") == 0, 1)).alias("orphans"))
    return rows.withColumn("ok", F.col("orphans") <= allowed)


def route_of(url: Column) -> Column:
    """The path of an address, without slashes at its end."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(bare == "", "/").when(~bare.startswith("/"), F.concat(F.lit("/"), bare)).otherwise(bare)


def canonical(html: Column) -> Column:
    """The address that a page gives as its own; null if none."""
    pick = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return F.trim(F.coalesce(pick(r"""(?i)<link\b[^>]*rel=["']canonical["'][^>]*href=["']([^"']+)["'][^>]*>"""), pick(r"""(?i)<link\b[^>]*href=["']([^"']+)["'][^>]*rel=["']canonical["'][^>]*>""")))


def noindex(html: Column) -> Column:
    """Whether a page asks not to be indexed."""
    return html.rlike(r"""(?i)<meta\b[^>]*name=["']robots["'][^>]*content=["'][^"']*noindex""") | html.rlike(r"""(?i)<meta\b[^>]*content=["'][^"']*noindex[^"']*["'][^>]*name=["']robots["']""") | html.rlike(r"(?i)x-robots-tag\s*:\s*noindex")


def indexing_issues(sitemap: DataFrame, pages: DataFrame, origin: str) -> DataFrame:
    """(route, issue, found) of the routes of a sitemap (url): missing-file, noindex, missing-canonical, or canonical-mismatch with what was found. pages: route, html."""
    routes = sitemap.select(route_of(F.col("url")).alias("route")).distinct()
    rows = routes.join(pages.select("route", F.lit(True).alias("there"), noindex(F.col("html")).alias("hidden"), canonical(F.col("html")).alias("own")), "route", "left")
    expected = F.concat(F.lit(origin), "route")
    issues = F.array_compact(
        F.array(
            F.when(F.col("there").isNull(), F.struct(F.lit("missing-file").alias("issue"), F.lit(None).cast("string").alias("found"))), F.when(F.col("there") & F.col("hidden"), F.struct(F.lit("noindex").alias("issue"), F.lit(None).cast("string").alias("found"))),
            F.when(F.col("there") & F.col("own").isNull(), F.struct(F.lit("missing-canonical").alias("issue"), F.lit(None).cast("string").alias("found"))).when(F.col("there") & (F.col("own") != expected), F.struct(F.lit("canonical-mismatch").alias("issue"), F.col("own").alias("found"))),
        )
    )
    return rows.select("route", F.explode(issues).alias("x")).select("route", "x.issue", "x.found")
