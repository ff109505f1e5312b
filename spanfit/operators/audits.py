"""Audits of evidence, copy, structured data and reviews, and the gates between them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.markup import PROSE, ROWS, json_documents, page_elements, page_texts
from spanfit.operators.facets import ranked
from spanfit.operators.text import json_blocks

#: Evidence types that count, ranges of dimensions in mm, least confidence without a review.
EVIDENCE_TYPES = ("manufacturer_manual", "installation_manual", "spec_sheet")
LEAST_CONFIDENCE = 0.8
#: Words of which a repeated phrase says nothing if it has no others.
PHRASE_STOP_WORDS = (
    "and", "the", "for", "with", "from", "that", "this", "your", "into", "over", "under", "about", "after", "before", "through", "which", "these", "those",
    "their", "there", "have", "will", "does", "need", "clearance", "requirements", "guide", "models", "fit", "brand", "brands", "fridge", "washing", "machine",
    "dishwasher", "dryer", "australia", "australian", "homes", "installed", "page", "pages",
)
STOP = frozenset(PHRASE_STOP_WORDS)
WORD = re.compile("[a-z0-9]+")
#: Openings that a paragraph must not have.
LEADS = ("notable:", "importantly,", "additionally,")
#: The edge of a word of ASCII letters, digits and underscores (Java's own knows other letters too).
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _sum(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def evidence_coverage(products: DataFrame, index: DataFrame) -> DataFrame:
    """brand, total, verified, missing and coverage in percent to one place."""
    have = index.where("verified").select(F.col("product_id").alias("id"), F.lit(True).alias("have")).distinct()
    brand = F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.lit("Unknown"))
    rows = products.join(have, "id", "left").groupBy(brand.alias("brand")).agg(F.count("*").alias("total"), F.count("have").alias("verified"))
    return rows.select("brand", "total", "verified", (F.col("total") - F.col("verified")).alias("missing"), (F.floor(F.col("verified") / F.col("total") * 1000 + 0.5) / 10).alias("coverage"))


def evidence_errors() -> Column:
    """Fields of a strict evidence record (product_id, brand, model, source_url, w, h, d, confidence) that are wrong, in order; low confidence asks for a review."""
    filled = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", c) for c in ("product_id", "brand", "model")]
    size = [F.when(~F.coalesce(F.col(c) > 0, F.lit(False)), c) for c in "whd"]
    url = F.when(~F.coalesce(F.lower("source_url").rlike("^https?://[^/]"), F.lit(False)), "source_url")
    share = F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence").when(F.col("confidence") < LEAST_CONFIDENCE, "manual_review")
    return F.array_compact(F.array(*filled, url, *size, share))


def discrepancies(old: dict[str, Column], new: dict[str, Column], least: int = 5) -> Column:
    """Axes whose two sizes, both known, differ by `least` mm or more: array of (axis, old, new, delta)."""
    return F.array_compact(F.array(*(F.when(F.abs(new[a] - old[a]) >= least, F.struct(F.lit(a).alias("axis"), old[a].alias("old"), new[a].alias("new"), (new[a] - old[a]).alias("delta"))) for a in old)))


def mismatches(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Axes whose sizes are not the same; a missing one differs from any."""
    return F.array_compact(F.array(*(F.when(~old[a].eqNullSafe(new[a]), F.lit(a)) for a in old)))


def approved(evidence: DataFrame) -> DataFrame:
    """Evidence rows that are approved documents of the maker at an http address."""
    return evidence.where(F.col("type").isin(*EVIDENCE_TYPES) & (F.col("status") == "approved") & F.lower("source_url").rlike("^https?://"))


def evidence_audit(products: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per category: products, whole shapes, products with and without approved evidence, valid and invalid records, records that differ from the catalog, hash states."""
    shape = F.lit(True)
    for c in ("id", "cat", "brand", "model"):
        shape = shape & (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    for c in "whd":
        shape = shape & F.coalesce(F.col(c) > 0, F.lit(False))
    good = approved(evidence).select(F.col("product_id").alias("id"), "hash_status", *(F.col(c).alias(f"e_{c}") for c in "whd"), (F.size("errors") == 0).alias("valid"))
    per = good.groupBy("id").agg(F.count("*").alias("n"))
    base = products.withColumn("shape", shape).join(per, "id", "left").groupBy("cat").agg(F.count("*").alias("products"), _sum(F.col("shape")).alias("shape_valid"), F.count("n").alias("approved"), _sum(F.col("n").isNull()).alias("missing"))
    joined = good.join(products.select("id", "cat", "w", "h", "d"), "id")
    differs = F.size(mismatches({c: F.col(c) for c in "whd"}, {c: F.col(f"e_{c}") for c in "whd"})) > 0
    records = joined.groupBy("cat").agg(
        _sum(F.col("valid")).alias("strict_valid"), _sum(~F.col("valid")).alias("strict_invalid"), _sum(F.col("valid") & differs).alias("mismatched"), *(_sum(F.col("hash_status") == s).alias(f"hash_{s}") for s in ("valid", "invalid", "skipped"))
    )
    return base.join(records, "cat", "left").na.fill(0)


def review_queue(products: DataFrame, evidence: DataFrame, most: int = 50) -> DataFrame:
    """Products without approved evidence: most priority first, then most links, then by id."""
    left = products.join(approved(evidence).select(F.col("product_id").alias("id")), "id", "left_anti")
    return ranked(left, [F.coalesce("priority", F.lit(0)).desc(), F.desc("n_links"), F.asc("id")], most=most).select("rank", "id")


def provenance(products: DataFrame, index: DataFrame) -> DataFrame:
    """id, state, url: the index's word on a product, else its own evidence, else retailer specifications."""
    i = index.select(F.col("product_id").alias("id"), F.lit(True).alias("indexed"), "verified", F.col("url").alias("index_url"))
    rows = products.join(i, "id", "left")
    state = F.when(F.col("indexed") & F.col("verified"), "verified").when(F.col("indexed"), "pending").when(F.col("own_url").isNotNull(), "verified").otherwise("retailer")
    return rows.select("id", state.alias("state"), F.coalesce("index_url", "own_url").alias("url"))


def quality_check(buy: DataFrame, classes: DataFrame, most_search_only: int = 0, most_no_buy: int = 0) -> DataFrame:
    """One row: failures of two page audits that must agree (buy_links and link_summary), and whether there are none."""
    a = buy.agg(F.count("*").alias("a_pages"), _sum(~F.col("has_buy")).alias("a_none"))
    both = a.crossJoin(classes)  # one row each
    failed = F.array_compact(
        F.array(
            F.when(F.col("a_pages") != F.col("pages"), "pages"), F.when(F.col("a_none") != F.col("none_pages"), "no_buy"),
            F.when(F.col("search_only_pages") > most_search_only, "search_only"), F.when(F.col("none_pages") > most_no_buy, "too_many_without"),
        )
    )
    return both.select(F.array_join(failed, ",").alias("failures"), (F.size(failed) == 0).alias("ok"))


def research_rollup(visits: DataFrame) -> DataFrame:
    """Per product with a page that could be read: pages checked and available, reviews, least and highest price."""
    return visits.where("fetched").groupBy("product_id").agg(F.count("*").alias("checked"), _sum(F.col("available")).alias("available"), F.sum(F.coalesce("reviews", F.lit(0))).alias("reviews"), F.min("price_min").alias("price_min"), F.max("price_max").alias("price_max"))


def top_queries(products: DataFrame, most: int = 10) -> DataFrame:
    """rank, query, n: the brands and categories with most products, as search phrases."""
    counts = products.where("brand <> '' and cat <> ''").groupBy("brand", "cat").agg(F.count("*").alias("n"))
    query = F.concat(F.lower("brand"), F.lit(" "), F.replace("cat", F.lit("_"), F.lit(" ")), F.lit(" clearance australia"))
    return ranked(counts.withColumn("query", query), [F.desc("n"), F.asc("query")], most=most).select("rank", "query", "n")


def promo_stats(products: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: products, brands, known door swings and their share to one place, products with links, links, links with a price."""
    p = products.agg(F.count("*").alias("products"), F.countDistinct("brand").alias("brands"), F.count("door_swing_mm").alias("swings"))
    o = offers.agg(F.countDistinct("product_id").alias("linked"), F.count("*").alias("links"), _sum(F.col("p") > 0).alias("priced"))
    share = F.when(F.col("products") > 0, F.floor(F.col("swings") / F.col("products") * 1000 + 0.5) / 10).otherwise(F.lit(0.0))
    return p.crossJoin(o).select("products", "brands", "swings", share.alias("swing_pct"), "linked", "links", "priced")  # one row each


def paragraph_issues(pages: DataFrame) -> DataFrame:
    """(url, at, rule): paragraphs with a forbidden opening, more than one em dash, or an upper-case opening without a source."""
    t, has = F.col("text"), lambda k: F.map_contains_key("attributes", k)
    lead = F.lower(t).rlike("^(" + "|".join(LEADS) + ")")
    shouted = t.rlike(r"^\s*[A-Z][A-Z&/]+(\s+[A-Z&/]{2,})*" + EDGE) & ~has("data-source") & ~has("cite")
    dashes = F.length(t) - F.length(F.replace(t, F.lit("—"), F.lit(""))) > 1
    found = F.array_compact(F.array(F.when(lead, "forbidden-lead"), F.when(dashes, "excess-em-dash"), F.when(shouted, "uppercase-lead")))
    return page_elements(pages, ("p",)).where(t != "").select("url", "at", F.explode(found).alias("rule"))


@cache
def pictographs() -> str:
    """A character class of all pictographs, from the Unicode property (which Java's patterns do not know)."""
    import regex

    one, ranges = regex.compile(r"\p{Extended_Pictographic}"), []
    for c in (*range(0x80, 0x3300), *range(0x1F000, 0x1FC00)):  # the blocks that have any
        if one.match(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def heading_issues(pages: DataFrame) -> DataFrame:
    """(url, at, rule): headings with inline style or emoji, and clearance headings in the plural."""
    t = F.col("text")
    plural = (F.col("tag") == "h1") & t.rlike(r"(?i)\b(Fridges|Washing Machines|Dishwashers)\s+Clearance\b")
    found = F.array_compact(F.array(F.when(F.map_contains_key("attributes", "style"), "heading-inline-style"), F.when(t.rlike(pictographs()), "emoji-heading"), F.when(plural, "clearance-heading-singular")))
    return page_elements(pages, ("h1", "h2", "h3")).where(t != "").select("url", "at", F.explode(found).alias("rule"))


def prose(pages: DataFrame) -> DataFrame:
    """(id, text): the texts of a page's headings, paragraphs, list items and quotes, without code and scripts, one after another; what stands in several of them counts in each."""
    each = page_elements(pages, PROSE, ("script", "style", "code", "pre")).where("text <> ''")
    return each.groupBy(F.col("url").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))


def phrase_clusters(rows: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """Phrases (of 3 to 5 words, with their use) by their clusters' first: longer ones first, then by use. A phrase joins the earliest cluster that has a phrase which it is part of or overlaps at an edge.

    Parts and edges of the clusters' phrases are looked up, so the work is linear. Clusters beyond `most` are not kept: what would join them cannot change earlier ones.
    """
    inside, begins, ends, out = {}, {}, {}, []
    for phrase, n in sorted(rows, key=lambda r: (-r[0].count(" "), -r[1], r[0])):
        w = phrase.split(" ")
        size = len(w)  # no phrase before this one is shorter
        edges = range(max(2, size - 2), size)
        met = [inside.get(phrase)] + [x for k in edges for x in (ends.get((*w[:k],)), begins.get((*w[-k:],)))]
        home = min((x for x in met if x is not None), default=None)
        if home is None:
            if len(out) == most:
                continue
            home = len(out)
            out.append((phrase, n))
        for a in range(size):
            for b in range(a + 3, size + 1):
                part = " ".join(w[a:b])
                inside[part] = min(inside.get(part, home), home)
        for k in range(2, size + 1):
            for table, key in ((begins, (*w[:k],)), (ends, (*w[-k:],))):
                table[key] = min(table.get(key, home), home)
    return out


def phrase_counts(texts: list[str], least: int) -> dict[str, int]:
    """Phrases of 3 to 5 words that lower-case texts use `least` times or more altogether, unless all their words are stop words.

    A longer phrase is counted only where its first words, one fewer, are repeated as often.
    """
    each = [WORD.findall(t) for t in texts]
    counts = Counter()
    for w in each:
        counts.update(zip(w, w[1:], w[2:], strict=False))
    often = {p for p, n in counts.items() if n >= least}
    places = [[k for k, p in enumerate(zip(w, w[1:], w[2:], strict=False)) if p in often] for w in each] if often else []
    found = {p: counts[p] for p in often}
    for size in (4, 5):
        places = [[k for k in at if k + size <= len(w) and (*w[k : k + size - 1],) in often] for w, at in zip(each, places, strict=False)]
        counts = Counter((*w[k : k + size],) for w, at in zip(each, places, strict=False) for k in at)
        often = {p for p, n in counts.items() if n >= least}
        found |= {p: counts[p] for p in often}
    return {" ".join(p): n for p, n in found.items() if not all(w in STOP for w in p)}


def repeated_phrases(docs: DataFrame, least: int = 5, most: int = 25, keyed: bool = False) -> DataFrame:
    """(id, place, phrase, n): per document the leading phrases of 3 to 5 words used `least` times or more, a cluster by its first phrase.

    The rows of an id meet as texts (keyed: each id has one row, as it is), and a document's phrases are counted where its text is: phrases are never dealt.
    """
    texts = docs.select("id", F.array_compact(F.array(F.lower("text"))).alias("texts")) if keyed else docs.groupBy("id").agg(F.collect_list(F.lower("text")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                rows = [(i, place + 1, p, n) for i, t in enumerate(b.column(1)) for place, (p, n) in enumerate(phrase_clusters(list(phrase_counts(t.as_py(), least).items()), most))]
                at, *columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64()), strict=True))], names=["id", "place", "phrase", "n"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, place int, phrase string, n long")


def schema_audit(pages: DataFrame, prefix: str) -> DataFrame:
    """url, blocks (JSON-LD that parses), has_article, has_faq and errors: blocks that don't parse, a missing or incomplete Article, a missing or empty FAQPage.

    A type may be one of several, and stand in a list or a graph; the fields asked for are those of the block itself.
    """
    fields = ("headline", "description", "url", "dateModified")
    rows = json_documents(pages.select("url", json_blocks(F.coalesce("html", F.lit(""))).alias("blocks")), {"Article": fields, "FAQPage": ("mainEntity",)})
    own, asked = F.col("Article"), F.coalesce(F.col("FAQPage")["mainEntity[]"].cast("int"), F.lit(0))
    errors = F.array_compact(
        F.array(
            F.when(F.col("n_invalid") > 0, "invalid JSON-LD"), F.when(own.isNull(), "missing Article JSON-LD"), *(F.when(F.trim(own[f]) == "", f"Article missing {f}") for f in fields), F.when((own["url"] != "") & ~own["url"].startswith(prefix), "Article url elsewhere"),
            F.when(F.col("FAQPage").isNull(), "missing FAQPage JSON-LD").when(asked == 0, "FAQPage missing mainEntity questions"),
        )
    )
    return rows.select("url", F.col("n_valid").alias("blocks"), own.isNotNull().alias("has_article"), F.col("FAQPage").isNotNull().alias("has_faq"), F.array_join(errors, "; ").alias("errors"))


def review_audit(pages: DataFrame, least_words: int = 300, expected: DataFrame | None = None) -> DataFrame:
    """url, words and issues of pages with review videos: enough words of their own, side, rear and top clearance, a word on fitting.

    Words are those of the page's `main` (or body) without the videos, navigation, footer and scripts. expected (url, side,
    rear, top): the millimetres that a page has to name; of other pages any number counts.
    """
    rows = page_texts(pages, "review-videos").where("found").withColumn("words", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*"), F.lit(0))).cast("long"))
    sides = ("side", "rear", "top")
    if expected is None:
        rows = rows.withColumns({s: F.lit(None).cast("int") for s in sides})
    else:
        rows = rows.join(expected.select(F.col("url").alias("e_url"), *sides), F.col("url") == F.col("e_url"), "left")
    named = lambda s: F.regexp_like("text", F.concat(F.lit(r"(?i)\b"), F.coalesce(F.col(s).cast("string"), F.lit(r"\d+")), F.lit(rf"mm\s+{s}\b")))
    issues = F.array_compact(F.array(F.when(F.col("words") < least_words, "words"), *(F.when(~named(s), s) for s in sides), F.when(~F.col("text").rlike(r"(?i)\b(fit|cavity|space)\b"), "fit")))
    return rows.select("url", "words", F.array_join(issues, ",").alias("issues"))


def seed_overlay(products: DataFrame, seeds: DataFrame) -> DataFrame:
    """direct_url of products that a seed (id, direct_url) names is the seed's, null too; the last seed of an id counts."""
    last = seeds.where(F.trim("id") != "").groupBy("id").agg(F.max_by(F.struct("direct_url"), "ord").alias("seed"))
    return products.join(last, "id", "left").withColumn("direct_url", F.when(F.col("seed").isNotNull(), F.col("seed.direct_url")).otherwise(F.col("direct_url"))).drop("seed")


def review_whitelist(reviews: DataFrame, creators: DataFrame) -> DataFrame:
    """review_id, reason: null where the review's creator is known and its author is that creator by name, channel id or channel address."""
    c = creators.select(F.col("creator_id").alias("known_id"), *(F.lower(F.trim(F.coalesce(x, F.lit("")))).alias(f"c_{x}") for x in ("name", "channel_id", "channel_url")))
    rows = reviews.join(c, F.col("creator_id") == F.col("known_id"), "left")
    name, url = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in ("author_name", "author_url"))
    same = ((F.col("c_name") != "") & (name == F.col("c_name"))) | ((F.col("c_channel_id") != "") & F.contains(url, F.col("c_channel_id"))) | ((F.col("c_channel_url") != "") & (url == F.col("c_channel_url")))
    blank = F.lit(False)
    for x in ("model_slug", "video_id", "creator_id"):
        blank = blank | (F.trim(F.coalesce(x, F.lit(""))) == "")
    return rows.select("review_id", F.when(blank, "incomplete").when(F.col("known_id").isNull(), "unknown creator").when(~same, "other author").alias("reason"))
