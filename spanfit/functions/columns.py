"""Normalisers, numeric parsing and URL tests as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def by_name(x: Column, base: bool = False) -> Column:
    """x as a sort key in a dictionary's order: letters with their accents and cases beside each other. base: these do not count at all, names that differ in them alone are equal."""
    return F.collate(x, "UNICODE_CI_AI" if base else "UNICODE")


def to_mm(x: Column) -> Column:
    """Millimetres of a plain decimal text; anything else, and what rounds to 0, is null."""
    t = F.trim(x.cast("string"))
    return F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.nullif(js_round(t.try_cast("double")), F.lit(0))).cast("int")


def cm_shorthand(x: Column) -> Column:
    """Values between 0 and 300 (a comma may be the decimal point) are centimetres."""
    v = F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v.isNull() | (v <= 0), None).when(v < 300, js_round(v * 10)).otherwise(js_round(v)).cast("int")


def squash(x: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "")


def plain_words(x: Column) -> Column:
    """Lower-case letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))


def slug(x: Column, longest: int | None = None) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return s if longest is None else F.regexp_replace(F.substring(s, 1, longest), "-+$", "")


def fold(x: Column) -> Column:
    """Case and runs of space folded."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"\s+", " "))


def number_in(x: Column) -> Column:
    """The number left when all but digits, point and minus is taken out; null if none is."""
    return F.nullif(F.regexp_replace(x, r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def model_code(x: Column) -> Column:
    """First word of 4 or more characters with a letter and a digit, or ''."""
    return F.coalesce(F.try_element_at(F.filter(F.split(plain_words(x), " "), lambda t: (F.length(t) >= 4) & t.rlike("[a-z]") & t.rlike("[0-9]")), F.lit(1)), F.lit(""))


def redact(x: Column) -> Column:
    """E-mail addresses and phone numbers replaced."""
    mail = F.regexp_replace(x, r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[redacted-email]")
    return F.regexp_replace(mail, r"\+?[0-9][0-9\s().-]{7,}[0-9]", "[redacted-phone]")


def origin_path(x: Column, site: str) -> Column:
    """Origin and path of a URL, without query and hash; what is no http URL is a path of the site."""
    t = F.trim(F.coalesce(x, F.lit("")))
    bare = F.regexp_replace(t, "[?#].*$", "")
    absolute = bare.rlike("^https?://")
    host = F.lower(F.regexp_extract(bare, "^(https?://[^/]*)", 1))
    path = F.regexp_replace(F.when(absolute, F.regexp_replace(bare, "^https?://[^/]*", "")).otherwise(bare), " ", "%20")
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(t == "", "").when(absolute, F.concat(host, rooted)).otherwise(F.concat(F.lit(site), rooted))


def bare_path(x: Column) -> Column:
    """Path without query and hash, up to 200 characters; '/' for what is not a path."""
    p = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "[?#].*$", "")
    return F.when(p.startswith("/"), F.substring(p, 1, 200)).otherwise("/")


def basename(x: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.coalesce(x, F.lit("")), "[?#].*$", ""), "/", -1)


#: Hosts and the page paths that are product pages there.
PRODUCT_PAGES = (
    ("jbhifi.com.au", "^/products/"),
    ("appliancesonline.com.au", "^/product/"),
    ("appliances-online.com.au", "^/product/"),
    ("binglee.com.au", "^/products/"),
    ("harveynorman.com.au", r"\.html$"),
    ("thegoodguys.com.au", "^/[^/]+-[^/]+$"),
)
#: Query keys and path parts of search and listing pages.
SEARCH_KEYS = ("q", "query", "searchterm", "text", "keyword")
LISTING = r"/(search|searchdisplay|catalogsearch|collections?|category|categories|cart|checkout)(/|$)"


def let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """then of a struct of values, each of which is evaluated once however often it is named (Spark would repeat it in each branch)."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), then)[0]


def _product_url(url: Column, unknown_host: bool, keys: str) -> Column:
    u = F.trim(url)
    parts = {
        "host": F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", ""), "path": F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/+$", "")),
        "query": F.concat(F.lit("&"), F.coalesce(F.try_parse_url(u, F.lit("QUERY")), F.lit(""))), "protocol": F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))),
    }

    def passes(x: Column) -> Column:
        rule = F.lit(unknown_host)
        for name, pattern in reversed(PRODUCT_PAGES):
            rule = F.when(x["host"].endswith(name), x["path"].rlike(pattern)).otherwise(rule)
        ok = x["protocol"].isin("http", "https") & (x["host"] != "") & (x["path"] != "") & ~x["query"].rlike(keys) & ~x["path"].rlike(LISTING)
        return F.coalesce(ok & rule, F.lit(False))

    return let(parts, passes)


def is_product_url_lenient(url: Column) -> Column:
    """Unknown hosts pass."""
    return _product_url(url, True, f"&({'|'.join(SEARCH_KEYS)})(=|&|$)")


def is_product_url_strict(url: Column) -> Column:
    """Unknown hosts fail."""
    return _product_url(url, False, f"&({'|'.join(SEARCH_KEYS)})(=|&|$)")


def is_product_url_audit(url: Column) -> Column:
    """Strict, with one more search key and any case."""
    return _product_url(url, False, f"(?i)&({'|'.join([*SEARCH_KEYS, 'search'])})(=|&|$)")
