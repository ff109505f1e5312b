"""A search session: input checks, URL state, space alerts, badges and bars, empty states, the fit checker."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import js_round, to_mm
from spanfit.operators.fit import FitQuery, find_matches

#: Sort orders and clearance modes of a URL, and the limits that say when space is tight.
SORTS = ("best-fit", "price-asc", "price-desc", "popularity", "stars")
MODES = ("physical", "practical", "manufacturer")
SEARCH_MODES, REPLACED = ("cavity", "replacement"), ("fridge", "washing_machine", "dryer", "dishwasher", "washtower_combo")
TOWER_NAMES = ("washtower", "wash_tower", "laundry_tower", "combo", "washtower_combo")
NARROW_FRIDGE, SHALLOW_FRIDGE, LOW_FRIDGE, SLIM_DISHWASHER, SHALLOW_LAUNDRY, NARROW_DOOR = 600, 650, 1700, 600, 600, 760


def _mm(x: object) -> int | None:
    """Millimetres of a plain decimal text, rounded half up; None for all else and for 0."""
    t = str(x if x is not None else "").strip()
    if not t or not t.replace(".", "", 1).isdigit() or t[0] == "." or t[-1] == "." or not t.isascii():
        return None
    return int(float(t) + 0.5) or None


def _tolerance(x: object) -> float:
    """A number held within 0 and 20; 5 for 0 and for what is no number."""
    try:
        found = float(x)
    except (TypeError, ValueError):
        return 5.0
    return min(20.0, max(0.0, found)) if found and found == found else 5.0


def replaced_category(x: object) -> str | None:
    """The category that is to be replaced: spaces, slashes and hyphens are one, towers have several names; None for what is no category."""
    name = re.sub(r"-+", "_", re.sub(r"[\s/]+", "_", str(x if x is not None else "").strip().lower()))
    return "washtower_combo" if name in TOWER_NAMES else name if name in REPLACED else None


def _number(x: object) -> float | None:
    try:
        found = float(x)
    except (TypeError, ValueError):
        return None
    return found if found >= 0 and found != float("inf") else None


@dataclass(frozen=True)
class SearchState:
    """What a search URL says."""

    cat: str | None = None
    w: int | None = None
    h: int | None = None
    d: int | None = None
    tolerance: float = 5.0
    preset: str | None = None
    brands: tuple[str, ...] = ()
    price_min: float | None = None
    price_max: float | None = None
    stars: float | None = None
    available_only: bool = False
    mode: str = "practical"
    retailer_only: bool = True
    sort: str = "best-fit"
    search_mode: str = "cavity"
    source_cat: str | None = None


def write_url(s: SearchState) -> str:
    """The state as a query string; settings that are as by default are left out."""
    text = lambda x: str(int(x)) if float(x).is_integer() else repr(float(x))
    pairs = [("cat", s.cat), *((a, getattr(s, a)) for a in "whd"), ("tol", text(s.tolerance)), ("preset", s.preset), *(("brand", b) for b in s.brands)]
    pairs += [(k, None if v is None else text(v)) for k, v in (("pmin", s.price_min), ("pmax", s.price_max), ("stars", s.stars))]
    pairs += [("avail", "1" if s.available_only else None), ("mode", None if s.mode == "practical" else s.mode), ("searchMode", None if s.search_mode == "cavity" else s.search_mode), ("replaceCat", replaced_category(s.source_cat)), ("showAll", None if s.retailer_only else "1"), ("sort", s.sort)]
    return urlencode([(k, v) for k, v in pairs if v not in (None, "")])


def read_url(query: str) -> SearchState:
    """The state of a query string: what is no number, mode or order is as by default; a single brand may list several with commas."""
    pairs = parse_qsl(query.removeprefix("?"), keep_blank_values=True)
    first = {k: v for k, v in reversed(pairs)}
    brands = [v.strip() for k, v in pairs if k == "brand"]
    if len(brands) == 1:
        brands = brands[0].split(",")
    return SearchState(
        cat=first.get("cat") or None, **{a: _mm(first.get(a)) for a in "whd"}, tolerance=_tolerance(first.get("tol", 5)), preset=first.get("preset") or None, brands=tuple(x for b in brands if (x := b.strip()[:50])),
        price_min=_number(first.get("pmin") or None), price_max=_number(first.get("pmax") or None), stars=_number(first.get("stars") or None), available_only=first.get("avail") == "1",
        mode=first.get("mode") if first.get("mode") in MODES else "practical", retailer_only=first.get("showAll") != "1", sort=first.get("sort") if first.get("sort") in SORTS else "best-fit",
        search_mode=mode if (mode := first.get("searchMode", "").strip()) in SEARCH_MODES else "cavity", source_cat=replaced_category(first.get("replaceCat")),
    )


def read_urls(rows: DataFrame, query: str = "query") -> DataFrame:
    """rows (of logged searches) with the columns of their URLs' states: the same rules as read_url, for a whole log."""
    q = F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?", "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("key"), plain(F.regexp_extract(x, "=(.*)$", 1)).alias("value"))
    rows = rows.withColumn("url_pairs", F.transform(F.split(q, "&"), pair))
    of = lambda k: F.transform(F.filter("url_pairs", lambda p: p["key"] == k), lambda p: p["value"])
    # One step after another, so that no value is worked out twice.
    names = ("cat", "w", "h", "d", "tol", "pmin", "pmax", "stars", "avail", "mode", "searchMode", "replaceCat", "showAll", "sort")
    rows = rows.withColumns({**{f"url_{k}": F.get(F.filter(of(k), lambda v, i: (i == 0) & (v != "")), F.lit(0)) for k in names}, "url_brands": F.transform(of("brand"), lambda b: F.trim(b))})
    first = lambda k: F.col(f"url_{k}")
    rows = rows.withColumns({f"url_{k}": first(k).try_cast("double") for k in ("tol", "pmin", "pmax", "stars")})
    number = lambda k: F.when(first(k) >= 0, first(k))
    brands = F.when(F.size("url_brands") == 1, F.split(F.get("url_brands", F.lit(0)), ",")).otherwise(F.col("url_brands"))
    source = F.regexp_replace(F.regexp_replace(F.lower(F.trim(first("replaceCat"))), r"[\s/]+", "_"), "-+", "_")
    tolerance = F.when((first("tol") == 0) | F.isnan(first("tol")), 5.0).otherwise(F.coalesce(first("tol"), F.lit(5.0)))
    out = rows.withColumns(
        {
            "cat": first("cat"), **{a: to_mm(first(a)) for a in "whd"}, "tolerance": F.least(F.lit(20.0), F.greatest(F.lit(0.0), tolerance)), "brands": F.filter(F.transform(brands, lambda b: F.substring(F.trim(b), 1, 50)), lambda b: b != ""),
            "price_min": number("pmin"), "price_max": number("pmax"), "min_stars": number("stars"), "available_only": F.coalesce(first("avail") == "1", F.lit(False)),
            "mode": F.when(first("mode").isin(*MODES), first("mode")).otherwise("practical"), "retailer_only": ~F.coalesce(first("showAll") == "1", F.lit(False)), "sort": F.when(first("sort").isin(*SORTS), first("sort")).otherwise("best-fit"),
            "search_mode": F.when(F.trim(first("searchMode")).isin(*SEARCH_MODES), F.trim(first("searchMode"))).otherwise("cavity"), "source_cat": F.when(source.isin(*TOWER_NAMES), "washtower_combo").when(source.isin(*REPLACED), source),
        }
    )
    return out.drop("url_pairs", "url_brands", *(f"url_{k}" for k in names))


def input_verdict() -> Column:
    """Of texts w, h, d: 'invalid' if one is given and is no size, 'missing' if none is given, else 'ok'."""
    given = [(F.trim(F.coalesce(a, F.lit(""))) != "", to_mm(F.col(a)).isNotNull()) for a in "whd"]
    wrong, any_ = F.lit(False), F.lit(False)
    for filled, good in given:
        wrong, any_ = wrong | (filled & ~good), any_ | good
    return F.when(wrong, "invalid").when(~any_, "missing").otherwise("ok")


def checked_sizes(w: object = None, h: object = None, d: object = None) -> tuple[str, dict[str, int]]:
    """The verdict of input_verdict, and the sizes of a valid input."""
    given = {a: x for a, x in zip("whd", (w, h, d), strict=True) if str(x if x is not None else "").strip()}
    sizes = {a: _mm(x) for a, x in given.items()}
    if None in sizes.values():
        return "invalid", {}
    return ("ok", sizes) if sizes else ("missing", {})


def space_alerts() -> Column:
    """Ids of alerts about a cavity (cat, w, h, d, door), in order; none unless category and all sizes are known."""
    cat, w, h, d, door = (F.col(c) for c in ("cat", "w", "h", "d", "door"))
    whole = (F.trim(cat) != "") & (w > 0) & (h > 0) & (d > 0)
    fridge, laundry = cat == "fridge", cat.isin("washing_machine", "dryer")
    rules = (
        (fridge & (w <= NARROW_FRIDGE), "fridge-600-width"), (fridge & (d < SHALLOW_FRIDGE), "shallow-depth"), (fridge & (h < LOW_FRIDGE), "low-height"),
        ((cat == "dishwasher") & (w < SLIM_DISHWASHER), "slimline-dishwasher"), (laundry & (d < SHALLOW_LAUNDRY), "shallow-laundry-depth"), ((door > 0) & (door < NARROW_DOOR), "tight-delivery-path"),
    )
    return F.when(F.coalesce(whole, F.lit(False)), F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))).otherwise(F.array().cast("array<string>"))


def clearance_bar(cavity: Column, appliance: Column, clearance: Column) -> dict[str, Column]:
    """used_mm, spare_mm, tone, striped and fill of the bar that shows a cavity's use."""
    room = F.greatest(F.lit(0), js_round(F.coalesce(clearance.cast("double"), F.lit(0.0))))
    known = (cavity > 0) & (appliance > 0)
    used = appliance + room
    spare = js_round((cavity - used).cast("double"))
    fill = F.greatest(F.lit(0), F.least(F.lit(100), js_round(used / cavity * 100)))
    known = F.coalesce(known, F.lit(False))
    return {
        "used_mm": F.when(appliance > 0, js_round(used.cast("double"))).cast("int"), "spare_mm": F.when(known, spare).cast("int"), "tone": F.when(~known, "unknown").when(spare >= 20, "green").when(spare >= 5, "amber").otherwise("red"),
        "striped": known & (spare < 0), "fill": F.when(known, fill).otherwise(45).cast("int"),
    }


def axis_bar(gap: Column) -> dict[str, Column]:
    """status and fill of one axis from its gap."""
    g = gap.cast("double")
    fill = F.when(g < 0, 8.0).when(g < 20, F.greatest(F.lit(18.0), F.least(F.lit(68.0), 18 + g * 2.5))).otherwise(F.greatest(F.lit(72.0), F.least(F.lit(100.0), 72 + (g - 20) * 0.35)))
    return {"status": F.when(g < 0, "blocked").when(g < 20, "tight").otherwise("safe"), "axis_fill": fill}


def badge() -> dict[str, Column]:
    """badge_gap and badge of a row: the room it lacks, else its gap, else its score in mm, else 4 or 20."""
    needed = F.when(F.col("needed_mm") > 0, F.ceil(F.col("needed_mm").cast("double")))
    score = F.when(F.col("fit_score").isNotNull(), F.greatest(F.lit(0), js_round(F.col("fit_score") * F.least("w", "h", "d"))))
    gap = F.coalesce(needed, js_round(F.col("gap").cast("double")), score, F.when(F.col("fits_tightly"), 4).otherwise(20)).cast("int")
    return {"badge_gap": gap, "badge": F.when(needed.isNotNull(), "relax").when(F.coalesce(F.col("fits_tightly"), F.lit(False)) | (gap < 5), "tight").otherwise("exact")}


def empty_state(exact: Column, relaxed: Column, tolerance: Column, label: Column) -> dict[str, Column]:
    """title, detail and action of a result list."""
    more, mm = F.coalesce(relaxed, F.lit(0)), F.coalesce(tolerance, F.lit(5)).cast("string")
    return {
        "title": F.concat(exact.cast("string"), F.lit(" exact matches.")), "detail": F.when(more > 0, F.concat(more.cast("string"), F.lit(" fit with +"), mm, F.lit("mm tolerance."))).otherwise(F.concat(F.lit("No "), F.lower(label), F.lit(" fit yet. Try a preset or relax the tolerance."))),
        "action": F.when(more > 0, F.concat(F.lit("Relax to "), mm, F.lit("mm"))).otherwise("Try a preset"),
    }


def fit_check(products: DataFrame, cat: str | None = None, w: object = None, h: object = None, d: object = None) -> tuple[str, DataFrame | None]:
    """The fit checker's run: the input's verdict and, for a valid one, the ranked matches. (A tolerance of 0 or more admits nothing further.)"""
    verdict, sizes = checked_sizes(w, h, d)
    return verdict, find_matches(products, FitQuery(cat=cat, **sizes)) if verdict == "ok" else None
