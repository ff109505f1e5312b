"""Fit of products into a cavity: clearance, gaps, scores, tiers, near misses, replacement mode."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import by_name, clamp, js_round

AXES = ("w", "h", "d")
NAMES = {"w": "width", "h": "height", "d": "depth"}
#: Clearance of the two literal modes, and the weights of the axes in the score of 100.
MODES = {"physical": {"side": 0, "top": 0, "rear": 0}, "practical": {"side": 5, "top": 20, "rear": 10}}
WEIGHTS = {"w": 0.40, "h": 0.30, "d": 0.30}
TOWER = r"(?i)(wash\s*tower|laundry\s*tower|washer[-\s]?dryer\s*tower|stacked\s+washer\s+dryer|all[-\s]?in[-\s]?one\s+laundry\s+tower|\bWWT[-\w]*\b|\bWK[-\w]*\b)"


@dataclass(frozen=True)
class FitQuery:
    """A cavity (mm; None: axis not given), a category and the way clearance is taken."""

    w: int | None = None
    h: int | None = None
    d: int | None = None
    cat: str | None = None
    mode: str = "practical"
    replacement: bool = False
    source_category: str | None = None
    tolerance_mm: int = 0
    null_dim_as_zero: bool = False
    cavity: dict = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.cavity.update({a: getattr(self, a) for a in AXES if getattr(self, a)})


def is_tower(products: DataFrame) -> Column:
    """Washer-and-dryer towers, by category or by what their texts say."""
    named = [c for c in ("cat", "brand", "model", "display_name", "type") if c in products.columns]
    text = F.concat_ws(" ", *named, *([F.array_join("features", " ")] if "features" in products.columns else []))
    return F.coalesce((F.col("cat") == "washtower_combo") | text.rlike(TOWER), F.lit(False))


def in_category(products: DataFrame, q: FitQuery) -> DataFrame:
    if q.cat is None:
        return products
    return products.where(is_tower(products) if q.cat == "washtower_combo" else F.col("cat") == q.cat)


def not_quarantined(products: DataFrame, q: FitQuery) -> DataFrame:
    """In replacement mode: towers replace towers; others are not replaced by them where that is hopeless."""
    if not q.replacement:
        return products
    tower = is_tower(products)
    if q.source_category == "washtower_combo":
        return products.where(tower)
    if q.source_category in ("washing_machine", "dryer"):
        return products.where(~tower)
    return products.where(~tower | ~F.coalesce(F.lit(q.h or 0) + 200 <= F.col("h"), F.lit(False)) if q.h else F.lit(True))


def resolve_clearance(products: DataFrame, mode: str, rules: DataFrame | None = None, fallback: dict | None = None) -> DataFrame:
    """Adds clear_side, clear_top, clear_rear. Mode manufacturer: the brand's rule, else its category's `__default__`, else fallback."""
    if mode in MODES:
        return products.withColumns({f"clear_{k}": F.lit(v) for k, v in MODES[mode].items()})
    fallback = MODES["practical"] if fallback is None else fallback
    sides = ("side", "top", "rear")
    own = rules.select(F.col("cat").alias("rule_cat"), F.col("brand").alias("rule_brand"), *(F.col(s).alias(f"own_{s}") for s in sides))
    default = rules.where("brand = '__default__'").select(F.col("cat").alias("default_cat"), *(F.col(s).alias(f"default_{s}") for s in sides))
    joined = products.join(own, (F.col("cat") == F.col("rule_cat")) & (F.col("brand") == F.col("rule_brand")), "left").join(default, F.col("cat") == F.col("default_cat"), "left")
    return joined.select(*products.columns, *(F.coalesce(f"own_{s}", f"default_{s}", F.lit(fallback[s])).cast("int").alias(f"clear_{s}") for s in sides))


def _clearance(axis: str) -> Column:
    return {"w": F.col("clear_side") * 2, "h": F.col("clear_top"), "d": F.col("clear_rear")}[axis]


def with_fit(products: DataFrame, q: FitQuery) -> DataFrame:
    """From rows with clear_*: gap_*, fit_score (least axis), sort_score (mean), fit_score_numeric, binding_axis, tightest_gap_mm, required_*, size_gap_*."""
    zero = F.lit(0)
    dim = {a: F.coalesce(a, zero) if q.null_dim_as_zero else F.col(a) for a in AXES}
    taken = {a: zero if q.replacement else _clearance(a) for a in AXES}
    rows = products.withColumns({f"gap_{a}": (F.lit(c) - dim[a] - taken[a]).cast("int") for a, c in q.cavity.items()})
    rows = rows.withColumns({f"axis_{a}": clamp((F.lit(c) - dim[a] - taken[a]) / F.lit(float(c)), -0.05, 0.5) for a, c in q.cavity.items()})
    scores = [F.col(f"axis_{a}") for a in q.cavity]
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    least = F.array_min(F.array(*(F.struct(F.col(f"gap_{a}").alias("gap"), F.lit(k).alias("k"), F.lit(NAMES[a]).alias("axis")) for k, a in enumerate(q.cavity))))
    rows = rows.withColumns({"fit_score": F.least(*scores) if len(scores) > 1 else scores[0], "sort_score": total / F.lit(float(len(scores))), "least_gap": least})
    weighted = F.lit(0.0)
    for a, c in q.cavity.items():
        weighted = weighted + F.least(F.lit(1.0), (F.greatest(zero, F.col(f"gap_{a}")) / F.lit(float(c))) / F.lit(0.2)) * F.lit(WEIGHTS[a])
    tightest = F.col("least_gap.gap")
    penalty = F.when(tightest < 5, 0.85).when(tightest < 10, 0.95).otherwise(1.0)
    raw = F.when(tightest < 0, 0).otherwise(js_round(weighted * F.lit(100.0) * penalty))
    numeric = F.lit(None).cast("int") if q.replacement else F.least(F.lit(100), F.greatest(zero, raw)).cast("int")
    extra = {"fit_score_numeric": numeric, "binding_axis": F.col("least_gap.axis"), "tightest_gap_mm": tightest, "exact_fit": F.col("fit_score") >= 0, "fits_tightly": F.exists(F.array(*scores), lambda s: s < 0.02)}
    extra |= {f"required_{a}": (F.coalesce(a, zero) + _clearance(a)).cast("int") for a in AXES}
    extra |= {f"size_gap_{a}": (F.lit(q.cavity.get(a, 0)) - F.coalesce(a, zero)).cast("int") for a in AXES}
    return rows.withColumns(extra).drop("least_gap", *(f"axis_{a}" for a in q.cavity))


def fits(products: DataFrame, q: FitQuery, rules: DataFrame | None = None) -> DataFrame:
    """All products that fit, unordered. With literal clearance the test is a bound on the stored dimension, and reaches the scan."""
    rows = not_quarantined(in_category(products, q), q)
    if not q.cavity:
        return with_fit(resolve_clearance(rows, "physical"), replace(q, w=1)).limit(0)
    if q.mode in MODES or q.replacement:
        c = MODES["physical"] if q.replacement else MODES[q.mode]
        bound = {"w": 2 * c["side"], "h": c["top"], "d": c["rear"]}
        for a, size in q.cavity.items():
            test = F.col(a) <= size - bound[a]
            rows = rows.where(test | F.col(a).isNull() if q.null_dim_as_zero else test)
    rows = with_fit(resolve_clearance(rows, q.mode, rules), q)
    for a in q.cavity:
        rows = rows.where(F.col(f"gap_{a}") >= 0)
    return rows.where(F.col("fit_score") >= -(q.tolerance_mm / min(q.cavity.values())))


def best_first() -> list[Column]:
    """Tightest mean slack, then priority, then name in the order of a dictionary; the ordinal settles the rest."""
    return [F.asc("sort_score"), F.coalesce("priority", F.lit(0)).desc(), by_name(F.coalesce("display_name", "brand", F.lit(""))).asc(), F.asc("ord")]


def find_matches(products: DataFrame, q: FitQuery, rules: DataFrame | None = None, limit: int | None = 60) -> DataFrame:
    """The best matches in order."""
    rows = fits(products, q, rules).orderBy(*best_first())
    return rows if limit is None else rows.limit(max(1, limit))


def near_misses(products: DataFrame, q: FitQuery, limit: int = 10) -> DataFrame:
    """What fits bare but lacks practical clearance, least shortfall first: needed_mm and needed_axis (first of equal ones)."""
    rows = fits(products, replace(q, mode="physical"))
    need = {a: F.greatest(F.lit(0), F.col(a) + {"w": 2 * c["side"], "h": c["top"], "d": c["rear"]}[a] - F.lit(size)) for c in (MODES["practical"],) for a, size in q.cavity.items()}
    most = F.array_max(F.array(*(F.struct(n.cast("int").alias("mm"), F.lit(-k).alias("k"), F.lit(NAMES[a]).alias("axis")) for k, (a, n) in enumerate(need.items()))))
    rows = rows.withColumn("most", most).withColumns({"needed_mm": F.col("most.mm"), "needed_axis": F.col("most.axis")}).drop("most").where("needed_mm > 0")
    return rows.orderBy(F.asc("needed_mm"), *best_first()).limit(max(1, limit))


def tier(score: Column) -> Column:
    """Fixed thresholds of a score of 100."""
    return F.when(score >= 90, "excellent").when(score >= 75, "strong").when(score >= 60, "workable").when(score >= 40, "tight").when(score >= 1, "marginal").otherwise("no-fit")


def tier_label(name: Column) -> Column:
    labels = {"excellent": "Excellent fit", "strong": "Strong fit", "workable": "Workable fit", "tight": "Tight fit", "marginal": "Marginal fit", "no-fit": "Won't fit"}
    return F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), name)


def deduction_score(q: FitQuery, side: int = 20, rear: int = 50, top: int = 50) -> dict[str, Column]:
    """The older score: 100 less up to 40, 30 and 30 for tight sides, top and rear; 0 if an axis does not fit. Also the number of warnings."""
    need = {"w": (side * 2, 40), "h": (top, 30), "d": (rear, 30)}
    lost, warned, no = F.lit(0), F.lit(0), F.lit(False)
    for a, size in q.cavity.items():
        required, most = need[a]
        gap = F.lit(size) - F.col(a)
        short = (gap >= 0) & (gap < required)
        lost = lost + F.when(short, F.least(F.lit(most), js_round((required - gap) / F.lit(float(required)) * most))).otherwise(0)
        warned = warned + short.cast("int")
        no = no | (gap < 0)
    return {"deduction_score": F.when(no, 0).otherwise(F.greatest(F.lit(0), 100 - lost)).cast("int"), "n_warnings": F.when(no, 1).otherwise(warned).cast("int")}


def awkward_flags(top_clearance: str | None = None) -> Column:
    """Names of awkward spaces that the product suits, in fixed order."""
    least = F.least(F.when(F.col("w") > 0, F.col("w")), F.when(F.col("d") > 0, F.col("d")))
    flags = [F.when((F.col("d") > 0) & (F.col("d") <= 550), "shallow-depth"), F.when((F.col("h") > 0) & (F.col("h") <= 1700), "low-cavity")]
    if top_clearance:
        flags.append(F.when(F.col(top_clearance) == 0, "no-top-clearance"))
    flags.append(F.when((F.col("cat") == "dryer") & F.col("type").rlike(r"(?i)heat\s*pump"), "apartment-ok"))
    flags.append(F.when(least <= 600, "narrow-doorway"))
    return F.array_compact(F.array(*flags))


def width_verdict(cavity_w: Column) -> dict[str, Column]:
    """Width-only verdict at practical side clearance."""
    gap = (cavity_w - (F.col("w") + 2 * MODES["practical"]["side"])).cast("int")
    return {"gap": gap, "verdict": F.when(gap >= 20, "perfect").when(gap >= 5, "tight").when(gap >= 0, "binding").otherwise("no-fit")}


def score_breakdown(q: FitQuery) -> dict[str, Column]:
    """Per axis: percent of a full score (rounded before weighting) and its contribution; all axes' sum with the penalty."""
    out, total = {}, F.lit(0.0)
    for a, c in q.cavity.items():
        percent = js_round(F.least(F.lit(1.0), (F.greatest(F.lit(0), F.col(f"gap_{a}")) / F.lit(float(c))) / F.lit(0.2)) * 100)
        out[f"percent_{a}"] = percent.cast("int")
        total = total + percent * F.lit(WEIGHTS[a])
    tight = F.col("tightest_gap_mm")
    out["penalty_percent"] = F.when(tight < 5, 15).when(tight < 10, 5).otherwise(0)
    return out | {"breakdown_total": js_round(total * (100 - out["penalty_percent"]) / 100).cast("int")}


def replacement_dimensions() -> dict[str, Column]:
    """A cavity to look for when a product goes: its size with a fixed buffer, null where a dimension is missing."""
    whole = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("d") > 0)
    return {f"cavity_{a}": F.when(whole, F.col(a) + b).cast("int") for a, b in {"w": 10, "h": 20, "d": 10}.items()}


def delivery_path() -> dict[str, Column]:
    """Narrowest doorway and turning space that delivery needs."""
    return {"doorway_mm": F.ceil(F.least("w", "d") + 50).cast("int"), "turning_mm": F.ceil(F.greatest("w", "d")).cast("int")}
