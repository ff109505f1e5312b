"""Spec sheets: sizes and clearances of a model out of a document's text, by rules that are rows of a table (P-51)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """Within a slot (dimensions or clearance) of a brand and category the lowest rank that gives all of its fields counts.

    section: whole, specification or installation. kind: `first` or `last` match of the pattern; `model`, the first match
    whose group 1 names the model; `row`, the numbers of the first line that names the model, after the pattern's match.
    fields: `name=group`, `name=:value` for a fixed one; those with `?` may be missing.
    """

    brand: str
    cat: str
    slot: str
    rank: int
    section: str
    kind: str
    pattern: str
    fields: str


_N = r"(\d+(?:\.\d+)?)"
_Q = "[“\"'”]?"
_SIDES = "top_mm={0} left_mm={0} right_mm={0} rear_mm={0}"
_ALCOVE = (
    ("clearance", 1, "installation", "first", rf"minimum\s+clearances?[\s\S]{{0,220}}?Sides\s+Top\s+Front\s+Rear\s+{_N}\s*mm\s+{_N}\s*mm\s+{_N}\s*mm\s+{_N}\s*mm", "left_mm=1 right_mm=1 top_mm=2 rear_mm=4"),
    ("clearance", 2, "installation", "first", rf"Sides\s*(?:[-–—:]\s*)?{_N}\s*mm", "left_mm=1 right_mm=1"),
    ("clearance", 2, "installation", "first", rf"Top\s*(?:[-–—:]\s*)?{_N}\s*mm", "top_mm=1"),
    ("clearance", 2, "installation", "first", rf"Rear\s*(?:[-–—:]\s*)?{_N}\s*mm", "rear_mm=1"),
)
_TWO = r"\s+".join(rf"{c}\s+(\d+)\s+(\d+)" for c in "ABCDEFGH")
#: What the makers' sheets look like. A maker's new layout is another row.
RULES = (
    Rule("samsung", "fridge", "dimensions", 1, "both", "first", rf"Height\s*\(mm\)\s+{_N}", "height_mm=1"),
    Rule("samsung", "fridge", "dimensions", 1, "both", "first", rf"Width\s*\(mm\)\s+{_N}", "width_mm=1"),
    Rule("samsung", "fridge", "dimensions", 1, "both", "first", rf"Depth\s+w\.\s*Door\s*\(mm\)\s+{_N}", "depth_mm=1"),
    Rule("samsung", "fridge", "dimensions", 2, "both", "first", rf"Height\s*\(mm\)\s+{_N}", "height_mm=1"),
    Rule("samsung", "fridge", "dimensions", 2, "both", "first", rf"Width\s*\(mm\)\s+{_N}", "width_mm=1"),
    Rule("samsung", "fridge", "dimensions", 2, "both", "first", rf"Depth\s*\(mm\)\s+{_N}", "depth_mm=1"),
    *(
        Rule("samsung", "fridge", "dimensions", rank, "both", "first", pattern, fields)
        for rank, height in ((3, rf"Overall\s+Height\s+{_Q}D{_Q}\s+{_N}\s*mm"), (4, rf"Height\s+{_Q}C{_Q}\s+{_N}\s*mm"))
        for pattern, fields in ((height, "height_mm=1"), (rf"Depth\s+{_Q}A{_Q}\s+{_N}\s*mm", "depth_mm=1"), (rf"Width\s+{_Q}B{_Q}\s+{_N}\s*mm", "width_mm=1"), (rf"\b03\s+{_N}\s*mm", "door_open_90_depth_mm?=1"))
    ),
    *(Rule("samsung", "fridge", "clearance", k, "installation", "first", p, _SIDES.format(1)) for k, p in ((1, rf"\b01\s+{_N}\s*mm"), (2, rf"\b01\s+more\s+than\s+{_N}\s*mm"), (3, rf"Allow clearance[^.\n]*{_N}\s*mm"))),
    *(Rule("samsung", "dryer", "dimensions", 1, "specification", "last", rf"\b{c}\s+{_N}\s*mm", f) for c, f in (("A", "width_mm=1"), ("B", "height_mm=1"), ("C", "depth_mm=1"), ("E", "door_open_90_depth_mm?=1"))),
    Rule("samsung", "washing_machine", "dimensions", 1, "specification", "first", rf"Net\s+Dimension\s*\(WxHxD\)\s+{_N}\s*x\s*{_N}\s*x\s*{_N}\s*mm", "width_mm=1 height_mm=2 depth_mm=3"),
    Rule("samsung", "washing_machine", "dimensions", 2, "specification", "model", rf"\bDIMENSIONS?\s+([A-Z0-9*\/\s-]{{3,120}}?)\s+W\s*{_N}\s*mm?\s*[x×]\s*D\s*{_N}\s*mm?\s*[x×]\s*H\s*{_N}\s*mm?", "width_mm=2 depth_mm=3 height_mm=4"),
    Rule("samsung", "washing_machine", "dimensions", 3, "specification", "model", rf"Model name\s+([A-Z]{{2,}}\d[A-Z0-9*]+)[\s\S]*?Dimensions\s+Width\s+{_N}\s*mm\s+Height\s+{_N}\s*mm\s+Depth\s+{_N}\s*mm", "width_mm=2 height_mm=3 depth_mm=4"),
    Rule("samsung", "washing_machine", "dimensions", 4, "specification", "model", rf"Model name\s+([A-Z]{{2,}}\d[A-Z0-9*]+)[\s\S]*?Dimensions\s+A\s*\(Width\)\s+{_N}\s*mm\s+B\s*\(Height\)\s+{_N}\s*mm\s+C\s*\(Depth\)\s+{_N}\s*mm", "width_mm=2 height_mm=3 depth_mm=4"),
    Rule("samsung", "dishwasher", "dimensions", 1, "specification", "first", rf"Dimension\s*\(Width\s*x\s*Depth\s*x\s*Height\)\s*{_N}\s*x\s*{_N}\s*x\s*{_N}\s*mm", "width_mm=1 depth_mm=2 height_mm=3"),
    *(Rule("samsung", c, *r) for c in ("dryer", "washing_machine", "dishwasher") for r in _ALCOVE),
    Rule("lg", "fridge", "dimensions", 1, "flat", "column", rf"\bSize\s*\(mm\)\s*-?\s*Type\s+1\s+Type\s+2\s+{_TWO}", "width_mm=1 height_mm=3 depth_mm=5 door_open_90_depth_mm=15"),
    Rule("lg", "fridge", "clearance", 1, "flat", "first", rf"Allow\s+over\s+{_N}\s*mm\s+of\s+clearance\s+from\s+each\s+adjacent\s+wall", "top_mm=:0 left_mm=1 right_mm=1 rear_mm=1"),
    Rule("lg", "fridge", "clearance", 2, "flat", "first", rf"Allow\s+over\s+{_N}\s*mm\s+of\s+clearance\s+between\s+the\s+back\s+of\s+the\s+appliance\s+and\s+the\s+wall", "top_mm=:0 left_mm=:0 right_mm=:0 rear_mm=1"),
    *(Rule("lg", c, "dimensions", 1, "flat", "first", rf"\bW\s+{_N}\s+D\s+{_N}\s+D[\"”']?\s+{_N}\s+H\s+{_N}", "width_mm=1 depth_mm=2 door_open_90_depth_mm=3 height_mm=4") for c in ("washing_machine", "dryer")),
    Rule("lg", "washing_machine", "clearance", 1, "flat", "first", rf"(?:minimum\s+)?clearances\s+of\s+at\s+least\s+{_N}\s*mm\s+at\s+the\s+sides\s+and\s+{_N}\s*mm\s+behind\s+the\s+appliance", "left_mm=1 right_mm=1 rear_mm=2"),
    Rule("lg", "washing_machine", "clearance", 1, "flat", "first", rf"(?:clearance\s+of\s+approximately|Keep\s+at\s+least)\s+{_N}\s*mm\s+(?:is\s+left\s+)?between\s+the\s+top\s+of\s+the\s+appliance|$", "top_mm=1|0"),
    Rule("lg", "dryer", "clearance", 1, "flat", "first", rf"(?:clearance\s+of\s+approximately|Keep\s+at\s+least)\s+{_N}\s*mm\s+(?:is\s+left\s+)?between\s+the\s+top\s+of\s+the\s+appliance", "top_mm=1 left_mm=:0 right_mm=:0 rear_mm=:0"),
    Rule("lg", "dishwasher", "dimensions", 1, "flat", "first", rf"\bDimension\s*\(Width\s*X\s*Height\s*X\s*Depth\)\s+{_N}\s*mm\s*X\s*{_N}\s*mm\s*X\s*{_N}\s*mm", "width_mm=1 height_mm=2 depth_mm=3"),
    Rule("lg", "dishwasher", "clearance", 1, "flat", "first", rf"allow\s+minimum\s+clearance\s+of\s+at\s+least\s+{_N}\s*mm\s+between\s+the\s+appliance\s+and\s+an\s+adjacent\s+cabinet\s+or\s+wall", "top_mm=:0 left_mm=1 right_mm=1 rear_mm=:0"),
    Rule("westinghouse", "fridge", "dimensions", 1, "whole", "row", "", "height_mm=1 width_mm=2 depth_mm=3 door_open_90_depth_mm=4"),
    Rule("westinghouse", "fridge", "clearance", 1, "whole", "row", r"\bAirspace\b", "left_mm=1 right_mm=1 top_mm=2 rear_mm=3"),
)
#: Where sections of a sheet begin and end, and what speaks for one of several beginnings.
SECTIONS = {
    "installation": (
        (r"\bInstallation requirements\b", r"\bSTEP\s+1\s+Select a site\b", r"\bAlcove (?:or closet )?installation\b"), (r"\bOperations\b", r"\bBefore you start\b", r"\bSpecification(?:s| sheet)?\b"),
        rf"\b(?:Clearance|minimum clearance|Sides\s+Top|Sides\s+\d+(?:\.\d+)?\s*mm|STEP\s+1\s+Select a site|Depth\s+{_Q}A{_Q})\b",
    ),
    "specification": (
        (r"\bSpecification sheet\b", r"\bSpecifications\b", r"\bSpecification\b"), (r"\bMemo\b", r"\bQUESTIONS OR COMMENTS\b", r"\bFor standard test\b"),
        r"\b(?:DIMENSIONS|Dimensions|Model name|Width\s+\d+(?:\.\d+)?\s*mm|Dimension\s*\(Width)\b",
    ),
}
#: Words that say what a sheet is about, and how far into it they are looked for.
KINDS = (("dishwasher", r"\bDishwasher\b"), ("washing_machine", r"\bWashing\s+Machine\b|\bFront loading washing machine\b|\bWasher\b"), ("dryer", r"\bHeat\s+Pump\s+Dryer\b|\bTumble\s+Dryer\b|\bFront loading dryer\b|\bDryer\b"), ("fridge", r"\bRefrigerator\b|\bFridge\b|\bFreezer\b"))
HEAD, WINDOW = 2500, 8000
FIELDS = ("width_mm", "height_mm", "depth_mm", "door_open_90_depth_mm", "top_mm", "left_mm", "right_mm", "rear_mm")
_TOKEN = re.compile(r"[A-Z0-9][A-Z0-9*/-]*")


@cache
def _pattern(p: str) -> re.Pattern:
    return re.compile(p, re.IGNORECASE)


def tidy(text: str) -> str:
    """Single blanks, at most one empty line."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\r", ""))).strip()


def section(text: str, name: str) -> str:
    """The section of a tidy text: of its beginnings the one whose window says most (the later of equal ones), up to the first end."""
    begins, stops, speaks = SECTIONS[name]
    starts = [m.start() for p in begins for m in _pattern(p).finditer(text)]
    if not starts:
        return ""
    best = max(starts, key=lambda s: (sum(1 for _ in _pattern(speaks).finditer(text[s : s + WINDOW])), s))
    ends = [m.start() for p in stops if (m := _pattern(p).search(text, best + 1))]
    return text[best : min(ends, default=best + WINDOW)].strip()


def kind_of(text: str) -> str | None:
    """What a text is about, by the first word of its head that says so."""
    found = [(m.start(), k, cat) for k, (cat, p) in enumerate(KINDS) if (m := _pattern(p).search(text[:HEAD]))]
    return min(found)[2] if found else None


def clean_model(x: str, star: bool = False) -> str:
    return re.sub(r"[^A-Z0-9*]+" if star else r"[^A-Z0-9]+", "", re.sub(r"/(SA|AU)$", "", x.strip().upper()))


def names_model(token: str, sku: str) -> bool:
    """A token of a sheet is the model: equal, with stars for any letters, or its first six or more characters."""
    pattern, target = clean_model(token, True), clean_model(sku)
    if not pattern or not target:
        return False
    if "*" in pattern:
        return re.fullmatch(re.sub(r"\*+", "[A-Z0-9]*", pattern), target) is not None
    return pattern == target or len(pattern) >= 6 and target.startswith(pattern)


def _numbers_of_row(text: str, sku: str, after: str, least: int) -> list[str] | None:
    if after:
        m = _pattern(after).search(text)
        if not m:
            return None
        text = text[m.start() : m.start() + 2500]
    for line in text.split("\n"):
        tokens = [t for t in _TOKEN.findall(line.upper()) if re.search("[A-Z]", t) and len(t) >= 5]
        if any(names_model(t, sku) or clean_model(re.sub(r"-?[LRX]$", "", t)) == clean_model(sku) for t in tokens):
            numbers = re.findall(r"\b\d+(?:\.\d+)?\b", line)
            if len(numbers) >= least:
                return numbers
    return None


def _groups(rule: Rule, text: str, sku: str) -> list | None:
    """The groups of a rule's match, from 1."""
    if rule.kind == "row":
        return _numbers_of_row(text, sku, rule.pattern, max(int(f.split("=")[1]) for f in rule.fields.split()))
    matches = list(_pattern(rule.pattern).finditer(text))
    if rule.kind == "model":
        matches = [m for m in matches if any(names_model(t, sku) for t in _TOKEN.findall(m[1].upper()) if re.match(r"[A-Z]{2,}\d", t))]
    if not matches:
        return None
    found = list(matches[-1 if rule.kind == "last" else 0].groups())
    return found if rule.kind != "column" or "910" in clean_model(sku) else found[1:]  # a table of two columns: the second, but for that series


def sheet_values(text: str, brand: str, cat: str, sku: str, rules: tuple[Rule, ...]) -> tuple[dict, str | None]:
    """Fields of a sheet in whole mm, and the first thing that is wrong with it."""
    about = kind_of(text)
    if about and cat and about != cat:
        return {}, f"the text is about {about}"
    own = [r for r in rules if r.brand == brand and r.cat == (cat or about)]
    if not own:
        return {}, "no rules"
    plain = tidy(text)
    parts = {"whole": plain, "flat": " ".join(plain.split())}
    for name in SECTIONS:
        parts[name] = section(plain, name)
    parts["both"] = f"{parts['installation']}\n{parts['specification']}"
    values: dict[str, int] = {}
    for slot in ("dimensions", "clearance"):
        for rank in sorted({r.rank for r in own if r.slot == slot}):
            got: dict[str, int | None] = {}
            for r in (r for r in own if (r.slot, r.rank) == (slot, rank)):
                groups = _groups(r, parts[r.section], sku)
                for f in r.fields.split():
                    name, _, place = f.partition("=")
                    place, _, otherwise = place.partition("|")
                    raw = place[1:] if place.startswith(":") else (groups[int(place) - 1] if groups else None) or otherwise or None
                    if raw is not None or not name.endswith("?"):
                        got[name.rstrip("?")] = None if raw is None else int(float(raw) + 0.5)
            if got and None not in got.values():
                values |= got
                break
        else:
            return values, f"no {slot}"
    return values, None


def parse_sheets(sheets: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """From (id, brand, cat, sku, text): id, the fields (null where a sheet does not say), and problem, null for a sheet that is whole. Rules are a small table that every task has; a null text is empty."""
    kind = sheets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sheet_values(text or "", (brand or "").strip().lower(), cat, sku or "", rules) for brand, cat, sku, text in zip(*(b.column(c).to_pylist() for c in ("brand", "cat", "sku", "text")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([v.get(f) for v, _ in found], pa.int32()) for f in FIELDS), pa.array([p for _, p in found], pa.string())], names=["id", *FIELDS, "problem"])

    return sheets.select("id", "brand", "cat", "sku", "text").mapInArrow(run, f"id {kind}, " + ", ".join(f"{f} int" for f in FIELDS) + ", problem string")


def sheet_flags() -> dict[str, F.Column]:
    """requires_plumbing, ventilation_required and reversible_door of a sheet (cat, text)."""
    cat, t = F.col("cat"), F.coalesce("text", F.lit(""))
    plumbed = F.when(cat.isin("dishwasher", "washing_machine"), True).when(cat == "fridge", ~t.rlike(r"(?i)non[-\s]?plumbed") & t.rlike(r"(?i)plumbed|water\s+line|water\s+connection")).otherwise(t.rlike(r"(?i)drain\s+hose|water\s+tank") & t.rlike(r"(?i)direct\s+drain"))
    return {"requires_plumbing": plumbed, "ventilation_required": F.when(cat == "fridge", True).when(cat == "dryer", ~t.rlike(r"(?i)Heat\s+Pump")).otherwise(False), "reversible_door": F.when(t.rlike("(?i)Door reversal|reversible door"), True)}
