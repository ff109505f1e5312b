"""Rows from outside: energy ratings under any generation of headers (P-29), retailers' legal decisions (P-63)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanfit.functions.columns import js_round, number_in

#: Headers of each field, the newest first, and how its text is read.
ENERGY_HEADERS = {
    "brand": ("text", ("Brand", "Brand Name", "brand")),
    "model": ("text", ("Model Name", "Model No", "Model", "model")),
    "w": ("integer", ("Width", "width", "Width (mm)")),
    "h": ("integer", ("Height", "height", "Height (mm)")),
    "d": ("integer", ("Depth", "depth", "Depth (mm)")),
    "kwh_year": ("integer", ("Labelled energy consumption (kWh/year)", "Annual Energy Consumption", "Annual Energy Consumption (kWh/year)", "kwh_year")),
    "stars": ("stars", ("New Star", "Star2009", "Star Rating", "stars", "StarRating", "Star Rating (old)")),
    "door_swing_mm": ("number", ("door_swing_mm", "Door Swing", "Door Swing (mm)")),
}
DECISIONS = ("RED", "GREEN", "YELLOW")


def as_maps(files: list[DataFrame], *keep: str) -> DataFrame:
    """Tables of text columns with headers of their own as one: the columns to keep, and `row`, a map from header to value."""
    rows = [f.select(*keep, F.map_from_arrays(F.array(*(F.lit(c) for c in f.columns if c not in keep)), F.array(*(F.col(f"`{c}`").cast("string") for c in f.columns if c not in keep))).alias("row")) for f in files]
    return reduce(DataFrame.unionByName, rows)


def energy_rows(rows: DataFrame, headers: dict[str, tuple[str, tuple[str, ...]]] = ENERGY_HEADERS) -> DataFrame:
    """rows with the fields of their `row` map. A field's value is the first header's that is there and not empty (of stars the first that is a number), so a new generation of headers is an entry of the table, no code.

    integer: rounded; stars: rounded, null outside 1 to 6; a text without digits is null.
    """
    found = {}
    for field, (kind, names) in headers.items():
        given = [F.nullif(F.try_element_at("row", F.lit(n)), F.lit("")) for n in names]
        if kind == "stars":
            value = js_round(F.coalesce(*map(number_in, given)))
            found[field] = F.when(value.between(1, 6), value).cast("int")
        else:
            first = F.coalesce(*given)
            found[field] = first if kind == "text" else js_round(number_in(first)).cast("int") if kind == "integer" else number_in(first)
    return rows.withColumns(found)


def _plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))


def legal_decisions(audits: DataFrame) -> DataFrame:
    """(audit, retailer, decision) of the tables in Markdown audits (audit, text): a row's first cell names the retailer, of the decisions in its others RED counts before GREEN before YELLOW; the first row of a retailer counts."""
    lines = audits.select("audit", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "line")).where(F.trim("line").startswith("|"))
    cells = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rows = lines.withColumn("cells", cells).where(F.size("cells") >= 4).withColumns({"retailer": _plain(F.get("cells", F.lit(0))), "said": F.array_join(F.slice("cells", 2, 1_000_000), " ")})
    decision = F.lit("UNKNOWN")
    for d in reversed(DECISIONS):
        decision = F.when(F.col("said").rlike(rf"(?i)\b{d}\b"), d).otherwise(decision)
    return rows.where("retailer <> ''").groupBy("audit", "retailer").agg(F.min_by(decision, "at").alias("decision"))


def decided(offers: DataFrame, decisions: DataFrame, name: str = "n") -> DataFrame:
    """offers with `decision` of their retailer (retailer, decision; UNKNOWN where none says) and `refused`: nothing may be fetched there."""
    rows = offers.withColumn("_key", _plain(F.col(name))).join(decisions.select(F.col("retailer").alias("_key"), "decision"), "_key", "left").drop("_key")
    return rows.withColumn("decision", F.coalesce("decision", F.lit("UNKNOWN"))).withColumn("refused", F.col("decision") == "RED")
