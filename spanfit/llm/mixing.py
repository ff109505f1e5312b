"""Mixing sources to target weights by systematic sampling.

Each source gets a target in words; a document's expected copies are r = target / source size. Within a source the
documents stand in order of (size, id), expected copies are prefix-summed, one offset u (fixed by the source's name and
a seed, so reruns agree) is added, and a document is emitted once for each integer boundary its stretch crosses. In order
of size, what a source takes differs from its target by little more than its longest document.

The prefix sums are distributed: documents are dealt by range over (source, size, id), so a source that holds a third of
all rows spreads over many tasks; each range adds up its own, and the ranges' sums (one row per range and source) give
the offsets. Only word counts, ids and sources take part; whole rows are joined with their number of copies afterwards.

Defined results: null text has size 0; a null source is a source of its own, last in order; rows that agree in id,
source and size share their copies, spread evenly; empty input gives empty output; a source of size 0 has target 0 and
no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfit.llm.common import fresh, stored

SPACE = r"[\x20\x09-\x0D]"
CAP = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters."""
    text = F.coalesce(text, F.lit(""))
    edges = (text.rlike(f"^{SPACE}") | (text == "")).cast("int") + text.rlike(f"{SPACE}\\z").cast("int")
    return (F.size(F.split(text, f"{SPACE}+")) - edges).cast("long")


def _in_order(rows: DataFrame, keys: list[str], sums: dict[str, str], what: str) -> DataFrame:
    """rows with the running sum (up to and with the row, in order of keys) of each column named in sums: new name by column.

    Rows are dealt by range; each range adds up its own, and the ranges' totals, a row for each, give what stands before.
    """
    ranges = stored(rows.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), what)
    totals = ranges.groupBy("range").agg(*(F.sum(c).alias(c) for c in sums))
    before = totals.select("range", *((F.sum(c).over(Window.orderBy("range")) - F.col(c)).alias(f"before_{c}") for c in sums))  # a row per range
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranges.join(F.broadcast(before), "range")
    return joined.select(*rows.columns, *((F.col(f"before_{c}") + F.sum(c).over(within)).alias(name) for c, name in sums.items()))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (key, size) rows: key, source_size, target.

    Weights repeat over the sources in order of key. Targets share the sum of all sizes by weight; a target stops at cap
    times its source's size and the excess is shared by weight among the others, again until none is above. In order of size
    by weight the capped sources come first, so the share of the others is that of the first source that stays below its cap,
    found by running sums. Sources stay a table, whatever their number; the driver sees one share.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    per = _in_order(per, ["key"], {"one": "at"}, "sources").drop("one")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("at") - 1) % len(weights) + 1).cast("int")).cast("long")).drop("at")
    per = stored(per.withColumn("ratio", F.col("source_size") / F.col("weight")), "sources")
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return per.select("key", "source_size", F.lit(0.0).alias("target"))
    level = _in_order(per, ["ratio", "key"], {"source_size": "held", "weight": "passed"}, "levels")
    held, left = F.col("held") - F.col("source_size"), F.lit(weight) - F.col("passed") + F.col("weight")
    level = level.withColumn("share", (F.lit(total) - F.lit(cap) * held).cast("double") / left.cast("double")).where(F.lit(cap) * F.col("source_size") >= F.col("share") * F.col("weight"))
    first = level.orderBy("ratio", "key").select("share").first()
    share = float("inf") if first is None else first[0]
    return per.select("key", "source_size", F.least((F.lit(cap) * F.col("source_size")).cast("double"), F.lit(share) * F.col("weight")).alias("target"))


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What a row's place depends on: its source (a string that sorts by code point, null last), size and id."""
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    return {"mix_key": key, "size": n_words(F.col(text_col)), "mix_id": F.coalesce(F.col(id_col).cast("string"), F.lit(""))}


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """One row per (mix_key, size, mix_id): id, n (rows), source_size, target and total (copies of its rows together)."""
    k = _keys(id_col, text_col, source_col)
    groups = docs.select(F.col(id_col).alias("id"), *(c.alias(name) for name, c in k.items())).groupBy(*k).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    groups = stored(groups.repartitionByRange("mix_key", "size", "id", "mix_id").withColumn("range", F.spark_partition_id()), "mix")
    targets = source_targets(groups.select(F.col("mix_key").alias("key"), (F.col("size") * F.col("n")).alias("size")), weights, cap).withColumnRenamed("key", "mix_key")
    before = groups.groupBy("mix_key", "range").agg(F.sum("n").alias("n"))
    before = before.select("mix_key", "range", (F.sum("n").over(Window.partitionBy("mix_key").orderBy("range")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("mix_key", "range").orderBy("size", "id", "mix_id").rowsBetween(Window.unboundedPreceding, 0))
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col("mix_key")), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = groups.withColumn("within", within).join(before, ["mix_key", "range"]).join(targets.withColumns({"rate": rate, "offset": offset}), "mix_key")
    upto = F.col("before") + F.col("within")
    crossed = F.floor(upto * F.col("rate") + F.col("offset")) - F.floor((upto - F.col("n")) * F.col("rate") + F.col("offset"))
    return placed.select(*k, "id", "n", "source_size", "target", crossed.cast("long").alias("total"))


def _share(at: Column, n: Column, total: Column) -> Column:
    """Copies of the row at that place (from 1) among n rows that share total."""
    return (F.floor(total / n) + (at <= total % n).cast("long")).cast("long")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies."""
    placed = _placed(docs, id_col, text_col, source_col, weights, cap, seed)
    rows = placed.withColumn("at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("copies", _share(F.col("at"), F.col("n"), F.col("total")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row as often as it has copies, with the columns of docs."""
    k = _keys(id_col, text_col, source_col)
    names = {c: fresh(f"mixing_{c}", docs.columns) for c in (*k, "n", "total", "at", "copies")}
    places = _placed(docs, id_col, text_col, source_col, weights, cap, seed).select(*k, "n", "total").where("total > 0")
    rows = docs.withColumns({names[c]: e for c, e in k.items()}).join(places.withColumnsRenamed(names), [names[c] for c in k])
    n, total = F.col(names["n"]), F.col(names["total"])
    at = F.row_number().over(Window.partitionBy(*(names[c] for c in k)).orderBy(F.xxhash64(text_col)))
    rows = rows.withColumn(names["copies"], _share(at, n, total))
    return rows.withColumn(names["at"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"])))).where(F.col(names["copies"]) > 0).select(*docs.columns)
