"""Reading records that may be broken: good ones go on, bad ones are kept in a table of their own (S-02, S-03, S-10, S-11)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = """product_id string, category string, brand string, model string, source_url string, verified_at string, extracted struct<sku:string,model:string,category:string,
    dimensions:struct<height_mm:double,width_mm:double,depth_mm:double,door_open_90_depth_mm:double>, clearance_requirements:struct<top_mm:double,left_mm:double,right_mm:double,rear_mm:double>,
    flags:struct<requires_plumbing:boolean,ventilation_required:boolean,reversible_door:boolean>, metadata:struct<source_pdf_url:string,extraction_date:string,confidence_score:double>>"""
CONSOLE = "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"


class Read(NamedTuple):
    """Records with the file that they come from, and quarantined texts with file and reason."""

    rows: DataFrame
    quarantine: DataFrame


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False, recursive: bool = False) -> Read:
    """JSON documents, one a file (or a line): rows have `file` (its name) and the schema's fields. What is no JSON, and what is no object of that schema, is quarantined. Empty lines say nothing."""
    text = spark.read.text(path, wholetext=not lines, recursiveFileLookup=recursive).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    parsed = text.where(F.trim("value") != "").withColumn("record", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("record").isNull() | F.col("record._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    # Spark may work out what comes later before it filters: a broken record's file is null, so `required` says nothing of it.
    return Read(parsed.where(~bad).select(F.when(~bad, F.col("file")).alias("file"), "record.*").drop("_bad"), parsed.where(bad).select("file", F.col("value").alias("text"), F.lit("no such record").alias("reason")))


def required(rows: DataFrame, field: str) -> DataFrame:
    """rows, of which each must have the field: one without it is an error that names its file."""
    missing = F.col(field).isNull() & F.col("file").isNotNull()
    return rows.withColumn(field, F.when(missing, F.raise_error(F.concat(F.col("file"), F.lit(f" has no {field}")))).otherwise(F.col(field)))


def items(rows: DataFrame, field: str, categories: dict[str, str] | None = None) -> DataFrame:
    """The elements of a list that every document must have, in order of file name and place (`ord`). categories: by file name, for elements without `cat` of their own."""
    each = required(rows, field).select("file", F.posexplode(field).alias("pos", "item")).select(F.struct("file", "pos").alias("ord"), "file", "item.*")
    if categories:
        by_file = F.create_map(*(F.lit(x) for pair in categories.items() for x in pair))
        each = each.withColumn("cat", F.coalesce(F.nullif(F.trim("cat"), F.lit("")), F.try_element_at(by_file, F.col("file"))))
    return each.drop("file")


def split(read: Read, good: Column, reason: str) -> Read:
    """The rows that are good; the others go to the quarantine as JSON."""
    ok = F.coalesce(good, F.lit(False))
    more = read.rows.where(~ok).select("file", F.to_json(F.struct(*(c for c in read.rows.columns if c != "file"))).alias("text"), F.lit(reason).alias("reason"))
    return Read(read.rows.where(ok), read.quarantine.unionByName(more))


def read_evidence(spark: SparkSession, path: str) -> Read:
    """Raw evidence files (*.json): evidence_id is the file's name, so files are in its order; files without dimensions, clearance and flags are quarantined."""
    read = split(read_json(spark, f"{path}/*.json", EVIDENCE), F.col("extracted.dimensions").isNotNull() & F.col("extracted.clearance_requirements").isNotNull() & F.col("extracted.flags").isNotNull(), "incomplete")
    rows = read.rows.select(F.col("file").alias("evidence_id"), "product_id", "brand", "model", F.col("extracted.sku").alias("sku"), F.col("extracted.model").alias("extracted_model"), "source_url", "verified_at", *(F.round(f"extracted.dimensions.{f}_mm").cast("int").alias(f[0]) for f in ("width", "height", "depth")), "extracted")
    return Read(rows, read.quarantine)


def read_console(spark: SparkSession, path: str) -> Read:
    """Search-console answers (*.json): query, page, clicks, impressions, ctr, position of their rows; a document without rows has none, a row without a query is quarantined."""
    read = read_json(spark, f"{path}/*.json", CONSOLE)
    each = read.rows.select("file", F.explode("rows").alias("r"))
    rows = each.select("file", F.get("r.keys", F.lit(0)).alias("query"), F.get("r.keys", F.lit(1)).alias("page"), *(F.coalesce(f"r.{c}", F.lit(0.0)).alias(c) for c in ("clicks", "impressions", "ctr", "position")))
    return split(Read(rows, read.quarantine), F.trim("query") != "", "no query")
