"""File sources and sinks of the catalog: JSON documents, CSV, NDJSON, HTML corpora, category split with manifest, evidence vault."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanfit.sources.versions import read_document, write_document

OFFER = "struct<n:string,url:string,p:int,verified_at:string>"
PRODUCT = f"id string, cat string, brand string, model string, displayName string, w int, h int, d int, stars int, price int, kwh_year int, door_swing_mm int, unavailable boolean, sponsored boolean, features array<string>, retailers array<{OFFER}>, priorityScore int"
RUM = "metric string, path string, value double, ts long, ua string"
ERROR = "message string, source string, line int, col int, stack string, ts long"


def read_catalog(spark: SparkSession, path: str, cat: str | None = None) -> DataFrame:
    """Products of the JSON documents under path, in order of file name and place (ord); cat fills a missing category."""
    docs = spark.read.schema(f"schema_version int, last_updated string, products array<struct<{', '.join(':'.join(x.strip().split(' ', 1)) for x in PRODUCT.split(', '))}>>").json(path, multiLine=True)
    rows = docs.select(F.input_file_name().alias("file"), F.posexplode("products").alias("pos", "product")).select("file", "pos", "product.*")
    return rows.withColumns({"cat": F.coalesce("cat", F.lit(cat)), "ord": F.struct("file", "pos")}).drop("file", "pos")


def first_by_slug(rows: DataFrame) -> DataFrame:
    """The first row of each id over all files."""
    kept = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(*(F.min_by(F.struct(c), "ord").alias(c) for c in kept)).select("id", *(F.col(f"{c}.{c}").alias(c) for c in kept))


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Header-named text columns, trimmed; absent values are empty text."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
    return rows.na.fill("")


def alias(rows: DataFrame, *names: str) -> F.Column:
    """The first of these columns that exists and is not empty."""
    there = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; lines that are none are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_rum(spark: SparkSession, path: str) -> DataFrame:
    return read_ndjson(spark, path, RUM).where("metric is not null and value is not null").withColumn("metric", F.upper("metric"))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return read_ndjson(spark, path, ERROR).where("message is not null and source is not null")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of the HTML files below path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html").select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def unwrap_feed(rows: DataFrame, *names: str) -> DataFrame:
    """Items of a payload that holds them under one of several names."""
    there = [n for n in names if n in rows.columns and isinstance(rows.schema[n].dataType, T.ArrayType)]
    return rows.select(F.explode(F.coalesce(*there)).alias("item")).select("item.*")


def write_by_category(rows: DataFrame, path: str, categories: tuple[str, ...]) -> DataFrame:
    """Writes known categories as partitions and returns the manifest: cat, n (zero included).

    The files are sorted by width within a category, so a scan for a cavity skips row groups.
    """
    known = rows.where(F.col("cat").isin(*categories))
    known.repartitionByRange("cat", "w").sortWithinPartitions("cat", "w").write.mode("overwrite").partitionBy("cat").parquet(path)
    counts = known.groupBy("cat").agg(F.count("*").alias("n"))
    spine = rows.sparkSession.createDataFrame([(c,) for c in categories], "cat string")
    return spine.join(counts, "cat", "left").select("cat", F.coalesce("n", F.lit(0)).alias("n"))


def write_report(rows: DataFrame, path: str, day: str) -> None:
    """The rows under the day; a small file, replaced as one, names the latest report."""
    rows.write.mode("overwrite").json(f"{path}/{day}")
    write_document(rows.sparkSession, f"{path}/latest.json", {"day": day})


def latest_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The report that was written last."""
    return spark.read.schema(schema).json(f"{path}/{read_document(spark, f'{path}/latest.json')['day']}")


def write_checked(rows: DataFrame, path: str, staging: str, good: Callable[[DataFrame], bool]) -> None:
    """Writes to a staging folder first; what was written and is good takes the place of the table at path by renames, else that stays as it was and an error is raised.

    Nothing is written twice. A run that ends between the two renames leaves the old table at `path`.old, which the next
    run puts back; where readers must never miss a table, publish versions (`sources.versions`).
    """
    spark = rows.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    here, staged, old = (files.Path(x) for x in (path, staging, f"{path}.old"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(here):
        fs.rename(old, here)
    rows.write.mode("overwrite").parquet(staging)
    if not good(spark.read.schema(rows.schema).parquet(staging)):
        raise ValueError(f"rows in {staging} fail the check; {path} stays as it was")
    fs.delete(old, True)
    if fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"{path} cannot be set aside")
    if not fs.rename(staged, here):
        fs.rename(old, here)
        raise OSError(f"{staging} cannot take the place of {path}")
    fs.delete(old, True)


def upsert_vault(vault: DataFrame, items: DataFrame) -> DataFrame:
    """Evidence by (product_id, kind, source_url): the new item replaces an equal one, others stay."""
    key = ["product_id", "kind", "source_url"]
    return vault.join(items.select(*key), key, "left_anti").unionByName(items, allowMissingColumns=True)


def grouped_report(rows: DataFrame) -> DataFrame:
    """cat and a map from brand to its sorted models."""
    per = rows.groupBy("cat", "brand").agg(F.array_sort(F.collect_list("model")).alias("models"))
    return per.groupBy("cat").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("brand", "models")))).alias("brands"))


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A table of at most `most` rows of a report."""
    lines = [[str(c) for c in rows.columns], ["---"] * len(rows.columns), *([str(v) for v in r] for r in rows.limit(most).collect())]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
