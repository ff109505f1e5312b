"""Helpers shared by the operators: table reading, intermediate tables in the cluster's shared folder, joins on skewed keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts average a few kB, so a batch stays at a few MB beside Spark's own byte limit.
ARROW_ROWS = 2000
#: A key with more than this share of all rows is split in a join; so fewer than 1 / share keys are.
HOT_SHARE = 1 / 1000

_own_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader (the folder may be in any store)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    Where the setting is absent a temporary folder of this process serves a local session; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_scratch.setdefault("base", tempfile.mkdtemp(prefix="spark-"))
    return f"{base}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """many joined with few, whose rows have distinct keys; a key that many rows share is dealt over many tasks.

    Keys with more than HOT_SHARE of the rows of `many` are counted first (`many` should be a stored table, or `counted`, a
    stored table of keys and their rows n, given); they are fewer than 1 / HOT_SHARE, so they may be sent to all tasks. Their rows take a part by the hash of column `by`, and the row of `few` is repeated for each part.
    No row is lost and none is repeated in the result.
    """
    part, parts = (fresh(c, [*many.columns, *few.columns]) for c in ("join_part", "join_parts"))
    per = HOT_SHARE * (many.count() if counted is None else counted.agg(F.sum("n")).first()[0] or 0)
    sizes = many.groupBy(*on).agg(F.count("*").alias(parts)) if counted is None else counted.select(*on, F.col("n").alias(parts))
    hot = sizes.where(F.col(parts) > per).withColumn(parts, F.ceil(F.col(parts) / F.lit(max(per, 1.0))).cast("int"))
    hot = F.broadcast(hot)  # fewer than 1 / HOT_SHARE rows
    left = many.join(hot, on, "left").withColumn(part, F.when(F.col(parts).isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col(parts))).cast("int")).drop(parts)
    right = few.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return left.join(right, [*on, part], how).drop(part)


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of the input has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
