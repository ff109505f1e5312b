"""Cutting the lineage of a table that a loop goes on with."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """rows, written to the checkpoint folder that driver and executors share. A local session without one gets a folder of its own; a cluster has to name one (spark.checkpoint.dir)."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()
