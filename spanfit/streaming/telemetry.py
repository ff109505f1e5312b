"""Structured Streaming forms: cleaning, deduplication, signatures, limiters and exact roll-ups.

Event time is the event's own; a watermark bounds state. On streams without late data results equal the batch operators'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanfit.operators.telemetry import count_percentiles, signature, value_counts

COUNTS = "path string, metric string, value double, n long, day date, batch long"


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_at_once).load(path)


def daily_firsts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One event per client, signature and day (the day is part of the key, so repeats on other days pass)."""
    rows = events.withColumns({"signature": signature(F.col("message"), F.col("source"), F.col("line")), "day": F.to_date("ts")})
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id", "signature", "day"])


def signature_counts(events: DataFrame) -> DataFrame:
    """Running count, first and last time of each signature (update or complete mode)."""
    rows = events.withColumn("signature", signature(F.col("message"), F.col("source"), F.col("line")))
    return rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def window_limited(events: DataFrame, key: str, limit: int, window_s: float) -> DataFrame:
    """Per micro-batch and key: allowed, refused. A window opens with a key's first event; state is its start and count."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        times = sorted(t for pdf in batches for t in pdf["t"])  # one key's events of one micro-batch
        allowed = 0
        for t in times:
            if start is None or t - start >= window_s:
                start, n = t, 0
            if n < limit:
                n, allowed = n + 1, allowed + 1
        state.update((start, n))
        yield pd.DataFrame({key: [k[0]], "allowed": [allowed], "refused": [len(times) - allowed]})

    rows = events.select(key, (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} long, allowed long, refused long", "start double, n long", "append", GroupStateTimeout.NoTimeout)


def roll_up(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps exact percentiles by day while events come in: a micro-batch adds its counts of values, and only the days that it has events of are worked out anew.

    Counts lie under (day, batch), so a batch that is tried again replaces its own; late events touch their own day only.
    `path`/daily has day, path, metric, n and percentiles; `rolled_up` gives those of any days together.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        value_counts(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/counts")
        try:
            counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
        except AnalysisException as e:  # no event so far counts
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        days = [r.day for r in counts.where(F.col("batch") == number).select("day").distinct().collect()]
        if days:
            daily = count_percentiles(counts.where(F.col("day").isin(days)), ("day", "path", "metric"))
            daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/daily")

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolled_up(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """path, metric, n and exact percentiles of the days between (dates, both included) of a roll-up, from its counts."""
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts")
    for day, test in ((first, F.col("day") >= F.lit(first).cast("date")), (last, F.col("day") <= F.lit(last).cast("date"))):
        counts = counts.where(test) if day else counts
    return count_percentiles(counts)


def run_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, into Parquet (append) or, for update mode, one Parquet folder per micro-batch."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return
    write: Callable[[DataFrame, int], None] = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    writer.foreachBatch(write).start().awaitTermination()
