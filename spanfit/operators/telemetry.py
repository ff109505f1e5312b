"""Telemetry: sanitising, roll-ups, limiters and plans over event tables (batch; streaming forms stand in `streaming`)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanfit.functions.columns import bare_path, basename, js_round, origin_path, redact
from spanfit.operators.facets import ranked

#: Metrics that intake accepts and that roll-ups report, and the p75 limits of a good page.
ACCEPTED, REPORTED = ("LCP", "CLS", "INP", "TTFB"), ("LCP", "CLS", "INP")
GOOD_P75 = {"LCP": 2500.0, "CLS": 0.1, "INP": 200.0}


def sanitised_rum(events: DataFrame) -> DataFrame:
    """Events of an accepted metric with a value in 0..60000 and a path; CLS to 4 places, others whole."""
    metric = F.upper(F.trim("metric"))
    path = F.regexp_replace("path", "[?#].*$", "")
    ok = metric.isin(*ACCEPTED) & F.col("value").between(0, 60000) & path.startswith("/")
    value = F.when(metric == "CLS", js_round(F.col("value") * 10000) / 10000).otherwise(js_round(F.col("value")).cast("double"))
    return events.where(ok).withColumns({"metric": metric, "path": path, "value": value})


def sanitised_errors(events: DataFrame, site: str = "https://www.example.org") -> DataFrame:
    """Messages redacted and cut to 500, sources as origin and path cut to 300, whole lines and columns (negative ones: row dropped), five stack frames."""
    message = F.substring(redact(F.coalesce(F.nullif("message", F.lit("")), F.lit("Error"))), 1, 500)
    source = F.substring(origin_path(F.coalesce(F.nullif("source", F.lit("")), F.lit("/")), site), 1, 300)
    line, col = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("line", "col"))
    frames = F.transform(F.split(F.coalesce("stack", F.lit("")), "\n"), lambda x: redact(origin_path(x, site)))
    stack = F.array_join(F.slice(F.filter(frames, lambda x: x != ""), 1, 5), "\n")
    return events.where((line >= 0) & (col >= 0)).withColumns({"message": message, "source": source, "line": F.floor(line).cast("int"), "col": F.floor(col).cast("int"), "stack": stack})


def signature(message: Column, source: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws("|", message, basename(source), line.cast("string")), 256)


def rum_percentiles(events: DataFrame, points: tuple[int, ...] = (50, 75, 95)) -> DataFrame:
    """path, metric, n and nearest-rank percentiles of reported metrics."""
    rows = events.where(F.col("metric").isin(*REPORTED)).withColumn("path", bare_path(F.col("path")))
    return rows.groupBy("path", "metric").agg(F.count("*").alias("n"), *(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY value)").alias(f"p{p}") for p in points))


def value_counts(events: DataFrame) -> DataFrame:
    """(day, path, metric, value, n) of reported metrics: counts that add up over any parts of a log."""
    rows = events.where(F.col("metric").isin(*REPORTED) & F.col("value").isNotNull()).withColumn("path", bare_path(F.col("path")))
    return rows.groupBy(F.to_date("ts").alias("day"), "path", "metric", "value").agg(F.count("*").alias("n"))


def count_percentiles(counts: DataFrame, by: tuple[str, ...] = ("path", "metric"), points: tuple[int, ...] = (50, 75, 95)) -> DataFrame:
    """n and nearest-rank percentiles of values with counts (value, n), the same as of the events themselves.

    Values fall into buckets of a thousandth of an octave. Running sums over a key's buckets (a bounded number) say in which
    one each rank lies, and only the values of that bucket are looked at one by one.
    """
    size = F.floor(F.log2(F.abs("value")) * 1000)
    bucket = F.when(F.col("value") > 0, size + 2_000_000).when(F.col("value") < 0, -size - 2_000_000).otherwise(0)
    each = counts.groupBy(*by, "value").agg(F.sum("n").alias("n")).withColumn("bucket", bucket)
    sums = each.groupBy(*by, "bucket").agg(F.sum("n").alias("of"))
    ordered = Window.partitionBy(*by).orderBy("bucket")
    sums = sums.withColumns({"upto": F.sum("of").over(ordered), "n": F.sum("of").over(Window.partitionBy(*by))}).withColumn("before", F.col("upto") - F.col("of"))
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100)).cast("long").alias("rank")) for p in points))
    asked = sums.withColumn("asked", F.filter(ranks, lambda r: (r["rank"] > F.col("before")) & (r["rank"] <= F.col("upto")))).where(F.size("asked") > 0)
    inner = each.withColumnRenamed("n", "own").join(asked.select(*by, "bucket", "before", "n", "asked"), [*by, "bucket"])
    inner = inner.withColumn("last", F.col("before") + F.sum("own").over(Window.partitionBy(*by, "bucket").orderBy("value")))
    hit = inner.withColumn("r", F.explode("asked")).where((F.col("r.rank") <= F.col("last")) & (F.col("r.rank") > F.col("last") - F.col("own")))
    return hit.groupBy(*by).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("r.p") == p, F.col("value"))).alias(f"p{p}") for p in points))


def rum_status(events: DataFrame, least: int = 100) -> DataFrame:
    """One row: events that count, and whether they are enough."""
    return events.where(F.col("metric").isin(*REPORTED)).agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths")).withColumn("status", F.when(F.col("n") < least, "insufficient_samples").otherwise("ok"))


def error_signatures(events: DataFrame) -> DataFrame:
    """signature, n, first_seen, last_seen, sample (the first event's source)."""
    rows = events.withColumn("signature", signature(F.col("message"), F.col("source"), F.col("line")))
    return rows.groupBy("signature").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("source", "event_id").alias("sample"))


def daily_firsts(events: DataFrame) -> DataFrame:
    """The first of each client's equal errors of a day."""
    rows = events.withColumns({"signature": signature(F.col("message"), F.col("source"), F.col("line")), "day": F.to_date("ts")})
    return ranked(rows, [F.asc("ts"), F.asc("event_id")], ["user_id", "signature", "day"], 1, "nth").drop("nth")


def sampled(events: DataFrame, one_in: int = 10, key: str = "event_id") -> DataFrame:
    """A fixed share of events, by their key's CRC (a client's random choice made repeatable)."""
    return events.where(F.crc32(F.col(key).cast("string").cast("binary")) % one_in == 0)


def bad_vitals(percentiles: DataFrame) -> DataFrame:
    """Paths and metrics whose p75 is over the limit, with the excess as a ratio."""
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in GOOD_P75.items() for x in pair)), F.col("metric"))
    return percentiles.withColumn("limit", limit).where(F.col("p75") > F.col("limit"))


def fix_plan(bad: DataFrame, status: DataFrame, most: int = 5) -> DataFrame:
    """The worst: LCP before INP before CLS, then by p75; none where the status (one row of rum_status) says that events are too few."""
    bad = bad.crossJoin(F.broadcast(status.where("status = 'ok'").select("status"))).drop("status")  # one row or none
    order = F.element_at(F.create_map(F.lit("LCP"), F.lit(0), F.lit("INP"), F.lit(1), F.lit("CLS"), F.lit(2)), F.col("metric"))
    return ranked(bad.withColumn("severity", order), [F.asc("severity"), F.desc("p75"), F.asc("path")], most=most)


def capped_plan(candidates: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` are selected, the rest say why not."""
    first = candidates.orderBy("ord").limit(most).select("ord", F.lit(True).alias("selected"))
    return candidates.join(F.broadcast(first), "ord", "left").withColumns({"selected": F.coalesce("selected", F.lit(False)), "reason": F.when(F.col("selected"), None).otherwise("cap")})  # `most` rows


def window_limited(events: DataFrame, key: str, limit: int = 30, window_s: float = 60.0) -> DataFrame:
    """key, allowed, refused: a fold over each key's events in time order, in stretches of Arrow batches with the state carried on."""

    def run(batches):
        now, state, tally = None, (None, 0), [0, 0]
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf["t"], strict=True):
                if k != now:
                    if now is not None:
                        rows.append((now, *tally))
                    now, state, tally = k, (None, 0), [0, 0]
                start, n = state
                if start is None or t - start >= window_s:
                    start, n = t, 0
                ok = n < limit
                tally[not ok] += 1
                state = (start, n + ok)
            yield pd.DataFrame(rows, columns=[key, "allowed", "refused"])
        if now is not None:
            yield pd.DataFrame([(now, *tally)], columns=[key, "allowed", "refused"])

    return _folded(events, key).mapInPandas(run, f"{key} long, allowed long, refused long")


def bucket_limited(events: DataFrame, key: str, capacity: float = 60.0, per_s: float = 1.0) -> DataFrame:
    """key, allowed, refused under a token bucket that refills continuously. Keys don't evict each other here."""

    def run(batches):
        now, tokens, last, tally = None, capacity, None, [0, 0]
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf["t"], strict=True):
                if k != now:
                    if now is not None:
                        rows.append((now, *tally))
                    now, tokens, last, tally = k, capacity, t, [0, 0]
                tokens, last = min(capacity, tokens + max(0.0, t - last) * per_s), t
                ok = tokens >= 1
                tokens -= ok
                tally[not ok] += 1
            yield pd.DataFrame(rows, columns=[key, "allowed", "refused"])
        if now is not None:
            yield pd.DataFrame([(now, *tally)], columns=[key, "allowed", "refused"])

    return _folded(events, key).mapInPandas(run, f"{key} long, allowed long, refused long")


def _folded(events: DataFrame, key: str) -> DataFrame:
    rows = events.select(key, "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.repartition(key).sortWithinPartitions(key, "t", "event_id").select(key, "t")
