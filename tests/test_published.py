"""Published versions, checked writes, and the streaming roll-up that touches only its days."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spanfit.operators.telemetry import count_percentiles, rum_percentiles, value_counts
from spanfit.sources import files, versions
from spanfit.streaming import telemetry as streams

RUM = "metric string, path string, value double, ts timestamp, event_id long"


def always(new, old):
    return True


def ids(tables, name):
    return sorted(r.id for r in tables[name].collect())


def test_versions_change_together_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/catalog"
    assert versions.versions(spark, root) == []
    with pytest.raises(LookupError):
        versions.read_version(spark, root)
    assert versions.publish(spark, root, {"products": spark.range(3), "rules": spark.range(1)}, always) == 1
    seen = []
    assert versions.publish(spark, root, {"products": spark.range(5)}, lambda new, old: seen.append((set(new), set(old))) or old["products"].count() == 3) == 2
    assert seen == [({"products"}, {"products", "rules"})]
    now = versions.read_version(spark, root)
    assert ids(now, "products") == list(range(5)) and ids(now, "rules") == [0]  # what is not given stays
    with pytest.raises(ValueError, match="last version stays"):
        versions.publish(spark, root, {"products": spark.range(99)}, lambda new, old: new["products"].count() < 2 * old["products"].count())
    assert versions.versions(spark, root) == [1, 2] and ids(versions.read_version(spark, root), "products") == list(range(5))
    assert versions.roll_back(spark, root, 1) == 3
    assert ids(versions.read_version(spark, root), "products") == [0, 1, 2] and ids(versions.read_version(spark, root, 2), "products") == list(range(5))
    assert versions.vacuum(spark, root, keep=1) == 2  # version 2's products and the refused ones
    assert versions.versions(spark, root) == [3] and ids(versions.read_version(spark, root), "rules") == [0]


def test_a_run_that_fails_half_way_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/catalog"
    versions.publish(spark, root, {"products": spark.range(3)}, always)
    broken = spark.range(10).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("half way")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="half way"):
        versions.publish(spark, root, {"rules": spark.range(2), "products": broken}, always)
    assert set(versions.read_version(spark, root)) == {"products"} and ids(versions.read_version(spark, root), "products") == [0, 1, 2]
    monkeypatch.setattr(versions, "write_document", lambda *a, **k: (_ for _ in ()).throw(OSError("lost before the manifest")))
    with pytest.raises(OSError, match="lost"):
        versions.publish(spark, root, {"products": spark.range(7)}, always)
    monkeypatch.undo()
    assert ids(versions.read_version(spark, root), "products") == [0, 1, 2]
    assert versions.publish(spark, root, {"products": spark.range(4)}, always) == 2


def test_two_runs_cannot_publish_the_same_number(spark, tmp_path):
    root = f"file://{tmp_path}/catalog"
    versions.publish(spark, root, {"products": spark.range(3)}, always)

    def slow(new, old):
        versions.publish(spark, root, {"products": spark.range(8)}, always)
        return True

    with pytest.raises(Exception, match="(?i)exist"):
        versions.publish(spark, root, {"products": spark.range(1)}, slow)
    assert ids(versions.read_version(spark, root), "products") == list(range(8)) and not [f for f in os.listdir(f"{tmp_path}/catalog/manifests") if "tmp" in f and not f.startswith(".")]


def test_documents_are_replaced_as_one(spark, tmp_path):
    path = f"file://{tmp_path}/d/report.json"
    os.makedirs(f"{tmp_path}/d")
    versions.write_document(spark, path, {"n": 1})
    versions.write_document(spark, path, {"n": [2, "é"]})
    assert versions.read_document(spark, path) == {"n": [2, "é"]}
    with pytest.raises(Exception, match="(?i)exist"):
        versions.write_document(spark, path, {}, replace=False)
    assert versions.read_document(spark, path) == {"n": [2, "é"]}
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    files.write_report(rows, f"file://{tmp_path}/d", "20260101")
    files.write_report(rows.withColumn("k", F.lit(2)), f"file://{tmp_path}/d", "20260102")
    assert [r.k for r in files.latest_report(spark, f"file://{tmp_path}/d", "k int, v string").collect()] == [2]


def test_a_checked_write_recovers_between_its_renames(spark, tmp_path):
    path, staging = f"file://{tmp_path}/t", f"file://{tmp_path}/s"
    files.write_checked(spark.range(3), path, staging, lambda d: True)
    os.rename(f"{tmp_path}/t", f"{tmp_path}/t.old")  # as if the run before had ended there
    with pytest.raises(ValueError, match="stays"):
        files.write_checked(spark.range(9), path, staging, lambda d: False)
    assert spark.read.parquet(path).count() == 3
    files.write_checked(spark.range(9), path, staging, lambda d: True)
    assert spark.read.parquet(path).count() == 9 and not os.path.exists(f"{tmp_path}/t.old")


def events(spark, seed, n, days):
    r = random.Random(seed)
    rows = [(r.choice(["LCP", "CLS", "INP", "TTFB", None]), r.choice(["/a", "/b?x=1", "/c#d"]), r.choice([None, 0.0, -1.5, 0.1, 5e-300, 1e300, round(r.uniform(0, 50), 1), round(r.gauss(2000, 500), 2)]), r.choice(days) + f" {r.randrange(24):02d}:00:00", seed * 1000 + k) for k in range(n)]
    return spark.createDataFrame(rows, "metric string, path string, value double, t string, event_id long").select("metric", "path", "value", F.to_timestamp("t").alias("ts"), "event_id")


def as_rows(df):
    return sorted((tuple(r[c] for c in ("path", "metric", "n", "p50", "p75", "p95")) for r in df.collect()), key=str)


def test_percentiles_of_counts_are_those_of_events(spark):
    e = events(spark, 1, 900, ["2026-01-01", "2026-01-02"])
    want = as_rows(rum_percentiles(e.where("value is not null")))
    assert as_rows(count_percentiles(value_counts(e))) == want and len(want) == 9
    parts = value_counts(e.where("event_id % 3 = 0")).unionByName(value_counts(e.where("event_id % 3 <> 0")))
    assert as_rows(count_percentiles(parts)) == want
    assert count_percentiles(value_counts(e.limit(0))).collect() == []


def test_roll_up_touches_its_days_and_equals_the_batch(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    parts = [events(spark, 2, 300, ["2026-01-01", "2026-01-02"]), events(spark, 3, 200, ["2026-01-03"]), events(spark, 4, 100, ["2026-01-01"])]

    def run():
        streams.roll_up(streams.read_stream(spark, source, RUM), out, checkpoint).awaitTermination()

    def stamp():
        return {day: sorted(os.listdir(f"{out}/daily/{day}")) for day in os.listdir(f"{out}/daily") if day.startswith("day=")}

    parts[0].write.mode("append").parquet(source)
    run()
    first = stamp()
    parts[1].write.mode("append").parquet(source)
    run()
    second = stamp()
    assert set(first) == {"day=2026-01-01", "day=2026-01-02"} and all(second[d] == first[d] for d in first)  # earlier days' files are the same
    parts[2].write.mode("append").parquet(source)
    run()
    third = stamp()
    assert third["day=2026-01-01"] != second["day=2026-01-01"] and all(third[d] == second[d] for d in ("day=2026-01-02", "day=2026-01-03"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null")
    assert as_rows(streams.rolled_up(spark, out)) == as_rows(rum_percentiles(every))
    assert as_rows(streams.rolled_up(spark, out, first="2026-01-02")) == as_rows(rum_percentiles(every.where("to_date(ts) >= '2026-01-02'")))
    daily = spark.read.parquet(f"{out}/daily")
    for day in ("2026-01-01", "2026-01-03"):
        assert as_rows(daily.where(F.col("day") == day)) == as_rows(rum_percentiles(every.where(F.to_date("ts") == day)))
