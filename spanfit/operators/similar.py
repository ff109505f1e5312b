"""Joins on likeness that never compare all pairs: candidates meet on equal keys (substrings, segments, shortened texts, prefixes) and are verified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(text: Column, n: Column) -> Column:
    """Distinct substrings of n characters."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda k: F.substring(text, k, n)))


def apart(rows: DataFrame) -> DataFrame:
    """rows for a join that deals both sides: Spark does not see that what is exploded or joined grows, and would send it whole through the driver."""
    return rows.hint("merge")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows in as many parts as a shuffle has: small rows that are about to grow would else be put together in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def contained(needles: DataFrame, hays: DataFrame, needle: str, hay: str, longest: int = 32) -> DataFrame:
    """needles joined with hays where text column `hay` holds `needle` (not empty).

    A needle of up to `longest` characters meets the hays that hold it; a longer one those that hold its rarest gram of so
    many. Of hays only substrings of lengths that needles have are dealt, as hashes: rows grow with the lengths of the texts
    and with what is found, however often a short gram occurs.
    """
    asked = needles.select(needle).where(F.col(needle) != "").distinct()
    whole = dealt(hays.select(hay).where(F.length(hay) > 0), hay).distinct()
    sizes = asked.agg(F.collect_set(F.least(F.length(needle), F.lit(longest))).alias("sizes"))  # one row of `longest` numbers at most
    sized = whole.crossJoin(F.broadcast(sizes)).select(hay, F.explode("sizes").alias("n")).where(F.length(hay) >= F.col("n"))
    grams = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.length(hay) - F.col("n") + 1))).select(F.xxhash64(hay).alias("_hay"), F.xxhash64(F.substring(hay, F.col("at"), F.col("n"))).alias("gram"))
    long = asked.where(F.length(needle) > longest).select(needle, F.explode(runs(F.col(needle), F.lit(longest))).alias("g"))
    spread = whole.where(F.length(hay) > longest).select(F.explode(runs(F.col(hay), F.lit(longest))).alias("g")).groupBy("g").agg(F.count("*").alias("hays"))
    rarest = apart(long).join(apart(spread), "g", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("hays", F.lit(0)).alias("hays"), "g")).alias("x")).where("x.hays > 0").select(needle, F.xxhash64("x.g").alias("gram"))
    keys = asked.where(F.length(needle) <= longest).select(needle, F.xxhash64(needle).alias("gram")).unionByName(rarest)
    pairs = grams.join(keys.hint("shuffle_hash"), "gram").select(needle, "_hay").distinct()
    met = apart(needles).join(apart(pairs), needle)
    return apart(met).join(apart(hays.withColumn("_hay", F.xxhash64(hay))), "_hay").where(F.contains(hay, F.col(needle))).drop("_hay")


def prefixes(text: Column, least: int = 1, dropped: int | None = None) -> Column:
    """Prefixes of at least that many characters; with dropped, those that lack so many at most."""
    n = F.length(text)
    low = F.lit(least) if dropped is None else F.greatest(F.lit(least), n - dropped)
    return F.transform(F.when(n >= low, F.sequence(low, n)).otherwise(F.array().cast("array<int>")), lambda k: F.substring(text, F.lit(1), k))


def within_edits(a: DataFrame, b: DataFrame, a_text: str, b_text: str, most: Callable[[Column], Column], reach: Callable[[Column], Column], same: tuple[str, ...] = ()) -> DataFrame:
    """Candidate pairs (same, a_text, b_text): all that are within most(length of b_text) edits, and some more.

    A text of b is cut in most + 1 segments; within that many edits one of them stands unchanged in the text of a, shifted by
    most places at most. Lengths of a reach up to reach(length of a_text) away.
    """

    def cut(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
        size = F.floor(n / parts).cast("int")
        short = parts - (n - size * parts)
        return (i * size + F.greatest(F.lit(0), i - short)).cast("int"), (size + F.when(i >= short, 1).otherwise(0)).cast("int")

    n, parts = F.length(b_text), (most(F.length(b_text)) + 1).cast("int")
    rows = b.select(*same, b_text, n.alias("n"), parts.alias("parts")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start, size = cut(F.col("n"), F.col("parts"), F.col("i"))
    cuts = rows.select(*same, b_text, "n", "i", F.substring(F.col(b_text), start + 1, size).alias("segment"))

    m = F.length(a_text)
    rows = a.select(*same, a_text).distinct().withColumn("n", F.explode(F.sequence(F.greatest(F.lit(0), m - reach(m)).cast("int"), (m + reach(m)).cast("int"))))
    rows = rows.withColumn("parts", (most(F.col("n")) + 1).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    start, size = cut(F.col("n"), F.col("parts"), F.col("i"))
    rows = rows.withColumns({"at": start, "size": size}).withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("parts") + 1), F.col("at") + F.col("parts") - 1)))
    probes = rows.where(F.col("at") + F.col("size") <= m).select(*same, a_text, "n", "i", F.substring(F.col(a_text), F.col("at") + 1, F.col("size")).alias("segment")).distinct()
    return apart(probes).join(apart(cuts), [*same, "n", "i", "segment"]).select(*same, a_text, b_text).distinct()


def shortened(rows: DataFrame, text: str, most: int) -> DataFrame:
    """rows with `left`: the text without any `most` or fewer of its characters, in all ways (the last of them goes first)."""
    out = rows.withColumns({"left": F.col(text), "at": F.length(text) + 1})
    for _ in range(most):
        out = out.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("at") - 1))))
        out = out.withColumn("left", F.when(F.col("at") == 0, F.col("left")).otherwise(F.concat(F.substring("left", F.lit(1), F.col("at") - 1), F.substring("left", F.col("at") + 1, F.length("left")))))
    return out.drop("at")


def few_edits(a: DataFrame, b: DataFrame, a_text: str, b_text: str, most: int, same: tuple[str, ...] = (), longest: int = 32) -> DataFrame:
    """Pairs (same, a_text, b_text) within `most` edits.

    Such texts are equal once each has lost some `most` or fewer characters, so they meet on what is then left, as hashes:
    texts of many that share a segment do not all meet. Texts beyond `longest` characters, which can be shortened in too many
    ways, meet on segments.
    """
    left, right = (dealt(x.select(*same, t), *same, t).distinct() for x, t in ((a, a_text), (b, b_text)))
    key = lambda c: F.xxhash64(*same, c)
    asked = shortened(left.where(F.length(a_text) <= longest), a_text, most).select(*same, a_text, key("left").alias("left"))
    known = shortened(right.where(F.length(b_text) <= longest + most), b_text, most).select(key(b_text).alias("_b"), key("left").alias("left"))
    met = known.join(asked.hint("shuffle_hash"), "left").select(*same, a_text, "_b").distinct()
    short = apart(met).join(apart(right.withColumn("_b", key(b_text))), ["_b", *same]).select(*same, a_text, b_text)
    long = within_edits(left.where(F.length(a_text) > longest), right.where(F.length(b_text) > longest - most), a_text, b_text, lambda _: F.lit(most), lambda _: F.lit(most), same)
    return short.unionByName(long).distinct().where(F.levenshtein(a_text, b_text, most) >= 0)
