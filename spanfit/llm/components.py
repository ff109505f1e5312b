"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a handful of joins and group-bys over the edges, stored in the shared folder; the driver sees a count and a
checksum. A hub with many neighbours is dealt over many tasks. Before the first round every task replaces its own edges by stars (union-find over a bounded number of edges).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import spread_join, stored

TASK_EDGES = 1_000_000


def stars(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's smallest reachable node, for nodes that have a smaller one."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x], x = root, y
        return root

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        found = stars(iter(held))
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["a", "b"])

    for b in batches:
        held += zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)
        if len(held) > TASK_EDGES:
            yield out()
            held = []
    if held:
        yield out()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a long, b long): (node, root), root the smallest node of the component, for all nodes with an edge to another.

    Loops and repeated edges are harmless; no edges give no rows.
    """
    now = stored(edges.where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = stored(spread_join(both, low, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, ["a"], "b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = stored(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "edges")
        if (new := _state(then)) == state:
            break
        now, state = then, new
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def least_names(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(node, least_id): the smallest first_id of each component, from labels (node, root) and names (node, first_id)."""
    members = stored(labels.join(names, "node"), "members")
    return spread_join(members, members.groupBy("root").agg(F.min("first_id").alias("least_id")), ["root"], "node").select("node", "least_id")
