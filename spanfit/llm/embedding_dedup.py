"""Embedding near-deduplication by E8 lattice hashing.

Vectors with equal labels and cosine >= 0.93 link. Equal vectors of a label are first joined to one class with its size.
Each table projects unit vectors by random Gaussian matrices to 8 dimensions, shifts them, and decodes the nearest point of
the E8 lattice; neighbouring lattice points, those nearest to the vector, are probed too. Two classes are compared if any of
their cells agree. As a label grows its cells would fill with chance meetings, so cells of labels with more classes hold
several lattice codes at once (CODES: classes, codes, tables, scale, probes). Of all combinations of a vector's points and
their neighbours only the nearest ones are probed, so a vector has 40 cells in the first step and 96 in the others, at any
number of codes. In simulation at 64 dimensions pairs at cosine 0.93 share a cell with probability 0.99 or more at each
step (closer ones: more), unrelated ones with 6e-3 for one code, 2e-4 for two, some 1e-5 for three.

Cells are counted before any vector moves: those of a single class are dropped. Vectors join the cells that are left, hot
cells dealt over many tasks; cells of more than BLOCK classes are dealt in pairs of blocks. Within a block pair cosines are exact (double precision),
a pair counts in the first table and cell that it shares only, and what leaves the task is one row per member of a stretch
of buckets: how many vectors it links with there, and the smallest member it reaches there. So links are counted in full but
never listed, and components come from the reached members.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label,
link with nothing; vectors of different lengths never link; repeated rows are other vectors of the same class; a null id
counts as a vector but never names a component that has another; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches, spread_join, stored
from spanfit.llm.components import connected_components, least_names, stars

COSINE, SEED, BLOCK = 0.93, 8, 512
#: Classes of a label up to which a row holds, lattice codes of a cell, tables, scale of the projections, probed cells.
CODES = ((32_000, 1, 8, 1.0, 4), (1_000_000, 2, 12, 0.7, 7), (30_000_000, 3, 12, 0.55, 7), (1 << 62, 4, 12, 0.42, 7))
SMALL, PAIRS, STRETCH_BYTES = 64, 20_000, 16 << 20


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: pairs of +-1, and +-1/2 everywhere with an even number of minus signs."""
    whole = [v for v in product((-1, 0, 1), repeat=8) if np.abs(v).sum() == 2]
    half = [v for v in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, np.float64)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where rounding gives an odd one, the worst coordinate goes the other way."""
    f = np.round(y)
    odd = np.flatnonzero(f.sum(axis=1) % 2)
    off = y[odd] - f[odd]
    worst = np.abs(off).argmax(axis=1)
    f[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 moved by 1/2."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@cache
def _tables(dim: int, tables: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((SEED, dim))
    return rng.standard_normal((tables, dim, 8)) * scale, rng.uniform(0, 2, (tables, 8))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, also of very large or small ones."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, plan: int = 0, codes: tuple = CODES) -> np.ndarray:
    """Of unit vectors: a 64-bit hash of each cell, shape (rows, tables, 1 + probes); a vector's own cell and the nearest others."""
    _, n, tables, scale, probes = codes[plan]
    out = np.empty((len(x), tables, 1 + probes), np.uint64)
    for t in range(tables):
        found, far = np.zeros((len(x), 1), np.uint64), np.zeros((len(x), 1))
        for k in range(n):
            each, cost = lattice_codes(x, n * tables, t * n + k, probes, scale)
            found = (found[:, :, None] * np.uint64(0x9E3779B97F4A7C15) ^ each[:, None, :]).reshape(len(x), -1)
            far = (far[:, :, None] + cost[:, None, :]).reshape(len(x), -1)
            near = np.argsort(far, axis=1, kind="stable")[:, : (1 + probes) * (1 if k == n - 1 else 2)]
            found, far = np.take_along_axis(found, near, 1), np.take_along_axis(far, near, 1)
        out[:, t] = found
    return out


def lattice_codes(x: np.ndarray, tables: int, table: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors in one of so many tables: a 64-bit hash of the lattice point and its nearest neighbours, and how much farther each is (squared)."""
    near = minimal_vectors()
    by = np.random.default_rng((SEED, 1)).integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)
    projections, shifts = _tables(x.shape[1], tables, scale)
    y = x @ projections[table] + shifts[table]
    home = nearest_e8(y)
    towards = (y - home) @ near.T
    order = np.argsort(-towards, axis=1, kind="stable")[:, :probes]
    at = np.concatenate([home[:, None], home[:, None] + near[order]], axis=1)
    cost = np.concatenate([np.zeros((len(x), 1)), 2 - 2 * np.take_along_axis(towards, order, 1)], axis=1)  # neighbours are at squared distance 2
    twice = np.round(2 * at).astype(np.int64).view(np.uint64)
    h = (twice * by).sum(axis=2, dtype=np.uint64) ^ np.uint64(table * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB), cost


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _alike(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of one length and plan each, in parts whose cells stay small."""
    kind = b.column("dim").to_numpy() * len(CODES) + b.column("plan").to_numpy()
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        for at in range(0, len(rows), 200):
            yield b.take(pa.array(rows[at : at + 200]))


def _file(codes: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _alike(whole):
                c = cells(unit(_vectors(b.column("embedding"))), b.column("plan")[0].as_py(), codes)
                rows = pa.array(np.repeat(np.arange(b.num_rows), c.shape[1] * c.shape[2]))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in ("cls", "label_a", "label_b", "dim")), pa.array(c.ravel().view(np.int64))], names=["cls", "label_a", "label_b", "dim", "cell"])

    return run


def _shared_first(ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Of pairs' cells (rows, tables, cells): the least cell that both have in the first table where they share one."""
    none = np.iinfo(np.uint64).max
    found = np.full(len(ca), none, np.uint64)
    for t in reversed(range(ca.shape[1])):
        same = ca[:, t, :, None] == cb[:, t, None, :]
        least = np.where(same.any(axis=2), ca[:, t], none).min(axis=1, initial=none)
        found = np.where(least != none, least, found)
    return found


def _close_pairs(bucket: np.ndarray, own: np.ndarray, one: np.ndarray, x: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with equal buckets (in order) and cosine of at least that. Where a bucket is one of two blocks (not `one`), pairs across the blocks only."""
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(begins, len(bucket)))
    of_row = np.repeat(sizes, sizes)
    rows = np.flatnonzero((of_row > 1) & (of_row <= SMALL))
    g = bucket[rows]
    for step in range(1, int(of_row[rows].max(initial=1))):
        at = np.flatnonzero(g[step:] == g[:-step])
        p, q = rows[at], rows[at + step]
        ok = one[p] | (own[p] != own[q])
        p, q = p[ok], q[ok]
        for k in range(0, len(p), PAIRS):
            pk, qk = p[k : k + PAIRS], q[k : k + PAIRS]
            near = np.einsum("ij,ij->i", x[pk], x[qk]) >= cosine
            yield pk[near], qk[near]
    for begin, size in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        rows = np.arange(begin, begin + size)
        a, b = (rows, rows) if one[begin] else (rows[own[rows] == own[begin]], rows[own[rows] != own[begin]])
        for k in range(0, len(a), 512):
            p, q = np.nonzero(x[a[k : k + 512]] @ x[b].T >= cosine)
            p, q = a[k + p], b[q]
            if one[begin]:
                p, q = p[p < q], q[p < q]
            for k2 in range(0, len(p), PAIRS):
                yield p[k2 : k2 + PAIRS], q[k2 : k2 + PAIRS]


def _verify(cosine: float, codes: tuple):
    """From rows in order of (label, dim, cell, i, j): per class of a stretch of buckets, the vectors it links with there and the least class it reaches."""

    def links(rows: pa.Table, bucket: np.ndarray) -> pa.RecordBatch:
        dim = rows.column("dim").to_numpy() * len(codes) + rows.column("plan").to_numpy()
        cls, n, own = (rows.column(c).to_numpy() for c in ("cls", "n", "own"))
        one = rows.column("i").to_numpy() == rows.column("j").to_numpy()
        cell = rows.column("cell").to_numpy().view(np.uint64)
        names, place = np.unique(cls, return_inverse=True)
        count, reach = np.zeros(len(names), np.int64), {}
        for length in np.unique(dim):
            at = np.flatnonzero(dim == length)
            first = np.unique(place[at], return_index=True)
            x = unit(_vectors(rows.column("embedding").take(pa.array(at[first[1]])).combine_chunks()))
            where = np.zeros(len(names), np.int64)
            where[first[0]] = np.arange(len(first[0]))
            each = where[place[at]]
            found = []
            for p, q in _close_pairs(bucket[at], own[at], one[at], x[each], cosine):
                if not len(p):
                    continue
                met = np.unique(np.concatenate([each[p], each[q]]))  # cells of the few that are close
                c = cells(x[met], int(length % len(codes)), codes)
                ok = (_shared_first(c[np.searchsorted(met, each[p])], c[np.searchsorted(met, each[q])]) == cell[at[p]]) & (cls[at[p]] != cls[at[q]])
                p, q = at[p[ok]], at[q[ok]]
                np.add.at(count, place[p], n[q])
                np.add.at(count, place[q], n[p])
                found += stars(zip(cls[p].tolist(), cls[q].tolist(), strict=True)).items()
            reach |= stars(iter(found))
        has = np.flatnonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(names[has], pa.int64()), pa.array([reach.get(k, k) for k in names[has].tolist()], pa.int64()), pa.array(count[has])], names=["cls", "least", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([rows.column(c).to_numpy() for c in ("label_a", "label_b", "dim", "cell", "i", "j")], axis=1)
            bucket = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
            end = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))
            if end:
                yield links(rows.slice(0, end), bucket[:end])
            held, size = rows.slice(end).to_batches(), 0

        for b in batches:
            held.append(b)
            size += b.column("embedding").nbytes + 64 * b.num_rows
            if size > STRETCH_BYTES:
                yield from cut(False)
        if held and sum(b.num_rows for b in held):
            yield from cut(True)

    return run


def embedding_report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, codes: tuple = CODES, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    v = F.col("embedding")
    good = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = stored(rows.withColumn("good", good), "vectors")
    classes = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    # A label's key has 128 bits: two hashes with different beginnings.
    keys = {"label_a": F.xxhash64("label"), "label_b": F.xxhash64(F.lit("label"), "label")}
    classes = stored(classes.withColumns({"cls": F.monotonically_increasing_id(), "dim": F.size("embedding").cast("long"), **keys}), "classes")
    plan = F.coalesce(*(F.when(F.col("of_label") <= most, k) for k, (most, *_) in enumerate(codes))).cast("long")
    sizes = classes.groupBy("label_a", "label_b", "dim").agg(F.count("*").alias("of_label")).select("label_a", "label_b", "dim", plan.alias("plan"))
    classes = stored(spread_join(classes, sizes, ["label_a", "label_b", "dim"], "cls"), "classes")

    filed = stored(classes.select("cls", "label_a", "label_b", "dim", "plan", "embedding").mapInArrow(_file(codes), "cls long, label_a long, label_b long, dim long, cell long"), "cells")
    key = ["label_a", "label_b", "dim", "cell"]
    members = stored(filed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "shared")
    shared = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).drop("n")
    dealt = spread_join(filed, shared, key, "cls", counted=members).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*key, "cls", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = dealt.join(classes.select("cls", "n", "plan", "embedding"), "cls")
    where = [*key, "i", "j"]
    met = full.repartition(*where).sortWithinPartitions(*where).mapInArrow(_verify(cosine, codes), "cls long, least long, links long")
    met = stored(met, "met")

    counts = met.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected_components(met.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    least = least_names(labels, classes.select(F.col("cls").alias("node"), "first_id")).withColumnRenamed("node", "cls")
    named = classes.select("label", "embedding", "cls", "first_id", "n").join(counts, "cls", "left").join(least, "cls", "left")
    named = named.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id"))
    found = spread_join(rows.where("good").select("vec_id", "label", "embedding"), named, ["label", "embedding"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
