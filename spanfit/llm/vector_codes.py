"""Compression of vectors to short codes: one byte for each part of a vector, the index of its nearest codebook entry.

Components become integers floor(scale * x), so that every step has one exact answer. A vector is cut into `parts`
consecutive parts; the codebook of a part position begins as that part of the `entries` vectors of smallest id, and
`rounds` times all parts are assigned to their nearest entry and each used entry becomes the floor of its parts' mean.

Assignment is screened by a float32 matrix product. Without |p|^2, which all entries share, the squared distance is
|c|^2 - 2 p.c. For vectors of n components a float32 product, summed in any order, with its operands rounded first, is
off by at most g |p||c| with g = (n + 2)u / (1 - (n + 2)u), u = 2^-24; what follows is done in float64, whose rounding is
added. So each entry has an interval that holds its true value. Entries whose interval reaches below the smallest upper
end are evaluated again in int64; of those with the least distance the first index wins. All others are certainly farther.

Each task sums its vectors by (part, entry), group-by adds the tasks' sums, and the driver holds codebooks only: `entries`
times the length of a vector, for each length that occurs. Vectors are read once and stored as integers; no vector is
shuffled before the sums by label, where hot labels are dealt over many tasks.

Defined results: vectors that are null or hold null or non-finite components are dropped; a null id comes after all
others; of equal ids the smaller integer vector comes first; fewer vectors than entries make a smaller codebook. Vectors
of each length have codebooks of their own; a length that doesn't divide by `parts` is cut as evenly as it goes, the empty
vector has distance 0. Components are held within +-2^30 / sqrt(length), where squared distances fit 64 bits. Null labels
are one label; label errors that leave 64 bits are null; an empty table gives an empty result. Columns other than the
three named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches, spread_join, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows screened at once, and candidates evaluated at once.
ROWS, PAIRS = 2048, 1 << 16


def bounds(dim: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector of that length begin, and the end."""
    return [k * dim // parts for k in range(parts + 1)]


def nearest(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of int64 rows p: the index of the nearest row of c (ties to the lower one), the squared distance, and how many candidates had to be evaluated."""
    n = p.shape[1]
    p64, c64 = p.astype(np.float64), c.astype(np.float64)
    c_norm = np.sqrt((c64 * c64).sum(axis=1))
    p_norm = np.sqrt((p64 * p64).sum(axis=1))
    product = (p.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    u = (n + 2) * 2.0**-24
    square = (c64 * c64).sum(axis=1)
    value = square - 2 * product
    # The last term covers float64: of the sum of squares (n roundings), the subtraction, the norms and this bound itself.
    off = (2 * u / (1 - u) * 1.001) * np.outer(p_norm, c_norm) + (n + 8) * 2.0**-52 * (square + 2 * np.outer(p_norm, c_norm))
    row, entry = np.nonzero(value - off <= (value + off).min(axis=1)[:, None])
    exact = np.empty(len(row), np.int64)
    for at in range(0, len(row), PAIRS):
        d = p[row[at : at + PAIRS]] - c[entry[at : at + PAIRS]]
        exact[at : at + PAIRS] = np.einsum("ij,ij->i", d, d)
    first = np.searchsorted(row, np.arange(len(p)))
    least = np.minimum.reduceat(exact, first) if len(p) else np.zeros(0, np.int64)
    best = np.flatnonzero(exact == least[row])
    chosen = best[np.searchsorted(row[best], np.arange(len(p)))]  # rows and entries are in order: the first is the lowest index
    return entry[chosen], least, len(row)


def _groups(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integer vectors) for each length of a batch, a bounded number of rows at once."""
    column = b.column(at)
    lengths = np.diff(np.asarray(column.offsets))
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for k in range(0, len(rows), ROWS):
            some = rows[k : k + ROWS]
            yield int(dim), some, column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), dim)


def _assign(books: dict, parts: int, dim: int, x: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    ends = bounds(dim, parts)
    for k in range(parts):
        cut = slice(ends[k], ends[k + 1])
        index, distance, _ = nearest(x[:, cut], books[dim][:, cut])
        yield k, cut, index, distance


def _sums(books: dict, parts: int):
    """A task's sums: (dim, part, entry, at, total); at -1 has the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = {}, {}
        for b in batches:
            for dim, _, x in _groups(b, 0):
                if dim not in totals:
                    totals[dim], counts[dim] = np.zeros(books[dim].shape, np.int64), np.zeros((parts, len(books[dim])), np.int64)
                for k, cut, index, _ in _assign(books, parts, dim, x):
                    np.add.at(totals[dim][:, cut], index, x[:, cut])
                    counts[dim][k] += np.bincount(index, minlength=len(books[dim]))
        for dim, total in totals.items():
            ends = bounds(dim, parts)
            for k in range(parts):
                used = np.flatnonzero(counts[dim][k])
                at = np.arange(-1, ends[k + 1] - ends[k])
                values = np.concatenate([counts[dim][k][used, None], total[used, ends[k] : ends[k + 1]]], axis=1)
                size = values.size
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, dim)), pa.array(np.full(size, k)), pa.array(np.repeat(used, len(at))), pa.array(np.tile(at, len(used))), pa.array(values.ravel())], names=["dim", "part", "entry", "at", "total"])

    return run


def _codes(books: dict, parts: int, digests: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, x in _groups(b, 0):
                found = [(index, distance) for *_, index, distance in _assign(books, parts, dim, x)]
                hexes = np.stack([index for index, _ in found], axis=1)
                code = ["".join(f"{v:02x}" for v in r) for r in hexes.tolist()]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(code), pa.array(sum(d for _, d in found)), pa.array([digests[dim]] * len(rows))], names=["vec_id", "label_key", "no_label", "code", "error", "codebooks_sha256"])

    return run


def integer_vectors(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> F.Column:
    """The column's vectors as integers floor(scale * x); null where one is null or holds null or non-finite components."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    most = F.floor(F.lit(float(1 << 30)) / F.sqrt(F.greatest(F.size(v), F.lit(1)))).cast("double")
    return F.when(good, F.transform(v, lambda x: F.floor(F.greatest(-most, F.least(most, x.cast("double") * scale))).cast("int")))


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """By length of vectors (vec_id, q): the entries after all rounds, as rows; all part positions side by side."""
    vectors = vectors.withColumn("dim", F.size("q"))
    books = {}
    for (dim,) in vectors.select("dim").distinct().collect():
        own = vectors.where(F.col("dim") == dim)
        order = F.col("vec_id").asc_nulls_last()
        ids = [r.vec_id for r in own.select("vec_id").orderBy(order).limit(entries).collect()]  # `entries` ids
        if None not in ids:
            own = own.where(F.col("vec_id") <= ids[-1])  # so that hardly any other vector is sorted
        first = own.select("vec_id", "q").orderBy(order, "q").limit(entries).collect()
        books[dim] = np.array([r.q for r in first], np.int64).reshape(len(first), dim)
    for _ in range(rounds if books else 0):
        sums = vectors.select("q").mapInArrow(_sums(books, parts), "dim long, part long, entry long, at long, total long")
        found = sums.groupBy("dim", "part", "entry", "at").agg(F.sum("total").alias("total")).toPandas()  # one number a component of a codebook
        new = {}
        for dim, group in found.groupby("dim"):
            book, ends = books[dim].copy(), np.array(bounds(dim, parts))
            part, entry, at, total = (group[c].to_numpy() for c in ("part", "entry", "at", "total"))
            counts = np.ones((parts, len(book)), np.int64)
            one = at < 0
            counts[part[one], entry[one]] = total[one]
            book[entry[~one], ends[part[~one]] + at[~one]] = total[~one] // counts[part[~one], entry[~one]]
            new[dim] = book
        books = new
    return books


def vector_code_report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per vector that stays: vec_id, code, error, label_error, codebooks_sha256."""
    small_batches(rows.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    label = F.col(label_col)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(label.cast("string"), F.lit("")).alias("label_key"), label.isNull().alias("no_label"), integer_vectors(rows, vector_col, scale).alias("q"))
    kept = stored(kept.where(F.col("q").isNotNull()), "vectors")
    books = codebooks(kept.select("vec_id", "q"), parts, entries, rounds)
    digests = {}
    for dim, book in books.items():
        ends = bounds(dim, parts)
        digests[dim] = hashlib.sha256(",".join(str(v) for k in range(parts) for v in book[:, ends[k] : ends[k + 1]].ravel().tolist()).encode()).hexdigest()
    coded = kept.select("q", "vec_id", "label_key", "no_label").mapInArrow(_codes(books, parts, digests), "vec_id long, label_key string, no_label boolean, code string, error long, codebooks_sha256 string")
    coded = stored(coded, "codes")
    sums = coded.groupBy("label_key", "no_label").agg(F.try_sum("error").alias("label_error"))
    return spread_join(coded, sums, ["label_key", "no_label"], "vec_id").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
