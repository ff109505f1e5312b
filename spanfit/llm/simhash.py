"""Near-deduplication of texts by 64-bit SimHash with pigeonring filtering.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of 3 words joined by spaces, repeats included (fewer
words: all of them as one; no word: fingerprint 0); h is a shingle's XXH64 with seed 42; a bit is 1 if it is set in more
than half of the h. Fingerprints within 2 bits link; documents with equal fingerprints are one node.

Pigeonring: the 64 bits form a ring of three segments (21, 21, 22). If two fingerprints differ in at most 2 bits, then
from some segment on every chain of l consecutive segments differs in at most l * 2/3 bits: the first segment in none,
the first two in at most one. So each fingerprint is filed under every (first segment, second segment without one of its
bits): 64 keys, and two fingerprints of a chain share one. The third segment is settled by the full Hamming check.
Members of a bucket agree in 41 bits or more, so a bucket holds at most 2^23 distinct fingerprints however many documents
there are, and a fingerprint has at most 2,080 others within 2 bits: candidates and links grow in proportion to distinct
fingerprints. Small buckets compare members with each other; larger ones look the 277 patterns of at most 2 changed bits
up among their members. A pair is reported in the first bucket that it shares only. Filing writes 64 rows of 16 bytes for
each distinct fingerprint, at any corpus size; documents come back to their fingerprint with large groups dealt over tasks.

Defined results: null text is empty; empty texts have fingerprint 0 and so link; null ids have fingerprints but never
name a component unless it has no other; repeated rows link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches, spread_join, stored
from spanfit.llm.components import connected_components, least_names

SHINGLE, SEED, BITS = 3, 42, 2
#: Lowest bit and width of the ring's segments.
RING = ((0, 21), (21, 21), (42, 22))
CHUNK = 1 << 15
SMALL = 64


def fingerprint(text: bytes) -> int:
    """SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(x) for x in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment(x: np.ndarray, k: int) -> np.ndarray:
    at, width = RING[k % 3]
    return (x >> np.uint64(at)) & np.uint64((1 << width) - 1)


def _key(start: int, bit: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    head = np.uint64((start * 32 + bit) << 44)
    return head | (first << np.uint64(22)) | (second & ~np.uint64(1 << bit))


def chain_keys(fps: np.ndarray) -> np.ndarray:
    """The 64 keys of each fingerprint, one row of the array for each start and left-out bit."""
    return np.stack([_key(k, bit, _segment(fps, k), _segment(fps, k + 1)) for k in range(3) for bit in range(RING[(k + 1) % 3][1])])


def _first_chain(x: np.ndarray) -> np.ndarray:
    """start * 32 + bit of the first key that two fingerprints differing in x share; -1 if there is none."""
    found = np.full(len(x), -1, np.int64)
    for k in (2, 1, 0):
        second = _segment(x, k + 1)
        n = np.bitwise_count(second)
        bit = np.where(n == 1, np.log2(np.maximum(second, 1).astype(np.float64)), 0).astype(np.int64)
        found = np.where((_segment(x, k) == 0) & (n <= 1), k * 32 + bit, found)
    return found


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy().view(np.uint64)
        keys = chain_keys(fps)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fps, len(keys)).view(np.int64))], names=["key", "fp"])


def _near(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows with equal keys (key is sorted), each in its first bucket only."""
    left, right = [], []

    def take(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> None:
        x = a ^ b
        ok = (np.bitwise_count(x) <= BITS) & (a != b)
        a, b, x, k = a[ok], b[ok], x[ok], k[ok]
        ok = _first_chain(x) == (k >> np.uint64(44)).astype(np.int64)
        left.append(a[ok])
        right.append(b[ok])

    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(begins, len(key)))
    large = np.flatnonzero(sizes > SMALL)
    of_row = np.repeat(sizes, sizes)
    rows = (of_row > 1) & (of_row <= SMALL)
    k, f = key[rows], fps[rows]
    for step in range(1, int(of_row[rows].max(initial=1))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if len(same):
            take(f[same], f[same + step], k[same])
    for g in large:
        members = np.unique(fps[begins[g] : begins[g] + sizes[g]])
        one = key[begins[g]]
        start, bit = divmod(int(one >> np.uint64(44)), 32)
        free = [RING[(start + 1) % 3][0] + bit, *(RING[(start + 2) % 3][0] + p for p in range(RING[(start + 2) % 3][1]))]
        for n in (1, 2):
            for bits in combinations(free, n):
                other = members ^ np.uint64(sum(1 << p for p in bits))
                at = np.minimum(np.searchsorted(members, other), len(members) - 1)
                hit = (members[at] == other) & (members < other)
                take(members[hit], other[hit], np.full(int(hit.sum()), one))
    return np.concatenate([np.zeros(0, np.uint64), *left]), np.concatenate([np.zeros(0, np.uint64), *right])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key, bucket by bucket; the last bucket of a batch waits for the next one."""
    key, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def out(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _near(key, fps)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    waiting, held = [], 0
    for b in batches:
        waiting.append((b.column("key").to_numpy().view(np.uint64), b.column("fp").to_numpy().view(np.uint64)))
        held += b.num_rows
        if held < 200_000:
            continue
        key, fps = (np.concatenate([x, *y]) for x, y in zip((key, fps), zip(*waiting, strict=True), strict=True))
        waiting, held = [], 0
        cut = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))
        if cut:
            yield out(key[:cut], fps[:cut])
            key, fps = key[cut:], fps[cut:]
    if waiting:
        key, fps = (np.concatenate([x, *y]) for x, y in zip((key, fps), zip(*waiting, strict=True), strict=True))
    if len(key):
        yield out(key, fps)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (column fp) within 2 bits, each once."""
    filed = distinct.select("fp").mapInArrow(_file, "key long, fp long")
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def near_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links)."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    least = least_names(connected_components(links(distinct)), distinct.withColumnRenamed("fp", "node")).withColumnRenamed("node", "fp")
    named = distinct.join(least, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return spread_join(rows, named, ["fp"], "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each group, with the columns of docs.

    Rows that repeat an id stay or go together; rows without id stay only where their group has no id at all.
    """
    kept = near_report(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
