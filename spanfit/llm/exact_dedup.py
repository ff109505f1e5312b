"""Exact deduplication by Grace hashing.

Texts are compared in full. Each scan task first combines its own copies, so that a text held by a third of all rows
leaves a task once; then rows are dealt by a 64-bit hash of the text (the first partitioning level, done by Spark's
shuffle) and each task partitions further into spill files, by a hash of the text with the level as seed, until what is
left of a bucket fits an open-addressing table within `table_bytes`. The table holds distinct texts only, so copies never
fill it. Spill files are private to the running task and go with it; a retried task writes its own.

`exact_dedup` carries the other columns of the row that stays along with its text, so whole rows are shuffled once.

Defined results: null text is the empty text; rows are never dropped for a null id (ids are compared as Spark compares
them, null last); rows that repeat both id and text are one document listed several times: the report flags each of
them, `exact_dedup` keeps one (of different ones the first by their other columns' text). An empty input gives an empty output. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanfit.llm.common import small_batches, spread_join, stored

TABLE_BYTES = 64 << 20
FANOUT = 16

_PART = "hash long, text binary, top_id long, n long, n_top long"
_GROUP = "sha binary, n_bytes long, hash long, top_id long, n long, n_top long"


class ContentTable:
    """Open addressing with linear probing over whole texts; each entry keeps the largest id, its repeats and the size."""

    def __init__(self) -> None:
        self.slots, self.entries, self.bytes = [-1] * 1024, [], 0

    def _slot(self, h: int, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (e := self.slots[at]) >= 0 and not (self.entries[e][0] == h and self.entries[e][1] == text):
            at = (at + 1) & mask
        return at

    def add(self, h: int, text: bytes, top: int | None, n: int, n_top: int, row: dict | None, room: int) -> bool:
        """False if the text is new and the table holds `room` bytes already. row: what else is kept of the row with the largest id."""
        at = self._slot(h, text)
        if self.slots[at] >= 0:
            e = self.entries[self.slots[at]]
            e[3] += n
            if top == e[2]:
                e[4] += n_top
                if row is not None and repr(row) < repr(e[5]):
                    e[5] = row
            elif top is not None and (e[2] is None or top > e[2]):
                e[2], e[4], e[5] = top, n_top, row
            return True
        if self.entries and self.bytes + len(text) > room:
            return False
        self.slots[at] = len(self.entries)
        self.entries.append([h, text, top, n, n_top, row])
        self.bytes += len(text) + (200 if row is None else 1000)
        if 3 * len(self.entries) > 2 * len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for k, e in enumerate(self.entries):
                self.slots[self._slot(e[0], e[1])] = k
        return True


def _batches(rows: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 1000):
        columns = zip(*rows[i : i + 1000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], schema=schema)


def _combine(table_bytes: int):
    """Map side: copies within a task become one row; a full table is handed on and begun anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, schema = ContentTable(), None
        for b in batches:
            if schema is None:
                schema = pa.schema([*zip(("hash", "text", "top_id", "n", "n_top"), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True), *[b.schema.field(k) for k in range(3, b.num_columns)]])
            rest = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            for h, text, i, row in zip(*(b.column(k).to_pylist() for k in range(3)), rest, strict=True):
                if not t.add(h, text, i, 1, 1, row, table_bytes):
                    yield from _batches(t.entries, schema)
                    t = ContentTable()
                    t.add(h, text, i, 1, 1, row, table_bytes)
        if schema is not None:
            yield from _batches(t.entries, schema)

    return run


def _grace(table_bytes: int, fanout: int, out):
    """Reduce side: one table per bucket, new texts that find it full go to spill files of the next level. `out` makes batches of entries."""

    def bucket(rows: Iterator[tuple], level: int, folder: str) -> Iterator[list]:
        t, files = ContentTable(), {}
        for row in rows:
            if not t.add(*row, table_bytes):
                k = xxhash.xxh64_intdigest(row[1], level) % fanout
                if k not in files:
                    files[k] = open(os.path.join(folder, f"{level}-{k}-{len(os.listdir(folder))}"), "w+b")
                pickle.dump(row, files[k], pickle.HIGHEST_PROTOCOL)
        yield from t.entries
        del t
        for f in files.values():
            f.seek(0)
            yield from bucket(spilled(f), level + 1, folder)
            f.close()
            os.unlink(f.name)

    def spilled(f) -> Iterator[tuple]:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemas: list[pa.Schema] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                schemas[:] = [b.schema]
                rest = b.column(5).to_pylist() if b.num_columns > 5 else [None] * b.num_rows
                yield from zip(*(b.column(k).to_pylist() for k in range(5)), rest, strict=True)

        with tempfile.TemporaryDirectory() as folder:
            held = []
            for entry in bucket(rows(), 0, folder):
                held.append(entry)
                if len(held) == 2000:
                    yield from out(held, schemas[0])
                    held = []
            if held:
                yield from out(held, schemas[0])

    return run


def _groups(entries: list, _: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = [(hashlib.sha256(text).digest(), len(text), h, top, n, n_top) for h, text, top, n, n_top, _ in entries]
    types = (pa.binary(), *[pa.int64()] * 5)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["sha", "n_bytes", "hash", "top_id", "n", "n_top"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.xxhash64(text).alias("hash"), text.alias("text"), F.col(id_col).cast("long").alias("id"), *more)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per distinct text: sha (SHA-256), n_bytes, hash, top_id (largest id), n (rows), n_top (rows with that id)."""
    parts = _keyed(docs, id_col, text_col).mapInArrow(_combine(table_bytes), _PART)
    return parts.repartition("hash").mapInArrow(_grace(table_bytes, fanout, _groups), _GROUP)


def exact_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Large groups are dealt over many tasks."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("hash")), "texts")
    joined = spread_join(slim, exact_groups(docs, id_col, text_col, **how), ["sha", "n_bytes", "hash"], "doc_id")
    return joined.select("doc_id", F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The rows that stay, one for each distinct text, with the columns of docs."""
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col), F.col(text_col).isNull().alias("null_text"))
    rows = _keyed(docs, id_col, text_col, rest.alias("rest"))
    kind = T.StructType([*T.StructType.fromDDL(_PART).fields, T.StructField("rest", rows.schema["rest"].dataType)])

    parts = rows.mapInArrow(_combine(table_bytes), kind).repartition("hash")
    kept = parts.mapInArrow(_grace(table_bytes, fanout, _batches), kind)
    columns = [F.when(~F.col("rest.null_text"), F.col("text").cast(docs.schema[c].dataType)).alias(c) if c == text_col else F.col(f"rest.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return kept.select(*columns)
