"""SentencePiece models on the tokenizers library.

The model file (a protobuf) is parsed here; normaliser, metaspace marker, scores or merges, and byte fallback are rebuilt
as a `tokenizers.Tokenizer`. Batches are encoded and decoded by the library's threads.

A piece never spans a marker that follows another character (checked when the model is built; else whole texts are
encoded), so a text falls apart, without any change in its ids, into runs of spaces with the word that follows. Each task
keeps the ids of the pieces of text it has met, in a bounded table that is emptied when full, and hands the library only
those it has not.

Control, unknown, unused and byte pieces never match text: they stand in the library's vocabulary under names that no
normalised text can hold. User-defined pieces of a unigram model get sentencepiece's score for them, so they match first.
Characters outside a unigram vocabulary come back from the library as unknown and are spelled in byte pieces here.

Parity: the first text of every batch is encoded whole by the sentencepiece library too, and a difference raises an error;
tests hold ids and texts of a BPE and of a unigram model against it. The library's threads are those of its process
(TOKENIZERS_PARALLELISM, RAYON_NUM_THREADS); Spark's tasks are the first level of parallelism.

Defined results: null text has null ids and decodes to null; the empty text has no ids and decodes to the empty text.
Texts of any length are encoded whole. Further columns pass through; a column that has the new one's name is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanfit.llm.common import small_batches

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_ENTRIES = 80_000
#: Texts handed to the library at once, words joined to one such text, and rows decoded at once.
AT_ONCE, WORDS_A_TEXT, ROWS_AT_ONCE = 2048, 50, 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message: varints as int, fixed 32 bits as float, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif tag & 7 == 1:
            value, at = data[at : at + 8], at + 8
        else:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, kind), the algorithm, and the normaliser's settings."""
    model = {"pieces": [], "algorithm": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "trim": True}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model["pieces"].append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model |= {"algorithm": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0))}
        elif number == 3:
            spec = dict(_fields(value))
            model |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "trim": bool(spec.get(4, 1))}
    return model


def _merges(model: dict) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first: the merges a BPE model of these scores does."""
    ids = {p: k for k, (p, _, kind) in enumerate(model["pieces"]) if kind in (NORMAL, USER)}
    found = []
    for piece, k in ids.items():
        for cut in range(1, len(piece)):
            if (a := piece[:cut]) in ids and (b := piece[cut:]) in ids:
                found.append((-model["pieces"][k][1], k, ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: dict):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next(k for k, p in enumerate(pieces) if p[2] == UNKNOWN)
    if model["algorithm"] == BPE:
        core = models.BPE({p: k for k, (p, _, _) in enumerate(pieces)}, _merges(model), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        best = max((s for _, s, kind in pieces if kind == NORMAL), default=0.0)
        known = [(p, s) if kind == NORMAL else (p, len(p.encode()) * best - 0.1) if kind == USER else (f" {k}", best) for k, (p, s, kind) in enumerate(pieces)]
        core = models.Unigram(known, unk_id=unknown, byte_fallback=False)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["trim"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return t


class Met:
    """What has been worked out before, in two generations of at most CACHE_ENTRIES each."""

    def __init__(self, work) -> None:
        self.work, self.now, self.elder = work, {}, {}

    def look_up(self, keys: set) -> dict:
        """A table that has all keys, at least until the next call."""
        if len(self.now) > CACHE_ENTRIES:
            self.now, self.elder = {}, self.now
        missing = keys - self.now.keys()
        known = missing & self.elder.keys()
        self.now.update((k, self.elder[k]) for k in known)
        new = list(missing - known)
        self.now.update(zip(new, self.work(new), strict=True))
        return self.now


class Backend:
    """A model with the ids of text pieces that have been met."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = parse_model(f.read())
        self.path, self.library = path, build(model)
        pieces = model["pieces"]
        self.falls_apart = model["dummy_prefix"] and not model["trim"] and not model["charsmap"] and not any(MARK in p.lstrip(MARK) for p, _, _ in pieces) and any((p, kind) == (MARK, NORMAL) for p, _, kind in pieces)
        self.marked = np.array([p.startswith(MARK) for p, _, _ in pieces])
        self.kinds, self.surfaces = np.array([kind for *_, kind in pieces]), [p for p, _, _ in pieces]
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.bytes = [k for k, kind in enumerate(self.kinds) if kind == BYTE]
        self.spelled = model["algorithm"] == UNIGRAM and model["byte_fallback"] and len(self.bytes) == 256
        self.met, self.sentencepiece = Met(self._words), None

    def whole(self, texts: list[str]) -> list[bytes]:
        found = []
        encode = self.library.encode_batch if self.spelled else self.library.encode_batch_fast  # the fast one has no tokens
        for at in range(0, len(texts), AT_ONCE):
            for e in encode(texts[at : at + AT_ONCE], add_special_tokens=False):
                ids = e.ids
                if self.spelled and self.unknown in ids:
                    ids = [x for k, t in zip(ids, e.tokens, strict=True) for x in ([self.bytes[b] for b in t.encode()] if k == self.unknown else [k])]
                found.append(np.array(ids, np.int32).tobytes())
        return found

    def verify(self, text: str, ids: bytes) -> None:
        """Raises if sentencepiece gives other ids."""
        if self.sentencepiece is None:
            import sentencepiece

            self.sentencepiece = sentencepiece.SentencePieceProcessor(model_file=self.path)
        if self.sentencepiece.encode(text) != np.frombuffer(ids, np.int32).tolist():
            raise ValueError(f"ids of a text of {len(text)} characters differ from those of the sentencepiece library")

    def _words(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts. Plain words go to the library many to a text, whose ids fall apart at the markers."""
        found: dict[str, bytes] = {}
        plain = [w for w in parts if w and w[0] != " "]
        groups = [plain[at : at + WORDS_A_TEXT] for at in range(0, len(plain), WORDS_A_TEXT)]
        for words, ids in zip(groups, self.whole([" ".join(g) for g in groups]), strict=True):
            begins = np.flatnonzero(self.marked[np.frombuffer(ids, np.int32)]) * 4
            found.update(zip(words, (ids[a:b] for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True)), strict=True))
        spaced = [w for w in parts if w and w[0] == " "]
        found.update(zip(spaced, self.whole(spaced), strict=True))
        found[""] = np.array([self.library.token_to_id(MARK)], np.int32).tobytes()  # one space at the end: the marker alone
        return [found[w] for w in parts]

    def apart(self, text: str) -> list[str]:
        """What follows each marker that begins a piece of the text: further spaces, then a word (none at the end)."""
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")  # the marker in a text and a space are one symbol to the model
        if "" not in words:
            return words
        found, run = [], 0
        for w in words:
            if w:
                found.append(" " * run + w)
                run = 0
            else:
                run += 1
        return [*found, " " * (run - 1) if run > 1 else ""] if run else found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian int32."""
        if self.falls_apart:
            parts = [self.apart(x) for x in texts]
            got = self.met.look_up(set().union(*parts)).__getitem__
            ids = [b"".join(map(got, p)) for p in parts]
        else:
            ids = self.whole(texts)
        if texts:
            self.verify(texts[0], ids[0])
        return ids

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """Each row's text; control and unused pieces say nothing, the unknown piece is a double question mark."""
        kinds = self.kinds[np.concatenate([np.zeros(0, np.int32), *rows])]
        if not self.spelled and not np.isin(kinds, (UNKNOWN, CONTROL, UNUSED)).any():
            return self.library.decode_batch([x.tolist() for x in rows], skip_special_tokens=False)
        said = [[" \u2047 " if self.kinds[k] == UNKNOWN else self.surfaces[k] for k in x.tolist() if self.kinds[k] not in (CONTROL, UNUSED)] for x in rows]
        return [self.library.decoder.decode(x) for x in said]


@cache
def backend(path: str) -> Backend:
    return Backend(path)


def _id_lists(found: list[bytes], null: pa.Array | None) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)), mask=null)


def _encode(path: str, text_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend(path)
        for b in batches:
            texts = b.column(text_at)
            ids = _id_lists(model.encode(texts.fill_null("").to_pylist()), texts.is_null() if texts.null_count else None)
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, name])

    return run


def _decode(path: str, ids_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend(path)
        for b in batches:
            ids = b.column(ids_at)
            ends = np.asarray(ids.offsets)
            flat = ids.values.to_numpy(zero_copy_only=False)
            texts: list[str] = []
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                texts += model.decode([flat[ends[k] : ends[k + 1]] for k in range(at, min(at + ROWS_AT_ONCE, b.num_rows))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))], names=[*b.schema.names, name])

    return run


def _both(path: str, text_at: int):
    """Encodes and decodes in one task, so that one model serves both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                texts = b.column(text_at)
                found = model.encode(texts.fill_null("").to_pylist())
                null = texts.is_null()
                decoded = pa.array(model.decode([np.frombuffer(x, np.int32) for x in found]), pa.string(), mask=null.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*b.columns, _id_lists(found, null if texts.null_count else None), decoded], names=[*b.schema.names, "ids", "decoded"])

    return run


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text, without begin or end ids."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != ids_col or c == text_col))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encode(model_path, docs.columns.index(text_col), ids_col), schema)


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col or c == ids_col))
    schema = T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())])
    return docs.mapInArrow(_decode(model_path, docs.columns.index(ids_col), text_col), schema)


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with `ids` of each whole text and `decoded`, the text that these give."""
    small_batches(docs.sparkSession)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded") or c == text_col))
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(_both(model_path, docs.columns.index(text_col)), schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_hash (of the ids in order), decoded_sha256 and same (the decoded text is the text)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    back = encode_decode(slim, model_path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same"))
