"""Alignment of two tokenizers over the same bytes.

Tokenizer A (tokenizers library, byte-level BPE) encodes a space and the text, B (sentencepiece) the text, to which it adds
that space. Both sequences of tokens cover the same bytes, so the union of their end offsets cuts the text into elementary
intervals; a search of each interval in both lists of ends gives the token of A and the token of B that own it. Every
interval is one overlap, no two are the same pair of occurrences, and where both tokens end together a group closes. What
two tokenizers make of each other is therefore a merge of sorted offsets; products are only formed where a caller asks for
all pairs within each group (`group_products`), with runs repeated by counts, a bounded number at once.

A byte-level tokenizer with the usual pattern and a model whose pieces have no inner marker have no token across a single
space that begins a word, so texts fall apart into units there, and a task aligns each distinct unit once (a bounded table,
emptied when full). Texts in which white space meets a space, texts with the marker U+2581, and all texts of other
tokenizers are aligned whole.

Texts are worked in chunks of at most CHUNK_LINKS links (or one text). A chunk has the sorted list of its distinct id pairs
with the number of its documents that hold them, and each document the places of its pairs in that list. Group-by adds the
chunks' counts, the totals go back once for each chunk and pair (not for each document), and are summed where the chunk's
documents lie: no vocabulary-sized table is sent to tasks, and a pair of ids that all documents hold is one row a chunk.

Defined results: null and empty texts, and texts whose joined token bytes of A or B are not a space and the text, have no
tokens: zeros and an empty groups_sha256, and they count for no pair. Rows with equal or null ids are rows of their own.
Strings of special tokens inside texts are plain text. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches, stored

MARK = "▁"
#: Units a task remembers, units joined to one text for the libraries, links of a chunk, products formed at once.
UNITS, UNITS_A_TEXT, CHUNK_LINKS, AT_ONCE = 300_000, 50, 3_000_000, 1 << 20
#: White space before a space that no word follows, runs of spaces, spaces at the end, the marker.
_WHOLE = re.compile(r"\s (?:\s|$)|  | $|" + MARK)
_SPACE = re.compile(r"\s")


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of increasing end offsets with an equal last one: for each elementary interval its token of A, its token of B, and whether both end with it."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


def group_products(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (id of A, id of B) within each group, group by group, at most AT_ONCE at once."""
    a, b, closes = overlaps(a_ends, b_ends)
    at = np.flatnonzero(closes)
    a_stop, b_stop = a[at] + 1, b[at] + 1
    a_size, b_size = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    group = np.repeat(np.arange(len(at)), a_size)  # of each token of A
    ends = np.cumsum(b_size[group])
    for begin in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        k = np.arange(begin, min(begin + AT_ONCE, ends[-1]))
        token = np.searchsorted(ends, k, side="right")
        g = group[token]
        yield a_ids[token], b_ids[b_stop[g] - b_size[g] + (k - (ends[token] - b_size[g]))]


def byte_values() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable bytes stand for themselves, the others for those from U+0100 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _digest(spelled: str) -> str:
    return hashlib.sha256(spelled[:-1].encode()).hexdigest() if spelled else ""


class Aligner:
    """Two tokenizers, and the units aligned so far as columns: counts, pairs, and the groups' spelling."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        value = byte_values()
        # Added tokens that are no byte-level spellings never come out of an encoding without special tokens.
        self.a_bytes = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in (self.a.id_to_token(k) or "" for k in range(self.a.get_vocab_size()))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_begins, self.b_begins = (np.array([x[:1] == b" " for x in t]) for t in (self.a_bytes, self.b_bytes))
        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        self.apart = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not made.get("normalizer") and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.names = max(len(self.a_bytes), n)
        self.spellings = [f"{k}{mark}" for mark in ",|;" for k in range(self.names)]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.spelled: list[str] = []
        self.counts, self.firsts, self.pairs = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of A for a space and each text, of B for each text: all ids one after another, and how many each text has."""
        found = []
        for ids in ([e.ids for e in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1) if texts else []):
            found.append((np.fromiter(chain.from_iterable(ids), np.int64), np.array([len(x) for x in ids], np.int64)))
        return found

    def encode_words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for words without white space, handed to the libraries many to a text and taken apart where a token begins with a space."""
        both = self.encode([" ".join(words[k : k + UNITS_A_TEXT]) for k in range(0, len(words), UNITS_A_TEXT)])
        found = []
        for (ids, _), begins in zip(both, (self.a_begins, self.b_begins), strict=True):
            cuts = np.flatnonzero(begins[ids])
            if len(cuts) != len(words):
                raise ValueError("a token goes across a space that begins a word")
            found.append((ids, np.diff(cuts, append=len(ids))))
        return found

    def _intact(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray, spelled: list[bytes]) -> np.ndarray:
        """Whether the joined token bytes of each text are a space and the text (of the empty text: no)."""
        want = [b" " + x.encode() for x in texts]
        each = list(map(spelled.__getitem__, ids.tolist()))
        ends = np.cumsum(sizes)
        got = np.cumsum([0, *map(len, each)])[np.concatenate([[0], ends])]
        if b"".join(each) == b"".join(want) and np.array_equal(np.diff(got), [len(x) for x in want]):
            return np.array([x != b" " for x in want], bool)
        return np.array([x != b" " and b"".join(each[e - n : e]) == x for x, e, n in zip(want, ends.tolist(), sizes.tolist(), strict=True)], bool)

    def align(self, texts: list[str], words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Per text, the first `words` of them words: n_a, n_b, n_groups, n_links; ends of its links in the list of pairs; that list; the spelling of its groups, each with a `;` after it."""
        (a_ids, a_sizes), (b_ids, b_sizes) = (tuple(map(np.concatenate, zip(x, y, strict=True))) for x, y in zip(self.encode_words(texts[:words]), self.encode(texts[words:]), strict=True))
        n = len(texts)
        ok = self._intact(texts, a_ids, a_sizes, self.a_bytes) & self._intact(texts, b_ids, b_sizes, self.b_bytes)
        a_of, b_of = np.repeat(np.arange(n), a_sizes), np.repeat(np.arange(n), b_sizes)
        a_ids, a_of, b_ids, b_of = a_ids[ok[a_of]], a_of[ok[a_of]], b_ids[ok[b_of]], b_of[ok[b_of]]
        a, b, closes = overlaps(np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids]))
        of = a_of[a]
        counts = np.stack([np.bincount(x, minlength=n) for x in (a_of, b_of, of[closes], of)], axis=1)
        # Spellings in order: of each group the tokens of A, then those of B; the last of each have other marks.
        a_last, b_last = (np.isin(np.arange(len(ids)), x[closes]) for ids, x in ((a_ids, a), (b_ids, b)))
        group = np.concatenate([(np.cumsum(last) - last) * 2 + side for side, last in enumerate((a_last, b_last))])
        spell = np.concatenate([a_ids + self.names * a_last, b_ids + 2 * self.names * b_last])[np.argsort(group, kind="stable")]
        said, ends = list(map(self.spellings.__getitem__, spell.tolist())), np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        return counts, np.cumsum(counts[:, 3]), a_ids[a] << 32 | b_ids[b], ["".join(said[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def look_up(self, units: list[str]) -> np.ndarray:
        """The places of units in the table, which is extended by new ones."""
        new = list(set(units) - self.place.keys())
        if len(self.place) + len(new) > UNITS and self.place:
            self.clear()
            new = list(set(units))
        if new:
            odd = [u for u in new if _SPACE.search(u)]
            if odd:
                new = [*set(new).difference(odd), *odd]
            counts, ends, pairs, spelled = self.align(new, len(new) - len(odd))
            self.place.update(zip(new, range(len(self.spelled), len(self.spelled) + len(new)), strict=True))
            self.spelled += spelled
            self.counts = np.concatenate([self.counts, counts])
            self.firsts = np.concatenate([self.firsts, self.firsts[-1] + ends])
            self.pairs = np.concatenate([self.pairs, pairs])
        return np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: counts and digest of its groups; then (text, pair, times), each pair once a text."""
        counts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        words = [[] if not x or not self.apart or _WHOLE.search(" " + x) else x.split(" ") for x in texts]
        whole = [k for k, w in enumerate(words) if not w and texts[k]]
        sizes = [len(w) for w in words]
        of = np.repeat(np.arange(len(texts)), sizes)
        place = self.look_up([u for w in words for u in w])
        bad = np.unique(of[self.counts[place, 0] == 0])  # a unit whose bytes do not come back
        stops = np.cumsum(sizes)
        for k in set(np.flatnonzero(sizes).tolist()) - set(bad.tolist()):
            at = place[stops[k] - sizes[k] : stops[k]]
            counts[k] = self.counts[at].sum(axis=0)
            digests[k] = _digest("".join(map(self.spelled.__getitem__, at.tolist())))
        ok = ~np.isin(of, bad)
        unit, uses = np.unique(of[ok] * len(self.spelled) + place[ok], return_counts=True)
        text, unit = unit // max(len(self.spelled), 1), unit % max(len(self.spelled), 1)
        links = self.counts[unit, 3]
        within = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        found = [(np.repeat(text, links), self.pairs[np.repeat(self.firsts[unit], links) + within], np.repeat(uses, links))]
        if whole:
            some, _, pairs, spelled = self.align([texts[k] for k in whole])
            counts[whole] = some
            for k, s in zip(whole, spelled, strict=True):
                digests[k] = _digest(s)
            found.append((np.repeat(whole, some[:, 3]), pairs, np.ones(len(pairs), np.int64)))
        text, pair, uses = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pair, text))
        text, pair, uses = text[order], pair[order], uses[order]
        new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])) if len(text) else np.zeros(0, np.int64)
        return counts, digests, text[new], pair[new], np.add.reduceat(uses, new) if len(new) else uses


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_CHUNK = "chunk long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, steps array<int>, times array<int>, pairs array<long>, docs array<long>"


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _chunks(a_path: str, b_path: str, chunk_links: int, part: int):
    """Rows of documents; the first of a chunk also has the chunk's pairs and the number of its documents that hold them. Pairs of a document are places in that list: the first, then steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, links, made = aligner(a_path, b_path), [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            text = np.concatenate([h[3] + k for h, k in zip(held, base, strict=False)])
            pair, times = (np.concatenate([h[k] for h in held]) for k in (4, 5))
            names, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
            steps = np.diff(place, prepend=0)
            first = np.flatnonzero(np.diff(text, prepend=-1))
            steps[first] = place[first]
            n = len(ids)
            own = pa.array(np.concatenate([[0], np.full(n, len(names))]), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task + made)), ids, *(pa.array(c) for c in counts.T), pa.array([d for h in held for d in h[2]]), _lists(steps, text, n, pa.int32()), _lists(times, text, n, pa.int32()), pa.ListArray.from_arrays(own, pa.array(names)), pa.ListArray.from_arrays(own, pa.array(docs))],
                names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times", "pairs", "docs"],
            )

        for whole in batches:
            for at in range(0, whole.num_rows, part):
                b = whole.slice(at, part)
                counts, digests, text, pair, times = model.documents(b.column("text").to_pylist())
                held.append((b.column("doc_id"), counts, digests, text, pair, times))
                links += len(pair)
                if links > chunk_links:
                    yield out()
                    held, links, made = [], 0, made + 1
        if held:
            yield out()

    return run


def _sums(key, docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Of one chunk: its documents' sums over links, from the totals of its pairs."""
    totals = totals.sort_by("place")
    n, best = totals.column("n").to_numpy(), totals.column("best").to_numpy(zero_copy_only=False)
    sums = []
    for steps, times in zip(docs.column("steps"), docs.column("times"), strict=True):
        place, t = np.cumsum(steps.values.to_numpy()), times.values.to_numpy().astype(np.int64)
        sums.append((int(t[best[place]].sum()), int((t * n[place]).sum())) if len(place) else (0, 0))
    slim = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return slim.append_column("n_best", pa.array([s[0] for s in sums], pa.int64())).append_column("count_sum", pa.array([s[1] for s in sums], pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def align_chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = CHUNK_LINKS, part: int = 256) -> DataFrame:
    """The stored table of aligned documents in chunks."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return stored(slim.mapInArrow(_chunks(a_path, b_path, chunk_links, part), _CHUNK.format(id=slim.schema["doc_id"].dataType.simpleString())), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): documents that hold the pair linked, and whether no pair of a_id has more. Stored."""
    rows = chunks.where(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counted = stored(rows.groupBy("pair").agg(F.sum("docs").alias("n")).select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n"), "pairs")
    most = counted.groupBy("a_id").agg(F.max("n").alias("most"))
    return stored(counted.join(most, "a_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks = align_chunks(docs, a_path, b_path, id_col, text_col, **how)
    counts = pair_counts(chunks).select((F.shiftleft("a_id", 32).bitwiseOR(F.col("b_id"))).alias("pair"), "n", "best")
    asked = chunks.where(F.size("pairs") > 0).select("chunk", F.posexplode("pairs").alias("place", "pair"))
    totals = asked.join(counts, "pair").select(F.col("chunk").alias("of_chunk"), "place", "n", "best")
    kind = chunks.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256").schema
    slim = chunks.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times")
    return slim.groupBy("chunk").cogroup(totals.groupBy("of_chunk")).applyInArrow(_sums, kind)
