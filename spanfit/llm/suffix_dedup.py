"""Removal of byte strings that occur more than once, by a sparse suffix array.

A window is a string of `length` bytes of a text; every byte under a window that also starts anywhere else goes. Sorting a
suffix for each byte of a corpus would move each byte hundreds of times, so suffixes begin at anchors: in each window the
place whose following K bytes have the least hash (the first of equal ones). Equal windows have the same anchor, so two
windows can only be equal if the suffixes at their anchors begin alike, and each window is looked at once, at its anchor.

1. A scan of the texts gives the anchors: the hash of the K bytes, the run of window starts that share the anchor, and two
   hashes of all bytes under that run (its context). Anchors whose K bytes are the only ones of the corpus are done, as none
   of their windows recurs; so are those whose whole context occurs again, as all of their windows do. Both are counts.
2. What is left, one row for each different context, is cut by the windows' distance from the anchor into blocks of BLOCK
   windows. A block's suffix begins with its core, the bytes that all of its windows share. Spark samples splitters and
   deals the suffixes by range of (core, what lies beyond it); a task sorts its bucket by multikey quicksort on 8-byte
   words, and within suffixes of one core compares the windows, which differ beyond the core only.
3. Buckets meet at a core: the first and the last core of a bucket may go on in the next ones. Their windows that have no
   partner in the bucket are compared across the boundaries by 128-bit hashes, with a group-by. So a core that very many
   suffixes share is spread over buckets, and no task holds more than its bucket.

Texts move twice, compressed: to the tasks that cut contexts out of them, and to those that join what stays. A text that
occurs n times moves once for each task that has read it.

Defined results: texts are bytes of UTF-8, null is the empty text; equal texts of `length` bytes or more lose everything;
texts shorter than `length` lose nothing; overlapping occurrences count; touching removed runs are one. Rows with equal or
null ids are rows of their own. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches, spread_join, stored

LENGTH, BLOCK = 200, 64
#: Bytes scanned at once, bytes of suffixes in a bucket, texts a task remembers.
SCAN_BYTES, BUCKET_BYTES, TASK_TEXTS = 2 << 20, 16 << 20, 500_000
_C1, _C2, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(32)


def seed_bytes(length: int) -> int:
    """K: a power of two, about a sixth of a window."""
    return 1 << max(0, (length // 4).bit_length() - 1)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of two strings from theirs; not linear, so no pattern of bytes cancels out."""
    h = (x ^ (x >> np.uint64(31))) * _C1 + y
    return (h ^ (h >> np.uint64(29))) * _C2


def _windows_hash(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of the strings of each size (powers of two) at each place of data, by doubling."""
    h, k, out = (data.astype(np.uint64) + np.uint64(1)) * _C1, 1, {}
    while True:
        if k in sizes:
            out[k] = h
        if k >= max(sizes):
            return [out[s] for s in sizes]
        h = _mix(h[:-k], h[k:]) if len(h) > k else h[:0]
        k *= 2


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one anchor: text, first and last start, anchor (all within the text), hash of the K bytes, hash of the context."""
    k = seed_bytes(length)
    q = 1 << (length.bit_length() - 1)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    small, large = _windows_hash(data, k, q)
    # Upper half of the hash, then the place, so the first of equal ones: both say the same in any scan.
    least = (small >> _HALF << _HALF) | np.arange(len(small), dtype=np.uint64)
    width, have = length - k + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    n = len(data) - length + 1
    least = np.minimum(least[:n], least[width - have : width - have + n])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.arange(n) + length <= np.repeat(ends, sizes)[:n]
    new = inside & np.concatenate([[True], (place[1:] != place[:-1]) | ~inside[:-1]])
    last = inside & np.concatenate([(place[1:] != place[:-1]) | ~inside[1:], [True]])
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    at = place[lo]
    text = np.searchsorted(ends, lo, side="right")
    context = _mix(_mix(large[lo], large[lo + length - q]), _mix(large[hi], large[hi + length - q]))
    context = _mix(context, ((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64))
    base = (ends - sizes)[text]
    return text, lo - base, hi - base, at - base, small[at], context


_ANCHORS = "uid long, doc_id {id}, k1 long, k2 long, n_bytes long, sha string, g array<long>, c array<long>, run array<long>"


def pack(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A run in one number: runs and the way to the anchor are shorter than a window (below 2^12)."""
    return lo << 24 | (hi - lo) << 12 | (at - lo)


def unpack(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = run >> 24
    return lo, lo + (run >> 12 & 0xFFF), lo + (run & 0xFFF)


def _scan(length: int, scan_bytes: int):
    """Anchors of each text. A text longer than a scan is scanned in pieces that overlap by a window; runs that a piece ends are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = [len(x) for x in texts]
            at = 0
            while at < len(texts):
                end, held = at + 1, sizes[at]
                while end < len(texts) and held + sizes[end] <= scan_bytes:
                    held += sizes[end]
                    end += 1
                if held <= scan_bytes:
                    text, lo, hi, place, g, c = anchors(texts[at:end], length)
                else:
                    starts = range(0, held, scan_bytes)
                    parts = [anchors([texts[at][k : k + scan_bytes + length - 1]], length) for k in starts]
                    text, lo, hi, place, g, c = (np.concatenate([p[f] + (k if 1 <= f <= 3 else 0) for p, k in zip(parts, starts, strict=True)]) if f < 4 else np.concatenate([p[f] for p in parts]) for f in range(6))
                offsets = pa.array(np.searchsorted(text, np.arange(end - at + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (g.view(np.int64), c.view(np.int64), pack(lo, hi, place))]
                rows = b.slice(at, end - at)
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in texts[at:end]])
                yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in ("uid", "doc_id", "k1", "k2")), pa.array(sizes[at:end], pa.int64()), sha, *lists], names=["uid", "doc_id", "k1", "k2", "n_bytes", "sha", "g", "c", "run"])
                at = end

    return run


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of a task's equal texts, compressed."""
    seen, packer = set(), zstandard.ZstdCompressor(level=3)
    for b in batches:
        if len(seen) > TASK_TEXTS:
            seen.clear()
        keep, packed = [], []
        for k, (key, text) in enumerate(zip(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True), b.column("text").to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(k)
                packed.append(packer.compress(text))
        rows = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("k1"), rows.column("k2"), pa.array(packed, pa.binary())], names=["k1", "k2", "packed"])


_SUFFIX = "owner long, run long, block int, core binary, before binary, after binary, n long"


def _suffixes(length: int, block: int):
    """From a packed text and its contexts (owner, run, n): for each block the core, its owned windows' bytes before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdDecompressor()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        for b in batches:
            out = []

            def cut() -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) or [[]] * 7
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["owner", "run", "block", "core", "before", "after", "n"])

            for packed, owner, contexts in zip(b.column("packed").to_pylist(), b.column("uid").to_pylist(), b.column("contexts").to_pylist(), strict=True):
                text = packer.decompress(packed) if contexts else b""
                for context in contexts:
                    (lo, hi, at), n = (int(x) for x in unpack(np.int64(context["run"]))), context["n"]
                    for k in range((at - hi) // block, (at - lo) // block + 1):
                        far, near = min(at - lo, (k + 1) * block - 1), max(at - hi, k * block)  # the farthest and nearest owned start
                        begin, end = at - k * block, at - (k + 1) * block + 1 + length
                        out.append((owner, context["run"], k, text[begin:end], text[at - far : begin], text[end : at - near + length], n))
                    if len(out) >= 4000:
                        yield cut()
            yield cut()

    return run


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and for each row in that order whether it equals the one before.

    Each round splits every open group at a pivot in the word that the group has come to: rows below it, equal to it, above
    it. The equal ones go on with the next word. Groups of one row, and groups equal in all words, are closed.
    """
    n, depth = words.shape
    order = np.arange(n)
    group, level = np.zeros(n, np.int64), np.zeros(n, np.int64)  # by place in the order
    open_at = np.arange(n) if n > 1 and depth else np.zeros(0, np.int64)
    while len(open_at):
        g = group[open_at]
        begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(begins, len(g)))
        value = words[order[open_at], level[open_at]]
        three = np.stack([value[begins], value[begins + sizes // 2], value[begins + sizes - 1]])
        pivot = np.repeat(np.sort(three, axis=0)[1], sizes)
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        key = np.repeat(np.arange(len(begins)), sizes) * 3 + side
        by = np.argsort(key, kind="stable")
        order[open_at] = order[open_at[by]]
        key = key[by]
        level[open_at] += key % 3 == 1
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        held = np.diff(np.append(first, len(key)))
        group[open_at] = np.repeat(open_at[first], held)  # a group's name is its first place
        open_at = open_at[(np.repeat(held, held) > 1) & (level[open_at] < depth)]
    same = np.concatenate([[False], group[1:] == group[:-1]]) if n else np.zeros(0, bool)
    return order, same


def _words(strings: list[bytes]) -> np.ndarray:
    """Equally long strings as big-endian words."""
    size = -(-len(strings[0]) // 8) * 8
    return np.frombuffer(b"".join(x.ljust(size, b"\0") for x in strings), ">u8").reshape(len(strings), -1).astype(np.uint64)


def _ladder(strings: list[bytes], most: int, backwards: bool) -> np.ndarray:
    """Hashes of the first (backwards: last) 0..most bytes of each string, shape (strings, most + 1); too short ones go on with zeros."""
    out = np.empty((len(strings), most + 1), np.uint64)
    out[:, 0] = _C1
    if not most:
        return out
    flat = b"".join(x.rjust(most, b"\0")[::-1] if backwards else x.ljust(most, b"\0") for x in strings)
    data = np.frombuffer(flat, np.uint8).reshape(len(strings), most)
    for k in range(most):
        out[:, k + 1] = _mix(out[:, k], data[:, k].astype(np.uint64) + np.uint64(1))
    return out


_FOUND = "owner long, run long, block int, least int, most int, h1 long, h2 long, n long"


def _compare(length: int, block: int):
    """A bucket's result: per suffix the least and greatest distance (start before the anchor) of its windows that recur in the bucket. Windows of the first and last core without a partner: one row each with its hashes, and each window of these cores that has one without an owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        cores = rows.column("core").to_pylist()
        order, same = multikey_quicksort(_words(cores))
        rows = rows.take(pa.array(order))
        core = np.cumsum(~same)  # from 1 in order
        owner, runs, k, n = (rows.column(c).to_numpy() for c in ("owner", "run", "block", "n"))
        before, after = rows.column("before").to_pylist(), rows.column("after").to_pylist()
        # Windows of blocks with other numbers differ in where the anchor lies and so are never equal.
        alone = np.bincount(core, weights=n, minlength=core[-1] + 1)[core] < 2
        edge = (core == 1) | (core == core[-1])
        some = np.flatnonzero(~alone | edge)
        left, right = np.array([len(x) for x in before])[some], np.array([len(x) for x in after])[some]
        found = np.full((2, len(order)), -1)
        columns = []
        if len(some):
            back = _ladder([before[i] for i in some], block - 1, True)
            on = _ladder([after[i] for i in some], block - 1, False)
            names = {c: xxhash.xxh3_128_intdigest(cores[order[int(np.searchsorted(core, c))]]) for c in {1, int(core[-1])}}
            for t in range(block):  # the window begins t bytes before the core
                own = np.flatnonzero((left >= t) & (right >= block - 1 - t))
                if not len(own):
                    continue
                at = some[own]
                key = np.stack([core[at].astype(np.uint64) << np.uint64(20) | k[at].astype(np.uint64) & np.uint64(0xFFFFF), back[own, t], on[own, block - 1 - t]], axis=1)
                by = np.lexsort(key.T)
                new = np.concatenate([[True], (key[by][1:] != key[by][:-1]).any(axis=1)])
                of = np.cumsum(new) - 1
                total = np.zeros(of[-1] + 1, np.int64)
                np.add.at(total, of, n[at[by]])
                twice = np.empty(len(at), bool)
                twice[by] = total[of] >= 2
                d = k[at] * block + t
                found[0, at[twice]] = np.where(found[0, at[twice]] < 0, d[twice], np.minimum(found[0, at[twice]], d[twice]))
                found[1, at[twice]] = np.maximum(found[1, at[twice]], d[twice])
                # Across boundaries: one row for each different window of the first and last core.
                lead = np.flatnonzero(edge[at[by]] & new)
                if len(lead):
                    a = at[by][lead]
                    h = [np.array([names[c] >> s & 0xFFFFFFFFFFFFFFFF for c in core[a].tolist()], np.uint64) for s in (0, 64)]
                    w = _mix(_mix(back[own[by][lead], t], on[own[by][lead], block - 1 - t]), np.full(len(a), t, np.uint64) + (k[a].astype(np.uint64) << np.uint64(8)))
                    columns.append((np.where(twice[by][lead], -1, owner[a]), runs[a], k[a], d[by][lead], _mix(h[0], w), _mix(h[1], w ^ _C2), total[of[lead]]))
        has = np.flatnonzero(found[0] >= 0)
        zeros = np.zeros(len(has), np.int64)
        parts = [(owner[has], runs[has], k[has], found[0, has], found[1, has], zeros, zeros, zeros)]
        parts += [(o, r, b, d, d, h1.view(np.int64), h2.view(np.int64), total) for o, r, b, d, h1, h2, total in columns]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, kinds, strict=True)], names=["owner", "run", "block", "least", "most", "h1", "h2", "n"])

    return run


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Touching and overlapping spans (begin, end) made one, in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])], axis=1)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each text."""
    packer = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for k1, k2, packed, begins, ends in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "packed", "begins", "ends")), strict=True):
            text = packer.decompress(packed)
            spans = merge_spans(np.array([begins, ends], np.int64).T).tolist()
            cuts = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))
            out.append((k1, k2, len(text) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["k1", "k2", "n_removed", "n_spans", "kept", "kept_sha256"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("suffix"), text).alias("k2"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, scan_bytes: int = SCAN_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows: uid, doc_id, k1, k2, n_bytes, sha), one for each input row, and (k1, k2, begins, ends): the spans of texts that have any, by the texts' keys, not merged."""
    small_batches(docs.sparkSession)
    if not 1 <= block <= length < 4096:
        raise ValueError("a window has 1 to 4095 bytes, a block at most as many windows")
    texts = _texts(docs, id_col, text_col)
    kind = _ANCHORS.format(id=texts.schema["doc_id"].dataType.simpleString())
    rows = stored(texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_scan(length, scan_bytes), kind), "anchors")

    each = rows.select("uid", F.explode(F.arrays_zip("g", "c", "run")).alias("x")).select("uid", "x.g", "x.c", "x.run")
    seeds = stored(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "seeds")
    some = stored(spread_join(each, seeds.select("g"), ["g"], "uid", counted=seeds), "candidates")
    counts = stored(some.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("uid", "run")).alias("rep")), "contexts")
    # Of contexts that recur all anchors are done. Others wait for their windows, if their K bytes have several contexts.
    again = spread_join(some, counts.where("n > 1").select("g", "c"), ["g", "c"], "uid", counted=counts.select("g", "c", "n")).select("uid", "run")
    kinds = stored(counts.groupBy("g").agg(F.count("*").alias("n")), "kinds")
    open_ = stored(spread_join(counts, kinds.where("n > 1").select("g"), ["g"], "c", counted=kinds).select("rep.uid", "rep.run", "n"), "open")

    keys = rows.select("uid", "k1", "k2")
    contexts = open_.join(keys, "uid").groupBy("k1", "k2").agg(F.min("uid").alias("uid"), F.collect_list(F.struct("run", "n")).alias("contexts"))
    packed = texts.mapInArrow(_packed_texts, "k1 long, k2 long, packed binary")
    suffixes = packed.join(contexts, ["k1", "k2"]).select("packed", "uid", "contexts").mapInArrow(_suffixes(length, block), _SUFFIX)
    # A context has some three windows' length in suffixes.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-open_.count() * 4 * length // bucket_bytes))
    found = stored(suffixes.repartitionByRange(buckets, "core", "before", "after", "owner").mapInArrow(_compare(length, block), _FOUND), "found")

    edges = found.where("n > 0")
    across = edges.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where("all > 1")
    met = edges.where("owner >= 0").join(across, ["h1", "h2"], "left_semi").select("owner", "run", "least", "most")
    both = found.where("n = 0").select("owner", "run", "least", "most").unionByName(met).groupBy("owner", "run").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    anchor = F.shiftright("run", 24) + F.col("run").bitwiseAND(0xFFF)
    lo = F.shiftright("run", 24)
    spans = both.select(F.col("owner").alias("uid"), (anchor - F.col("most")).alias("begin"), (anchor - F.col("least") + length).alias("end"))
    spans = spans.unionByName(again.select("uid", lo.alias("begin"), (lo + F.shiftright("run", 12).bitwiseAND(0xFFF) + length).alias("end")))
    first = keys.groupBy("k1", "k2").agg(F.min("uid").alias("uid"))
    by_text = spans.join(first, "uid").groupBy("k1", "k2").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    return rows.select("uid", "doc_id", "k1", "k2", "n_bytes", "sha"), by_text


def kept_texts(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept, kept_sha256) of each text that loses bytes; equal texts may come several times."""
    packed = _texts(docs, id_col, text_col).mapInArrow(_packed_texts, "k1 long, k2 long, packed binary")
    return packed.join(spans, ["k1", "k2"]).mapInArrow(_keep, "k1 long, k2 long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def suffix_report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans = repeated_spans(docs, length, id_col=id_col, text_col=text_col, **how)
    lost = stored(kept_texts(docs, spans, id_col, text_col).drop("kept").dropDuplicates(["k1", "k2"]), "lost")
    copies = stored(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")), "copies")
    joined = spread_join(rows, copies.drop("n").join(lost, ["k1", "k2"], "left"), ["k1", "k2"], "uid", counted=copies)
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
