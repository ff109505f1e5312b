"""Line deduplication with a log-template tree.

A line is its tokens (runs of non-space); tokens that hold a digit are variable fields and read `<*>`. The tree has a fixed
depth: a line descends by its number of tokens and its first LEAD tokens to a leaf. Within a leaf, a token is constant at
its position if at least `least` documents hold it there, else it reads `<*>`; the line so written is its template if
`constant` of its tokens are constant, otherwise the line is its own template. Templates of at least `min_tokens` tokens
that occur in at least `least` documents recur, and every line of theirs is dropped. `least` is `min_docs`, and LONG_DOCS
from LONG_TOKENS tokens on: a long passage that stands in two documents is no coincidence.

Each scan task joins its equal lines first (with their number of documents), so a line that all documents share leaves a
task once. Leaves are read in order of their lines; a leaf of up to LEAF_LINES distinct lines is parsed in its task. The
lines of a larger leaf leave the task unparsed, so memory is bounded: its (position, token) pairs are counted by a group-by
over all its lines and the constants are joined back, with the same result; a token that all lines of a leaf have is dealt
over many tasks. A leaf with more than a thousandth of all lines is not read by one task at all: its lines are dealt by
(leaf, line) and go the same way. Which lines to drop comes back by line digest
to (text digest, line number), with frequent lines and much copied texts dealt over many tasks; texts are joined at most
once, for the cleaned output.

Defined results: null text is empty; blank lines are kept and never templates; a document counts once for a line it
repeats, rows that repeat a document count as documents; order of the lines that stay is kept; other columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import HOT_SHARE, fresh, small_batches, spread_join, stored

LEAD, MIN_DOCS, MIN_TOKENS, CONSTANT = 4, 5, 4, 0.7
LONG_TOKENS, LONG_DOCS = 50, 2
TASK_LINES, LEAF_LINES, TASK_TEXTS = 100_000, 50_000, 500_000
FIELD = b"<*>"
_DIGITS = bytes.maketrans(b"0123456789", b"0" * 10)


def masked(line: bytes) -> list[bytes]:
    """A line's tokens with variable fields."""
    tokens = line.split()
    if b"0" in line.translate(_DIGITS):
        tokens = [FIELD if b"0" in t.translate(_DIGITS) else t for t in tokens]
    return tokens


def _digest(data: bytes) -> bytes:
    """A 128-bit digest: lines and templates are known by it."""
    return xxhash.xxh3_128_digest(data)


def leaf(tokens: list[bytes]) -> bytes:
    """Digest of the path of the tree."""
    return _digest(b"%d " % len(tokens) + b" ".join(tokens[:LEAD]))


def least_docs(n_tokens: int, min_docs: int) -> int:
    """Documents in which a line or template of so many tokens recurs."""
    return min(min_docs, LONG_DOCS) if n_tokens >= LONG_TOKENS else min_docs


def _lines(min_tokens: int):
    """Distinct lines of a task: leaf, line, number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for at in range(0, len(rows), 5000):
                lines = [x for x, _ in rows[at : at + 5000]]
                yield pa.RecordBatch.from_arrays([pa.array([leaf(x.split(b" ")) for x in lines], pa.binary()), pa.array(lines, pa.binary()), pa.array([n for _, n in rows[at : at + 5000]], pa.int64())], names=["leaf", "line", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                tokens = map(masked, text.split(b"\n"))
                held.update({b" ".join(t) for t in tokens if len(t) >= min_tokens})
            if len(held) > TASK_LINES:
                yield from out()
                held = Counter()
        yield from out()

    return run


def _template(x: bytes, tokens: list[bytes], fixed: list[bool], constant: float) -> bytes:
    return b" ".join(t if f else FIELD for t, f in zip(tokens, fixed, strict=True)) if sum(fixed) >= constant * len(tokens) else x


def templates(lines: dict[bytes, int], min_docs: int, constant: float) -> dict[bytes, bytes]:
    """Template of each line of a leaf, from the lines' numbers of documents."""
    split = {x: x.split(b" ") for x in lines}
    seen: Counter[tuple[int, bytes]] = Counter()
    for x, tokens in split.items():
        for k, t in enumerate(tokens):
            seen[k, t] += lines[x]
    found = {}
    for x, tokens in split.items():
        fixed = [t != FIELD and seen[k, t] >= min_docs for k, t in enumerate(tokens)]
        found[x] = _template(x, tokens, fixed, constant)
    return found


def _parse(min_docs: int, constant: float):
    """From rows in order of (leaf, line): line and template digests with the line's number of documents and the number at which it recurs.

    Of a leaf with more than LEAF_LINES lines: no template, but the leaf and the line itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, large, held, rows = None, False, {}, []

        def parsed() -> list[tuple]:
            least = least_docs(next(iter(held)).count(b" ") + 1, min_docs) if held else 0
            if large:
                return [(_digest(x), None, n, least, now, x) for x, n in held.items()]
            if sum(held.values()) < least:
                return []
            return [(_digest(x), _digest(b"T" + t), held[x], least, None, None) for x, t in templates(held, least, constant).items()]

        def out() -> pa.RecordBatch:
            types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["line", "template", "n", "least", "leaf", "tokens"])

        for b in batches:
            for where, x, n in zip(*(b.column(c).to_pylist() for c in ("leaf", "line", "n")), strict=True):
                if where != now or (len(held) >= LEAF_LINES and x not in held):
                    large = large or where == now
                    rows += parsed()
                    large = where == now
                    now, held = where, {}
                    if len(rows) > 20_000:
                        yield out()
                        rows = []
                held[x] = held.get(x, 0) + n
        rows += parsed()
        if rows:
            yield out()

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of lines that may be constant: leaf, position, token digest, line digest, number of documents and at which it is constant."""
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("leaf", "line", "n", "least", "tokens")), strict=True)
        placed = [(where, k, _digest(t), line, n, least) for where, line, n, least, x in rows for k, t in enumerate(x.split(b" ")) if t != FIELD]
        for at in range(0, len(placed), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*placed[at : at + 50_000], strict=True), (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["leaf", "at", "token", "line", "n", "least"])


def _joined(constant: float):
    """Line and template digests of lines, from the positions of their constants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, fixed in zip(b.column("tokens").to_pylist(), b.column("fixed").to_pylist(), strict=True):
                tokens, at = x.split(b" "), set(fixed or ())
                found.append(_digest(b"T" + _template(x, tokens, [k in at for k in range(len(tokens))], constant)))
            yield pa.RecordBatch.from_arrays([b.column("line"), pa.array(found, pa.binary()), b.column("n"), b.column("least")], names=["line", "template", "n", "least"])

    return run


def _large(lines: DataFrame, constant: float) -> DataFrame:
    """What _parse gives, for the lines of large leaves: documents of each (leaf, position, token) are counted over all lines of the leaf."""
    placed = lines.select("leaf", "line", "n", "least", "tokens").mapInArrow(_placed, "leaf binary, at long, token binary, line binary, n long, least long")
    key = ["leaf", "at", "token"]
    counted = stored(placed.groupBy(*key).agg(F.sum("n").alias("docs"), F.max("least").alias("least"), F.count("*").alias("n")), "constants")
    fixed = spread_join(placed.select(*key, "line"), counted.where("docs >= least").select(*key), key, "line", "left_semi", counted.select(*key, "n")).groupBy("line").agg(F.collect_list("at").alias("fixed"))
    return lines.select("line", "n", "least", "tokens").join(fixed, "line", "left").mapInArrow(_joined(constant), "line binary, template binary, n long, least long")


def _apart(min_docs: int):
    """Lines of a leaf that no task reads whole, as _parse hands on those of a large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b.column("line").to_pylist()
            least = [least_docs(x.count(b" ") + 1, min_docs) for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in lines], pa.binary()), b.column("n"), pa.array(least, pa.int64()), b.column("leaf"), b.column("line")], names=["line", "n", "least", "leaf", "tokens"])

    return run


def _numbered(min_tokens: int):
    """Line digests of each text: text digest, line number, line digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            if len(seen) > TASK_TEXTS:
                seen.clear()
            keys, at, lines = [], [], []
            for key, text in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                for k, x in enumerate(text.split(b"\n")):
                    if len(t := masked(x)) >= min_tokens:
                        keys.append(key)
                        at.append(k)
                        lines.append(_digest(b" ".join(t)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at, pa.int32()), pa.array(lines, pa.binary())], names=["text_key", "at", "line"])

    return run


def dropped_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, constant: float = CONSTANT) -> DataFrame:
    """(text_key, dropped): SHA-256 of a text and the numbers, from 0, of its lines whose template recurs."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    lines = stored(docs.select(text.alias("text")).mapInArrow(_lines(min_tokens), "leaf binary, line binary, n long"), "distinct")
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") > max(LEAF_LINES, HOT_SHARE * lines.count()))
    marked = lines.join(F.broadcast(sizes), "leaf", "left")  # fewer than 1 / HOT_SHARE leaves
    ordered = marked.where("lines is null").select("leaf", "line", "n").repartition("leaf").sortWithinPartitions("leaf", "line")
    parsed = stored(ordered.mapInArrow(_parse(min_docs, constant), "line binary, template binary, n long, least long, leaf binary, tokens binary"), "templates")
    apart = marked.where("lines is not null").groupBy("leaf", "line").agg(F.sum("n").alias("n")).mapInArrow(_apart(min_docs), "line binary, n long, least long, leaf binary, tokens binary")
    large = stored(parsed.where("tokens is not null").select("line", "n", "least", "leaf", "tokens").unionByName(apart), "large")
    parsed = stored(parsed.where("tokens is null").select("line", "template", "n", "least").unionByName(_large(large, constant)), "lines")
    recurring = parsed.groupBy("template").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least").select("template")
    bad = stored(spread_join(parsed, recurring, ["template"], "line", "left_semi").groupBy("line").agg(F.max("n").alias("n")), "recurring")
    numbered = docs.select(F.unhex(F.sha2(text, 256)).alias("text_key"), text.alias("text")).mapInArrow(_numbered(min_tokens), "text_key binary, at int, line binary")
    return spread_join(numbered, bad.select("line"), ["line"], "text_key", counted=bad).groupBy("text_key").agg(F.array_sort(F.collect_set("at")).alias("dropped"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped and dropped (line numbers from 0, in order)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")), "texts")
    joined = spread_join(slim, dropped_lines(docs, text_col, **how), ["text_key"], "doc_id", "left")
    none = F.array().cast("array<int>")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped")).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))


def drop_lines(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with the recurring lines taken out of its texts; all else, null texts too, as it was."""
    key, gone = fresh("text_key", docs.columns), fresh("dropped_lines", docs.columns)
    found = dropped_lines(docs, text_col, **how).withColumnsRenamed({"text_key": key, "dropped": gone})
    keyed = docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)))
    sizes = stored(keyed.groupBy(key).agg(F.count("*").alias("n")), "sizes")
    joined = spread_join(keyed, found, [key], next((c for c in docs.columns if c != text_col), text_col), "left", sizes)
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, k: ~F.array_contains(F.col(gone), k))
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
