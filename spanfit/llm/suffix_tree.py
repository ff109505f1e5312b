"""Language-model scores from a probabilistic suffix tree.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end per text. Every token is counted in the
training texts; the base score of a token is log10((c + 1) / (N + 1 * (V + 1))).

The tree predicts the next symbol: END, one of the frequent words (at least WORD_SHARE of all tokens), or RARE, all other
words, unseen ones among them. A word then has probability
  p(word | s) = base(word) * p(symbol | s) / root(symbol),   root(symbol): base probabilities summed over its words,
and RARE holds each rare known word with c + 1 and the unseen word with 1, so that in every state the known words, the end
and the unseen word add up to 1. A context s is
  * up to DEPTH symbols whose last is a frequent word, or a class of rare words alone (by the last two bytes), or
  * a rare word itself, or a rare word with the symbol before it.
A context is a candidate if it makes up STATE_SHARE of the training tokens (first kind) or stands there MIN_STATE times
(second kind). It becomes a state if the divergence of its next-symbol distribution from that of its longest suffix among
the states, times its count, exceeds COST nats for each symbol that it lists (a likelihood-ratio test). DISCOUNT is taken
from each listed count, and the mass that is left (discounts and unlisted symbols) goes to the distribution of the suffix,
in the end to the root. Scores use the longest state.

The first kind is bounded by 1 / share at any corpus size, so it may be sent to all tasks. The second kind grows with the
corpus and is never sent or collected: a chunk of texts posts each of its rare words once, with place, symbol before and
symbol after of each occurrence; a word's postings meet in one task, which counts the word, tests its contexts and hands
back what it adds to each text, one row for each chunk. No rare word has more than WORD_SHARE of all tokens; a word whose
occurrences exceed TASK_TOKENS waits in a task-private file while it is counted.

Words are compared by themselves, those longer than 16 bytes by a 128-bit digest.

Defined results: null text is empty and has one token, the end; a null id is treated as the empty string in the split;
repeated rows train and score as often as they stand; with no training text N = V = 0. Empty tables give empty results.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches, stored

DEPTH, ENDINGS = 3, 512
WORD_SHARE, STATE_SHARE, ENTRY_SHARE, MIN_STATE, MIN_ENTRY, DISCOUNT, COST = 1 / 4096, 2e-5, 2e-6, 16, 2, 0.75, 2.0
BEGIN, END, RARE, FIRST = 0, 1, 2, 3
BITS = 13
CHUNK_TOKENS, CHUNK_TEXTS, TASK_TOKENS = 4_000_000, 65_536, 1_000_000
TASK_WORDS = 500_000

_MOVED = "word binary, class int, chunk long, places binary, before binary, after binary, train binary, rows binary"
_MOVED_TYPES = pa.schema([("word", pa.binary()), ("class", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("places", "before", "after", "train", "rows"))])
_SUM = "chunk long, places binary, base binary, known binary, gain binary, rows binary"
_SUM_TYPES = pa.schema([("chunk", pa.int64()), *((c, pa.binary()) for c in ("places", "base", "known", "gain", "rows"))])
_TEXT = np.dtype([("doc_id", np.int64), ("no_id", np.bool_), ("held_out", np.bool_), ("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("gain", np.float64)])


def word_key(word: bytes) -> bytes:
    return word if len(word) <= 16 else b"#" + xxhash.xxh3_128_digest(word)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their counts; the empty word is the end."""
    held: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for w, n in held.items():
            found[word_key(w)] += n
        words, counts = list(found), list(found.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b.column("text").to_pylist():
            held.update(text.lower().split())
            held[b""] += 1
            if len(held) > TASK_WORDS:
                yield from out()
                held.clear()
    yield from out()


@dataclass
class Words:
    """The frequent words with their counts, and the totals N and V."""

    counts: dict[bytes, int]
    n_all: int
    n_words: int
    ends: int
    frequent: dict[bytes, int] = field(init=False)
    root: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.frequent = {w: FIRST + k for k, w in enumerate(self.counts)}
        mass = np.zeros(FIRST + len(self.counts))
        mass[FIRST:] = [c + 1 for c in self.counts.values()]
        mass[END] = self.ends + (self.n_all > 0)
        mass[RARE] = self.n_all + self.n_words + 1 - mass.sum()
        self.root = mass / (self.n_all + self.n_words + 1)
        if not self.n_all:
            self.root[END] = self.root[RARE]  # nothing known: the end is the unseen token

    @property
    def classes(self) -> int:
        """Symbol of the first class of rare words."""
        return FIRST + len(self.counts)

    def symbol(self, word: bytes) -> int:
        """A frequent word's symbol, or a class."""
        found = self.frequent.get(word_key(word))
        return self.classes + ending(word) if found is None else found

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n_all + 1 * (self.n_words + 1)))


class Symbols(dict):
    """Symbol of a word; words met are kept until there are too many."""

    def __init__(self, words: Words) -> None:
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TASK_WORDS:
            self.clear()
        self[word] = found = self.words.symbol(word)
        return found


def _symbols(words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Symbols(words)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                split = text.lower().split()
                s = np.full(len(split) + 1, END, np.uint16)
                s[:-1] = np.fromiter(map(of.__getitem__, split), np.uint16, len(split))
                rows.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["symbols"])

    return run


def _sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of some texts with BEGIN before each, and where each text's BEGIN is."""
    n = np.array([len(t) // 2 + 1 for t in texts])
    return np.frombuffer(b"".join(b"\0\0" + t for t in texts), np.uint16).astype(np.int64), np.cumsum(n) - n


def _contexts(flat: np.ndarray, begin: np.ndarray, depth: int, classes: int) -> np.ndarray:
    """Per position: the key of its `depth` symbols before; -1 if a text begins within, or beyond a class of rare words."""
    n = len(flat)
    age = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    key = np.zeros(n, np.int64)
    for d in range(depth, 0, -1):
        key = (key << BITS) | np.concatenate([np.zeros(min(d, n), np.int64), flat[: max(0, n - d)]])
    ok = age >= depth
    if depth > 1:
        ok &= (key & ((1 << BITS) - 1)) < classes
    return np.where(ok, key, -1)


def _predicted(flat: np.ndarray, classes: int) -> np.ndarray:
    return np.where(flat >= classes, RARE, flat)


def _count(depth: int, candidates: np.ndarray | None, classes: int):
    """n-grams (context, symbol) of the candidate contexts, counted within a task."""

    def flush(texts: list[bytes]) -> pa.RecordBatch:
        flat, begin = _sequence(texts)
        context = _contexts(flat, begin, depth, classes)
        ok = (context >= 0) & (flat != BEGIN)
        if candidates is not None:
            ok[ok] = np.isin(context[ok], candidates)
        grams, n = np.unique((context[ok] << BITS) | flat[ok], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for b in batches:
            for s in b.column("symbols").to_pylist():
                texts.append(s)
                size += len(s) // 2
                if size > CHUNK_TOKENS:
                    yield flush(texts)
                    texts, size = [], 0
        if texts:
            yield flush(texts)

    return run


def retain(at: np.ndarray, n: np.ndarray, below: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts with totals, from the counts that they list (at: whose) and the probabilities below:
    value of each listed symbol, mass left to the suffix, and which contexts pass the test."""
    k = len(total)
    value = (n - DISCOUNT) / total[at]
    left = 1 - np.bincount(at, value, k)
    listed = np.bincount(at, minlength=k)
    p = n / total[at]
    divergence = np.bincount(at, p * np.log(p / below), k)
    rest_p, rest_q = np.maximum(1 - np.bincount(at, n, k) / total, 0), np.maximum(1 - np.bincount(at, below, k), 1e-12)
    divergence = divergence + np.where(rest_p > 0, rest_p * np.log(np.maximum(rest_p, 1e-300) / rest_q), 0)
    return value, left, (total * divergence > COST * (1 + listed)) & (listed > 0)


@dataclass
class Tree:
    """States and entries of each depth, sorted by key; root probabilities of symbols."""

    root: np.ndarray
    states: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    entries: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def probability(self, contexts: list[np.ndarray], symbol: np.ndarray) -> np.ndarray:
        """p(symbol | the longest state that ends the context); contexts: keys of 1, 2 ... symbols."""
        p = self.root[symbol].copy()
        for key, (keys, left), (grams, value) in zip(contexts, self.states, self.entries, strict=False):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = np.flatnonzero(keys[at] == key)
            p[here] *= left[at[here]]
            if len(grams):
                gram = (key[here] << BITS) | symbol[here]
                e = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                p[here] += np.where(grams[e] == gram, value[e], 0.0)
        return p

    def grow(self, keys: np.ndarray, total: np.ndarray, grams: np.ndarray, n: np.ndarray) -> None:
        """Adds the states of the next depth: contexts with totals, and the n-grams that they list with counts."""
        depth = len(self.states) + 1
        order = np.argsort(keys)
        keys, total = keys[order], total[order]
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        at = np.searchsorted(keys, grams >> BITS)
        ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == grams >> BITS) if len(keys) else np.zeros(len(grams), bool)
        grams, n, at = grams[ok], n[ok], at[ok]
        if not len(at):
            self.states.append((np.zeros(0, np.int64), np.zeros(0)))
            self.entries.append((np.zeros(0, np.int64), np.zeros(0)))
            return
        shorter = [(grams >> BITS) & ((1 << BITS * d) - 1) for d in range(1, depth)]
        value, left, keep = retain(at, n, self.probability(shorter, grams & ((1 << BITS) - 1)), total)
        self.states.append((keys[keep], left[keep]))
        self.entries.append((grams[keep[at]], value[keep[at]]))


def _arrays(rows: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table of bounded size."""
    found = rows.select(*names).toArrow()
    return [found.column(c).to_numpy() for c in names]


def grow_tree(symbols: DataFrame, words: Words, depth: int = DEPTH, state_share: float = STATE_SHARE, entry_share: float = ENTRY_SHARE) -> Tree:
    """The states of the first kind (symbols: a row of two-byte symbols per training text). The shares bound all that is collected."""
    tree, candidates, least = Tree(words.root), None, max(2.0, state_share * words.n_all)
    symbol = F.col("gram").bitwiseAND((1 << BITS) - 1)
    for d in range(1, depth + 1):
        grams = stored(symbols.mapInArrow(_count(d, candidates, words.classes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
        contexts = grams.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        keys, total = _arrays(contexts, "context", "n")
        predicted = F.when(symbol >= words.classes, RARE).otherwise(symbol)
        listed = grams.groupBy(F.shiftleft(F.shiftright("gram", BITS), BITS).bitwiseOR(predicted.cast("long")).alias("gram")).agg(F.sum("n").alias("n"))
        tree.grow(keys, total, *_arrays(listed.where(F.col("n") >= max(2.0, entry_share * words.n_all)), "gram", "n"))
        candidates = np.sort(_arrays(grams.where((F.col("n") >= least) & (symbol < words.classes)), "gram")[0])
        if not len(candidates):
            break
    return tree


def _post(words: Words, tree: Tree):
    """Per chunk of texts: a row with what its frequent words and states of the first kind give each text, and a posting row of each rare word."""
    base_of = words.base(np.array([0, words.ends, 0, *words.counts.values()], np.float64))

    def chunk_rows(chunk: int, ids: dict[bytes, int], texts: list[np.ndarray], doc: list, held: list) -> Iterator[pa.RecordBatch]:
        names = list(ids)
        of_word = np.fromiter(map(words.symbol, names), np.uint16, len(names))
        n = np.array([len(t) + 1 for t in texts])
        begin = np.cumsum(n + 1) - (n + 1)
        size = int((n + 1).sum())
        flat = np.full(size, END, np.uint16)
        flat[begin] = BEGIN
        local = np.concatenate([np.full(1, -1, np.int32), *(x for t in texts for x in (t, np.full(2, -1, np.int32)))])[:size]
        inner = local >= 0
        flat[inner] = of_word[local[inner]]
        place = np.repeat(np.arange(len(texts), dtype=np.uint16), n + 1)
        rows = np.zeros(len(texts), _TEXT)
        rows["no_id"], rows["doc_id"] = [d is None for d in doc], [d or 0 for d in doc]
        rows["held_out"], rows["n_tokens"] = held, n
        lo = 0
        while lo < len(texts):  # some texts at a time
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + TASK_TOKENS // 2)))
            own = slice(begin[lo], begin[hi] if hi < len(texts) else size)
            at, where = begin[lo:hi] - begin[lo], place[own].astype(np.int64) - lo
            part = flat[own].astype(np.int64)
            symbol = _predicted(np.where(part == BEGIN, END, part), words.classes)
            p = tree.probability([_contexts(part, at, d + 1, words.classes) for d in range(len(tree.states))], symbol)
            gain = np.log10(p / tree.root[symbol])
            gain[at] = 0
            common = (symbol != RARE) & (part != BEGIN)
            rows["n_known"][lo:hi] = np.bincount(where[common], minlength=hi - lo) - (words.ends == 0)
            rows["base"][lo:hi] = np.bincount(where[common], base_of[symbol[common]], hi - lo)
            rows["gain"][lo:hi] = np.bincount(where, gain, hi - lo)
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, chunk, None, None, None, None, rows.tobytes()], _MOVED_TYPES.types, strict=True)], schema=_MOVED_TYPES)

        at = np.flatnonzero(flat >= words.classes)
        at = at[np.argsort(local[at], kind="stable")]
        own = local[at]
        columns = [place[at], flat[at - 1], _predicted(flat[at + 1], words.classes).astype(np.uint16), ~np.array(held, bool)[place[at]]]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(own))
        for k in range(0, len(starts), 50_000):
            first, last = starts[k : k + 50_000], stops[k : k + 50_000]
            ends = np.append(first, last[-1]) - first[0]
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((x.itemsize * ends).astype(np.int32)), pa.py_buffer(x[first[0] : last[-1]].tobytes())]) for x in columns]
            keys = pa.array([word_key(names[j]) for j in own[first].tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, pa.array(of_word[own[first]].astype(np.int32)), pa.array(np.full(len(first), chunk)), *packed, pa.nulls(len(first), pa.binary())], schema=_MOVED_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, texts, doc, held, size = {}, [], [], [], 0
        for b in batches:
            for i, text, h in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True):
                split = text.lower().split()
                if texts and (size + len(split) > CHUNK_TOKENS or len(texts) == CHUNK_TEXTS):
                    yield from chunk_rows(chunk, ids, texts, doc, held)
                    ids, texts, doc, held, size = {}, [], [], [], 0
                    chunk += 1
                texts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in split), np.int32, len(split)))
                doc.append(i)
                held.append(h)
                size += len(split) + 1
        if texts:
            yield from chunk_rows(chunk, ids, texts, doc, held)

    return run


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a packed column, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def _sums(chunk: np.ndarray, place: np.ndarray, base: np.ndarray, known: np.ndarray, gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each chunk: places of its texts and the sums there."""
    order = np.lexsort((place, chunk))
    chunk, place = chunk[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (place[1:] != place[:-1])]))
    sums = [np.add.reduceat(x[order], first) for x in (base, known, gain)]
    chunk, place = chunk[first], place[first]
    cut = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(chunk))
    columns = (place, sums[0], sums[1].astype(np.int32), sums[2])
    for k in range(0, len(cut) - 1, 1000):
        own = cut[k : k + 1001]
        packed = [pa.array([x[lo:hi].tobytes() for lo, hi in zip(own[:-1], own[1:], strict=True)], pa.binary()) for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array(chunk[own[:-1]]), *packed, pa.nulls(len(own) - 1, pa.binary())], schema=_SUM_TYPES)


class Occurrences:
    """Posting rows unpacked: numbers and names of the rows' words, and row, place, triple (before, symbol after) and use of each occurrence."""

    def __init__(self, rows: pa.Table) -> None:
        named = rows.column("word").combine_chunks().dictionary_encode()
        self.names = len(named.dictionary)
        self.chunk = rows.column("chunk").to_numpy()
        place, before, after, train = (_flat(rows.column(c).combine_chunks(), k) for c, k in (("places", np.uint16), ("before", np.uint16), ("after", np.uint16), ("train", np.bool_)))
        of_row = named.indices.to_numpy().astype(np.int64)
        self.row, self.place, self.train = np.repeat(np.arange(len(of_row)), place[1]), place[0], train[0]
        self.word = of_row[self.row]
        self.key = (self.word << 2 * BITS) | (before[0].astype(np.int64) << BITS) | after[0]
        self.classes = np.zeros(self.names, np.int64)
        self.classes[of_row] = rows.column("class").to_numpy()

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys (word, before, after) and their training counts."""
        keys, own = np.unique(self.key, return_inverse=True)
        return keys, np.bincount(own, self.train, len(keys)).astype(np.int64)


class RareStates:
    """States of the second kind of some rare words (with their classes), from sorted keys (word, before, after) and training counts.

    gain: what the longest state adds to log10 of the probability after the word's class, for each key.
    """

    def __init__(self, classes: np.ndarray, keys: np.ndarray, n: np.ndarray, tree: Tree, min_state: int) -> None:
        word, after = keys >> 2 * BITS, keys & ((1 << BITS) - 1)
        self.keys, self.count = keys, np.bincount(word, n, len(classes))
        floor = tree.probability([classes[word]], after)
        p = floor
        for context in (word, keys >> BITS):
            names, place = np.unique(context, return_inverse=True)
            total = np.bincount(place, n, len(names))
            grams, own = np.unique((place << BITS) | after, return_inverse=True)
            each, at, below = np.bincount(own, n, len(grams)), grams >> BITS, np.zeros(len(grams))
            below[own] = p
            listed = (each >= MIN_ENTRY) & (total[at] >= min_state)
            value, left, keep = retain(at[listed], each[listed], below[listed], np.maximum(total, 1))
            added = np.zeros(len(grams))
            added[listed] = value
            p = np.where(keep[at], left[at] * below + added, below)[own]
        self.gain = np.log10(p / floor)

    def sums(self, met: Occurrences, words: Words) -> Iterator[pa.RecordBatch]:
        c = self.count[met.word]
        yield from _sums(met.chunk[met.row], met.place, words.base(c), (c > 0).astype(np.int64), self.gain[np.searchsorted(self.keys, met.key)])


class LongWord:
    """A word with very many occurrences: its rows wait in a file of this task while they are counted."""

    def __init__(self, word: bytes, schema: pa.Schema) -> None:
        self.word, self.file = word, tempfile.TemporaryFile()
        self.sink = pa.ipc.new_stream(self.file, schema)
        self.keys, self.n, self.classes = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def add(self, rows: pa.Table) -> None:
        if not rows.num_rows:
            return
        self.sink.write_table(rows)
        met = Occurrences(rows)
        keys, n = met.triples()
        self.classes = met.classes
        self.keys, own = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.n = np.bincount(own, np.concatenate([self.n, n]), len(self.keys)).astype(np.int64)

    def sums(self, words: Words, tree: Tree, min_state: int) -> Iterator[pa.RecordBatch]:
        found = RareStates(self.classes, self.keys, self.n, tree, min_state)
        self.sink.close()
        self.file.seek(0)
        for b in pa.ipc.open_stream(self.file):
            yield from found.sums(Occurrences(pa.Table.from_batches([b])), words)
        self.file.close()


def _rare(words: Words, tree: Tree, min_state: int):
    """From posting rows in order of word: what rare words add to each text, a row for each chunk and stretch of words. Rows of texts pass."""

    def stretch(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole words."""
        met = Occurrences(rows)
        yield from RareStates(met.classes, *met.triples(), tree, min_state).sums(met, words)

    def size_of(rows: pa.Table) -> int:
        return sum(_flat(c, np.uint16)[1].sum() for c in rows.column("places").chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, long = [], 0, None
        for b in batches:
            is_text = b.column("word").is_null()
            texts, rows = b.filter(is_text), pa.Table.from_batches([b.filter(pc.invert(is_text))])
            if texts.num_rows:
                yield pa.RecordBatch.from_arrays([texts.column("chunk"), *(pa.nulls(texts.num_rows, pa.binary()) for _ in range(4)), texts.column("rows")], schema=_SUM_TYPES)
            if long is not None and rows.num_rows:
                same = pc.equal(rows.column("word"), long.word)
                long.add(rows.filter(same))
                rows = rows.filter(pc.invert(same))
                if rows.num_rows:
                    yield from long.sums(words, tree, min_state)
                    long = None
            if not rows.num_rows:
                continue
            held.append(rows)
            size += size_of(rows)
            if size > TASK_TOKENS:
                rows = pa.concat_tables(held)
                last = rows.column("word")[-1].as_py()
                same = pc.equal(rows.column("word"), last)
                whole, rest = rows.filter(pc.invert(same)), rows.filter(same)
                if whole.num_rows:
                    yield from stretch(whole)
                held, size = [rest], size_of(rest)
                if size > TASK_TOKENS:
                    long = LongWord(last, rest.schema)
                    long.add(rest)
                    held, size = [], 0
        if long is not None:
            yield from long.sums(words, tree, min_state)
        if held:
            yield from stretch(pa.concat_tables(held))

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of chunk: each text's row with the sums of its chunk added, one chunk at a time."""
    now, texts, sums = None, [], []

    def out() -> pa.RecordBatch:
        t = np.concatenate([np.frombuffer(x, _TEXT) for x in texts]).copy()
        for places, base, known, gain in sums:
            t["base"][places] += base
            t["n_known"][places] += known
            t["gain"][places] += gain
        return pa.RecordBatch.from_arrays([pa.array(t["doc_id"], mask=t["no_id"]), pa.array(t["held_out"]), *(pa.array(t[c]) for c in ("n_tokens", "n_known", "base")), pa.array(t["base"] + t["gain"])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    for b in batches:
        for chunk, places, base, known, gain, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if chunk != now and now is not None:
                yield out()
                texts, sums = [], []
            now = chunk
            if rows is not None:
                texts.append(rows)
            else:
                sums.append((np.frombuffer(places, np.uint16), np.frombuffer(base), np.frombuffer(known, np.int32), np.frombuffer(gain)))
                if len(sums) == 64 and texts:
                    first = np.concatenate([np.frombuffer(x, _TEXT) for x in texts]).copy()
                    for p, s, k, g in sums:
                        first["base"][p] += s
                        first["n_known"][p] += k
                        first["gain"][p] += g
                    texts, sums = [first.tobytes()], []
    if now is not None:
        yield out()


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, word_share: float = WORD_SHARE, depth: int = DEPTH, state_share: float = STATE_SHARE, entry_share: float = ENTRY_SHARE, min_state: int = MIN_STATE) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts train unless crc32 of the id (as text) modulo folds is held. word_share must be 1 / 7,000 or more.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), (fold == held).alias("held_out"))

    training = rows.where("not held_out").select("text")
    counts = stored(training.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")
    n_all, n_words = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    end = F.col("word") == F.lit(b"")
    top = counts.where(~end & (F.col("c") >= max(2.0, word_share * n_all))).orderBy(F.desc("c"), "word").limit(int(1 / word_share)).collect()
    ends = counts.where(end).agg(F.sum("c")).first()[0] or 0
    words = Words({bytes(r["word"]): r["c"] for r in top}, n_all, n_words, ends)

    symbols = stored(training.mapInArrow(_symbols(words), "symbols binary"), "symbols")
    tree = grow_tree(symbols, words, depth, state_share, entry_share)
    moved = rows.mapInArrow(_post(words, tree), _MOVED)
    moved = moved.repartition(F.coalesce("word", F.col("chunk").cast("string").cast("binary"))).sortWithinPartitions("word", "chunk")
    found = moved.mapInArrow(_rare(words, tree, min_state), _SUM).repartition("chunk").sortWithinPartitions("chunk", F.col("rows").isNull())
    found = found.mapInArrow(_total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
