"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed to BUCKETS (each with value 1 / sqrt(distinct words)), STATS statistics
of its structure and numeric metadata columns, standardised and clipped. The score is
  sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
all pairwise interactions at rank RANK in time linear in the features.

Training uses a sample of at most `max_train` labelled rows (those with the least hash of their id), which bounds what
reaches the driver whatever the corpus; every text is scored, whole. The model has a fixed size and goes to all tasks.

Defined results: null text is empty and gets a score like any other; null or missing metadata counts as average; rows
whose label or id is null don't train; repeated label rows of an id count once (the largest label); without labelled rows
every score is 0.5; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanfit.llm.common import fresh, small_batches

BUCKETS, RANK, MAX_TRAIN = 1 << 16, 8, 12_000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.05, 2e-4, 2
CLIP = 4.0

_CLASSES = np.zeros((256, 7))
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"-()", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~", b"\x20\x09\x0a\x0b\x0c\x0d")):
    _CLASSES[list(_bytes), _k] = 1
STATS = 18


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of the distinct words."""
    distinct = set(words)
    return np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct)).astype(np.int64) % BUCKETS


def structure(text: bytes, words: list[bytes], n_distinct: int) -> list[float]:
    """Shares of kinds of characters, lengths, and repetition of words and lines."""
    n = max(1, len(text))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines, n_words = max(1, len(lines)), max(1, len(words))
    ended = sum(x.rstrip()[-1:] in b".!?\"" for x in lines)
    return [
        *(kinds / n),
        1 - kinds.sum() / n,
        kinds[0] / max(1.0, kinds[0] + kinds[1]),
        np.log1p(len(text)),
        np.log1p(len(words)),
        np.log1p(n_lines),
        sum(map(len, words)) / n_words,
        np.log1p(max(map(len, words), default=0)),
        n_distinct / n_words,
        len(set(lines)) / n_lines,
        np.log1p(len(words) / n_lines),
        ended / n_lines,
    ]


def features(text: bytes) -> tuple[np.ndarray, list[float]]:
    words = text.lower().split()
    buckets = word_buckets(words)
    return buckets, structure(text, words, len(buckets))


@dataclass
class Model:
    """w0, weights and factors of words then statistics, and how statistics are standardised."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        z = np.nan_to_num((stats - self.mean) / self.scale, nan=0.0, posinf=CLIP, neginf=-CLIP)
        return np.clip(z, -CLIP, CLIP)

    def sums(self, buckets: np.ndarray, n: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: sum of w x, sum of v x, sum of v^2 x^2, over words (n of them to each text, in order) and statistics."""
        text = np.repeat(np.arange(len(n)), n)
        x = 1 / np.sqrt(np.maximum(n, 1))
        first = np.bincount(text, self.w[buckets], len(n)) * x + z @ self.w[BUCKETS:]
        linear = np.empty((len(n), RANK))
        square = np.empty((len(n), RANK))
        for f in range(RANK):
            own = self.v[buckets, f]
            linear[:, f] = np.bincount(text, own, len(n)) * x
            square[:, f] = np.bincount(text, own * own, len(n)) * x * x
        return first, linear + z @ self.v[BUCKETS:], square + (z * z) @ (self.v[BUCKETS:] ** 2)

    def raw(self, buckets: np.ndarray, n: np.ndarray, z: np.ndarray) -> np.ndarray:
        first, linear, square = self.sums(buckets, n, z)
        return self.w0 + first + 0.5 * (linear**2 - square).sum(axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def train(buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray) -> Model:
    """Adagrad on the logistic loss, in a fixed order of batches."""
    rng = np.random.default_rng(SEED)
    known = np.isfinite(stats)
    mean = np.where(known, stats, 0).sum(axis=0) / np.maximum(1, known.sum(axis=0))
    scale = np.sqrt((np.where(known, stats - mean, 0) ** 2).sum(axis=0) / np.maximum(1, known.sum(axis=0))) + 1e-6
    size = BUCKETS + stats.shape[1]
    rate = (labels.sum() + 1) / (len(labels) + 2)
    m = Model(float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)), mean, scale)
    gw, gv = np.full(size, 1e-2), np.full((size, RANK), 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            n = np.array([len(buckets[k]) for k in own])
            b, z = np.concatenate([buckets[k] for k in own]), m.standard(stats[own])
            first, linear, square = m.sums(b, n, z)
            error = sigmoid(m.w0 + first + 0.5 * (linear**2 - square).sum(axis=1)) - labels[own]
            m.w0 -= 0.01 * error.mean()
            used, place = np.unique(b, return_inverse=True)
            text = np.repeat(np.arange(len(n)), n)
            x = (1 / np.sqrt(np.maximum(n, 1)))[text]
            ex = error[text] * x
            grad_w = np.bincount(place, ex) + DECAY * m.w[used]
            exx = np.bincount(place, ex * x)
            grad_v = np.stack([np.bincount(place, ex * linear[text, f]) for f in range(RANK)], axis=1) - exx[:, None] * m.v[used] + DECAY * m.v[used]
            s = slice(BUCKETS, size)
            for g, p, at_, grad in ((gw, m.w, used, grad_w), (gv, m.v, used, grad_v), (gw, m.w, s, error @ z + DECAY * m.w[s]), (gv, m.v, s, (z * error[:, None]).T @ linear - (error @ (z * z))[:, None] * m.v[s] + DECAY * m.v[s])):
                g[at_] += grad * grad
                p[at_] -= RATE * grad / np.sqrt(g[at_])
    return m


def _meta(b: pa.RecordBatch, n: int) -> np.ndarray:
    """Metadata columns m0, m1 ... as logarithms of sizes, NaN for null."""
    found = [b.column(f"m{k}").to_numpy(zero_copy_only=False).astype(np.float64) for k in range(n)]
    return np.stack([np.sign(x) * np.log1p(np.abs(x)) for x in found], axis=1) if n else np.zeros((b.num_rows, 0))


def _extract(n_meta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(x) for x in b.column("text").to_pylist()]
            stats = np.concatenate([np.array([s for _, s in found]).reshape(-1, STATS), _meta(b, n_meta)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([x.astype(np.uint32).tobytes() for x, _ in found], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], names=["label", "buckets", "stats"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", meta: tuple[str, ...] = (), max_train: int = MAX_TRAIN) -> Model | None:
    """A model from a sample of at most max_train labelled rows; None if there are none."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = F.broadcast(known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train))  # bounded by max_train
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *(F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(meta)))
    rows = slim.join(sample, F.col("id") == F.col("label_id")).dropDuplicates(["id"]).drop("id", "label_id")
    found = rows.mapInArrow(_extract(len(meta)), "label int, buckets binary, stats binary").toArrow()
    if not found.num_rows:
        return None
    keys = sorted(range(found.num_rows), key=lambda k, s=found.column("stats").to_pylist(), b=found.column("buckets").to_pylist(): (s[k], b[k]))
    found = found.take(pa.array(keys))  # the order of training must not depend on the order of tasks
    stats = np.frombuffer(b"".join(found.column("stats").to_pylist())).reshape(found.num_rows, -1)
    return train([np.frombuffer(x, np.uint32).astype(np.int64) for x in found.column("buckets").to_pylist()], stats, found.column("label").to_numpy().astype(np.float64))


def _score(model: Model | None, n_meta: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                score = np.full(b.num_rows, 0.5)
            else:
                found = [features(x) for x in b.column("text").to_pylist()]
                stats = np.concatenate([np.array([s for _, s in found]).reshape(-1, STATS), _meta(b, n_meta)], axis=1)
                n = np.array([len(x) for x, _ in found])
                score = sigmoid(model.raw(np.concatenate([x for x, _ in found]), n, model.standard(stats)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score)], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model | None, score_col: str = "score", text_col: str = "text", meta: tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`; by default all) with the score of each row, 0 to 1, higher: label 1 likelier. A kept column of the score's name is replaced."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c != score_col]
    fields = [docs.schema[c] for c in keep]
    text, row = F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.struct(*(F.col(f"`{c}`") for c in keep))
    slim = docs.select(row.alias("row"), text.alias("text"), *(F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(meta)))
    schema = T.StructType([T.StructField("row", T.StructType(fields)), T.StructField("score", T.DoubleType())])
    return slim.mapInArrow(_score(model, len(meta)), schema).select("row.*", F.col("score").alias(score_col))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows kept from training: crc32 of the id as text is a multiple of folds."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, meta: tuple[str, ...] = ("n_chars",), **how) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    meta = tuple(c for c in meta if c in docs.columns)
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), meta=meta, **how)
    return score(docs, model, meta=meta, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, meta: tuple[str, ...] = ("n_chars",), **how) -> DataFrame:
    """The rows that score at least threshold, with the columns of docs."""
    meta = tuple(c for c in meta if c in docs.columns)
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), meta=meta, **how)
    name = fresh("quality_score", docs.columns)
    return score(docs, model, name, meta=meta).where(F.col(name) >= threshold).select(*docs.columns)
