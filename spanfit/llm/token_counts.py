"""Token counts through a cache of digests.

A text's digest (SHA-256 of its UTF-8) and the tokenizer's (of its file) are joined to stored counts; texts without one
are encoded once for each distinct text, and their counts are appended to the cache. The cache is a Parquet table
(digest, n_tokens) anywhere Spark can write, partitioned by tokenizer, so that one tokenizer's counts are read without the
others'; it may be shared by many corpora and tokenizers.

Digests alone are anti-joined with the cache. Where all hit, no text is read again; up to FEW misses are sent to all scan
tasks, so only texts that miss move (each task's first of equal ones), to the task that encodes them. More misses are joined
where the texts are dealt by digest. Ids and digests alone go to the final join, much copied texts dealt over many tasks.

Counts are those of the library for the file: tokenizers for .json, sentencepiece for .model; no begin, end or added
special ids, special strings as ordinary text, no truncation. For a sentencepiece model whose pieces never span a marker
after another character, a text is counted by its words and a task keeps counts of words it has met (bounded).

Defined results: null text counts as empty and has 0 tokens; repeated rows and ids are each counted; an empty table gives
an empty result and leaves the cache as it was. The limit is compared with >.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfit.llm.common import small_batches, spread_join, stored
from spanfit.llm.sp_backend import CACHE_ENTRIES, MARK, parse_model

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Digests that a task remembers; a copy beyond them is encoded again.
TASK_DIGESTS = 500_000
#: Digests (32 bytes each) that may be sent to all tasks.
FEW = 1_000_000


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Token counts of texts by the library for the file."""

    def __init__(self, path: str) -> None:
        self.apart, self.met = False, {}
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
            with open(path, "rb") as f:
                model = parse_model(f.read())
            self.apart = model["dummy_prefix"] and not model["trim"] and not model["charsmap"] and not any(MARK in p.lstrip(MARK) for p, _, _ in model["pieces"])
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            library.no_truncation()
            library.no_padding()
            self.whole = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return self.whole(texts)
        words = [[] if not x or "  " in x or MARK in x or x[0] == " " or x[-1] == " " else x.split(" ") for x in texts]
        spaced = [k for k, w in enumerate(words) if not w]  # runs of spaces and markers: counted whole
        new = list(set().union(*words) - self.met.keys())
        if len(self.met) + len(new) > CACHE_ENTRIES and self.met:
            self.met = {}
            new = list(set().union(*words))
        self.met.update(zip(new, self.whole(new), strict=True))
        got = self.met.__getitem__
        counts = [sum(map(got, w)) for w in words]
        for k, n in zip(spaced, self.whole([texts[k] for k in spaced]), strict=True):
            counts[k] = n
        return counts


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest in the task."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        if len(seen) > TASK_DIGESTS:
            seen.clear()
        for k, d in enumerate(b.column("digest").to_pylist()):
            if d not in seen:
                seen.add(d)
                keep.append(k)
        if keep:
            yield b if len(keep) == b.num_rows else b.take(pa.array(keep))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _firsts(batches):
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counter(path).count(b.column("text").to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return run


def stored_counts(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame | None:
    """(digest, n_tokens) in the cache for that tokenizer; None while there is no cache."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _slim(docs: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    """Digests (and ids and bytes) of texts, stored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [] if id_col is None else [F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes")]
    return stored(docs.select(*own, F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "texts")


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text", slim: DataFrame | None = None) -> None:
    """Encodes the distinct texts that the cache has no count of, and appends their counts. slim: the stored digests of docs, if at hand."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer_digest(tokenizer_path)
    slim = _slim(docs, None, text_col) if slim is None else slim
    known = stored_counts(spark, cache_path, tokenizer)
    missing = slim.select("digest").distinct()
    missing = stored(missing if known is None else missing.join(known, "digest", "left_anti"), "missing")
    n = missing.count()
    if not n:
        return
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    if n <= FEW:
        dealt = texts.join(F.broadcast(missing), "digest", "left_semi").mapInArrow(_firsts, "digest binary, text string").repartition("digest")  # at most FEW digests
    else:
        dealt = texts.mapInArrow(_firsts, "digest binary, text string").repartition("digest").join(missing, "digest", "left_semi")
    new = dealt.mapInArrow(_count(tokenizer_path), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit. Appends counts of new texts to the cache."""
    small_batches(docs.sparkSession)
    rows = _slim(docs, id_col, text_col)
    fill_cache(docs, tokenizer_path, cache_path, text_col, rows)
    counts = stored_counts(docs.sparkSession, cache_path, tokenizer_digest(tokenizer_path))
    if counts is None:  # no rows, and no cache before
        counts = docs.sparkSession.createDataFrame([], "digest binary, n_tokens long")
    return spread_join(rows, counts, ["digest"], "doc_id").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
