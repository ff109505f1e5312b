"""The registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfit.llm.chat import format_chats, read_back
from spanfit.llm.common import scratch, table
from spanfit.llm.embedding_dedup import embedding_report
from spanfit.llm.exact_dedup import exact_report
from spanfit.llm.line_dedup import line_report
from spanfit.llm.mixing import mix_report
from spanfit.llm.quality import quality_report
from spanfit.llm.simhash import near_report
from spanfit.llm.sp_backend import round_trip
from spanfit.llm.suffix_dedup import suffix_report
from spanfit.llm.suffix_tree import suffix_tree_scores
from spanfit.llm.token_alignment import alignment_report
from spanfit.llm.token_counts import fill_cache, token_counts
from spanfit.llm.vector_codes import ROUNDS, vector_code_report

CHAT_TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: A conversation whose texts are made of control strings.
CONTROL_CHAT = """
    SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
    UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"""


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_report(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_CHAT))
    path = public_tokenizers.path(CHAT_TOKENIZER)
    return read_back(format_chats(rows, path), path)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents. An eighth of them is counted first, as a run before this one would have, so that the cache has hits and misses."""
    docs, model, cache = table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), scratch(spark, "token-counts")
    fill_cache(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 8 == 0), model, cache)
    return token_counts(docs, model, cache)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_report(table(spark, sf_dir, "embeddings"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path(CHAT_TOKENIZER), public_tokenizers.path(PIECES))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code_report(table(spark, sf_dir, "embeddings"))


def vector_code_sql(rounds: int = ROUNDS) -> str:
    """All rounds one after another; sums of products are exact in doubles below 2^53."""
    steps = [
        """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "p AS MATERIALIZED (SELECT vec_id, label, k, q[k * len(q) // 4 + 1 : (k + 1) * len(q) // 4] AS c FROM v, range(4) AS parts(k))",
        "b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, c FROM p QUALIFY e < 256)",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p.k, p.c, min({{'d': list_inner_product(p.c, p.c) - 2 * list_inner_product(p.c, b.c) + list_inner_product(b.c, b.c), 'e': e}}) AS m
                         FROM p JOIN b{r} b USING (k) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN (
                                 SELECT k, e, list(x ORDER BY i) AS c FROM (SELECT k, m.e AS e, i, floor(sum(c[i]) / count(*)) AS x FROM a{r}, unnest(range(1, len(c) + 1)) AS axes(i) GROUP BY ALL) GROUP BY ALL
                             ) n ON b.k = n.k AND b.e = n.e)""")
    return f"""
            WITH {", ".join(steps)},
            coded AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
                   (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY k, e, i)) FROM b{rounds}, unnest(range(1, len(c) + 1)) AS axes(i)) AS codebooks_sha256
            FROM coded JOIN v USING (vec_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality, op3_suffix_tree, op4_simhash, op5_mixing, op6_line_dedup, op7_chat, op8_sentencepiece, op9_token_counts, op10_embedding_dedup, op11_token_alignment, op12_suffix_dedup, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op5_mixing": r"""
            WITH sized AS (SELECT doc_id, coalesce('0' || source, '1') AS k,
                                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
            per AS (SELECT k, CAST(sum(size) AS BIGINT) AS s, count(*) AS n FROM sized GROUP BY k),
            weighed AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM per),
            ordered AS (SELECT *, row_number() OVER o AS i, sum(s) OVER o - s AS held, sum(w) OVER () - sum(w) OVER o + w AS open,
                               sum(s) OVER () AS total FROM weighed WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / w, k)),
            level AS (SELECT CAST(total - 3 * held AS DOUBLE) / CAST(open AS DOUBLE) AS share FROM ordered
                      WHERE 3 * s >= (CAST(total - 3 * held AS DOUBLE) / CAST(open AS DOUBLE)) * w ORDER BY i LIMIT 1),
            target AS (SELECT k, s, least(CAST(3 * s AS DOUBLE), share * w) AS target,
                              CAST(('0x' || substr(sha256('mix' || k), 1, 8)) AS BIGINT) / 4294967296e0 AS u FROM weighed, level),
            placed AS (SELECT doc_id, size, s, target, u, CASE WHEN s > 0 THEN target / s ELSE 0e0 END AS r,
                              row_number() OVER (PARTITION BY k ORDER BY size, doc_id) AS i FROM sized JOIN target USING (k)),
            counted AS (SELECT *, CAST(floor(i * r + u) - floor((i - 1) * r + u) AS BIGINT) AS copies FROM placed)
            SELECT doc_id, size, s AS source_size, target, size * copies AS taken, copies FROM counted""",
        "op7_chat": r"""
            WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
                   CAST(sum(length('<|turn|><|body|><|end|>') + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text,
                       '<\\*(\|(turn|body|end|endoftext|im_start|im_end)\|>|/?s>|</?SYS>>)|\[\\*/?INST\]'))) AS BIGINT) AS formatted_chars
            FROM turns GROUP BY conv_id""",
        "op10_embedding_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
            links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.good AND b.good
                      AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
            reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
            SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = vec_id) AS n_links, (SELECT min(b) FROM reach r WHERE r.a = vec_id) AS component_id,
                   vec_id = (SELECT min(b) FROM reach r WHERE r.a = vec_id) AS kept FROM v""",
        "op13_vector_codes": vector_code_sql(),
    }
